"""Line dedup: every repeated long line stays in one document only.

Native: DataFrame functions only.  Lines become 128-bit hashes, which are
range-partitioned and sorted by document and position; one pass over each
partition tells first occurrences from later ones.  Between the stages travel
hashes and bitmaps, no text.  Keys so frequent that a single one would fill a
good part of a partition (hot_keys(); they are few) are pre-aggregated on the map
side instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, id_of, let, lower_ascii, materialise, order_id, text_of

#: A key is hot if it has more than half a partition's share of the lines, so there are
#: twice as many as partitions, between these bounds.
FEWEST, MOST = 2000, 10_000
#: Keys that the search for hot ones tracks for each that it may find (bounds its state).
TRACKED = 10


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _doc, _pos, _h1, _h2) of the lines that can repeat."""
    return (
        rows.select("_id", "_doc", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_doc", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_doc", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn(
        "_doc", F.xxhash64(F.lit(3), "_text")
    )


def hot_keys(lines: DataFrame) -> list[int]:
    """The values of _h1 that are hot."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(max(FEWEST, 2 * parts), MOST)
    found = lines.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h1, {most}, {TRACKED * most})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] >= max(100, found["n"] / most)]


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _doc, drops) of each document that loses lines.

    ``drops`` is a sparse bitmap in document order: one (word, bits) for each
    run of 64 lines of which some go; all lines of absent words stay.  ``_doc``
    is a hash of the text, so rows that share an id but not the text have
    bitmaps of their own.
    """
    lines = materialise(_lines(_rows(df, id_col, text_col), min_chars), "line-hashes")
    hot = hot_keys(lines)
    is_hot = F.col("_h1").isin(hot) if hot else F.lit(False)
    by_document = Window.partitionBy("_h1", "_h2").orderBy("_id", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    later = (
        lines.where(~is_hot)
        .repartitionByRange("_h1")
        .sortWithinPartitions("_h1", "_h2", "_id", "_pos")
        .withColumn("_first", F.min("_id").over(by_document))
        .where("_id > _first")
        .select("_id", "_doc", "_pos")
    )
    if hot:
        first = lines.where(is_hot).groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"))
        later = later.unionByName(
            lines.where(is_hot)
            .join(F.broadcast(first), ["_h1", "_h2"])  # at most MOST keys
            .where("_id > _first")
            .select("_id", "_doc", "_pos")
        )
    bit = F.expr("shiftleft(1L, _pos & 63)")
    return (
        later.groupBy("_id", "_doc", F.expr("_pos >> 6").alias("_word"))
        .agg(F.bit_or(bit).alias("_bits"))
        .groupBy("_id", "_doc")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_word").alias("word"), F.col("_bits").alias("bits")))).alias("drops"))
    )


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, text (the lines that stay), drops.

    Lines whose key (stripped, A-Z lower-cased) has at least ``min_chars`` code
    points and occurs in two documents or more stay only in the document with
    the smallest id; there, all of them stay.

    * null or empty text is one empty line; a null id is ordered after all others;
    * rows that share an id are one document: a line they share stays in both;
    * an empty table gives an empty result; other columns are ignored.
    """
    rows = _rows(df, id_col, text_col)
    return (
        rows.join(keep_bitmaps(df, id_col, text_col, min_chars), ["_id", "_doc"], "left")
        .select("_id", "drops", let(F.split("_text", "\n", -1), _stay).alias("_out"))
        .select(
            id_of(F.col("_id")).alias(id_col),
            F.col("_out.n_lines").cast("long").alias("n_lines"),
            (F.col("_out.n_lines") - F.size("_out.kept")).cast("long").alias("n_dropped"),
            F.array_join("_out.kept", "\n").alias("text"),
            "drops",
        )
    )


def _stay(lines: Column) -> Column:
    """n_lines and kept, the lines that the bitmap leaves: in time linear in the lines."""
    positions = F.expr(
        "flatten(transform(drops, d -> transform(filter(sequence(0, 63), b -> (shiftright(d.bits, b) & 1L) = 1L), b -> d.word * 64 + b)))"
    )
    gone = F.coalesce(positions, F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.struct(F.size(lines).alias("n_lines"), F.transform(kept, lambda i: F.get(lines, i)).alias("kept"))
