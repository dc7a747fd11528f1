"""Document fingerprints: one-permutation MinHash with optimal densification.

Native: DataFrame functions only, and no shuffle for the fingerprint itself.
Every word shingle is hashed once; the top bits of the hash choose one of
``BINS`` bins and each bin keeps its smallest hash.  An empty bin takes the value
of the first non-empty bin in an order of its own (random start and odd stride,
which visits all bins), as in optimal densification.  The low ``BITS`` bits of
each bin are packed as hexadecimal digits; two texts that differ agree in a bin
by chance once in 2^BITS, which likeness() corrects for.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, let, lower_ascii, order_id, text_of

BINS = 128
BITS = 8
SHINGLE = 5
_BIN_BITS = BINS.bit_length() - 1
#: Seeds of the start and stride of each bin's search.
_START, _STRIDE = 11, 13


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Sorted hashes of the runs of ``size`` words; of fewer words, of all of them."""
    words = F.filter(F.split(lower_ascii(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def runs(hashed: Column) -> Column:
        n = F.size(hashed)
        last = n - size
        parts = lambda i: [F.get(hashed, i + k) for k in range(size)]
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(last < 0, F.array(F.xxhash64(hashed)))
            .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*parts(i))))
        )

    return F.sort_array(let(F.transform(words, lambda w: F.xxhash64(w)), runs))


def _bin(hashed: Column) -> Column:
    return F.shiftright(hashed, 64 - _BIN_BITS).cast("int") + F.lit(BINS // 2)


def _search_tables() -> tuple[Column, Column]:
    """Start and inverse stride of each empty bin's search, as literal arrays."""
    starts, inverses = [], []
    for b in range(BINS):
        x = (b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        starts.append((x >> _START) % BINS)
        inverses.append(pow((x >> (_START + _STRIDE)) % BINS | 1, -1, BINS))
    return F.array(*map(F.lit, starts)), F.array(*map(F.lit, inverses))


def fingerprint(text: Column) -> Column:
    """The hexadecimal fingerprint; the empty string if there is no word.

    Texts with the same shingles have the same fingerprint.
    """
    starts, inverses = _search_tables()

    def least(hashes: Column) -> Column:
        """The smallest hash of each non-empty bin, in order of bins."""
        return F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, F.greatest(i - 1, F.lit(0))))))

    def filled(minima: Column) -> Column:
        """BINS values; the search visits bin start + t * stride at step t, so the
        first non-empty bin is the one of the smallest t."""
        own = F.map_from_arrays(F.transform(minima, _bin), minima)

        def search(b: Column) -> Column:
            step = lambda h: (((_bin(h) - F.get(starts, b)) * F.get(inverses, b)).bitwiseAND(F.lit(BINS - 1))).cast("long")
            found = F.array_min(F.transform(minima, lambda h, i: step(h) * BINS + i)) % BINS
            return F.get(minima, found.cast("int"))

        fill = lambda table: F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.element_at(table, b), search(b))
        )
        return let(own, fill)

    digits = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1)))), BITS // 4, "0")
    packed = lambda minima: F.when(F.size(minima) == 0, "").otherwise(
        F.array_join(F.transform(filled(minima), digits), "")
    )
    return let(shingle_hashes(text), lambda hashes: let(least(hashes), packed))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of two fingerprints, corrected for
    chance; of two empty ones 1, of an empty and another 0."""
    width = BITS // 4
    piece = lambda s, i: F.substring(s, i * width + 1, F.lit(width))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: piece(a, i) == piece(b, i)))
    chance = 1.0 / (1 << BITS)
    corrected = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))
    )


#: Ranges of ids for each shuffle partition; many small ones even out.
RANGES = 4


def _constant(values: list) -> Column:
    """A list as one literal, however long."""
    return F.lit(json.dumps(values))


def _range_of(cuts: list[int], x: Column) -> Column:
    """The number of cuts up to x, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(_constant(cuts), "array<bigint>")  # folded into a literal
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(F.get(table, mid) <= x, pair(mid + 1, s["hi"])).otherwise(pair(s["lo"], mid))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, pair(F.lit(0), F.lit(len(cuts))), halve, lambda s: s["lo"])


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add _next, a struct of ``columns`` of the next row in order of _id; after the
    last row comes the first.  Rows of equal _id are ordered by ``columns``.

    A global order without a sort in one task: rows fall into ranges of _id, each
    range is sorted by itself, and a copy of the first row of the following range
    (one for each range) closes it.
    """
    spark = rows.sparkSession
    n = RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("_id")
    shares = F.from_json(_constant([i / n for i in range(1, n)]), "array<double>")
    found = ids.agg(F.percentile_approx("_id", shares, 10 * n).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    of = _range_of(cuts, F.col("_id"))
    firsts = sorted(tuple(r) for r in ids.groupBy(of.alias("r")).agg(F.min("_id")).collect())  # a row for each range
    if not firsts:
        return rows.withColumn("_next", F.struct(*columns))
    closes = spark.createDataFrame([(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)], "_id long, _range int")
    # One row for each range, and no shuffle of texts for it.
    closing = rows.join(F.broadcast(closes), "_id").select(*rows.columns, "_range", F.lit(True).alias("_closing"))
    inside = Window.partitionBy("_range").orderBy("_closing", "_id", *columns)
    return (
        rows.select("*", of.alias("_range"), F.lit(False).alias("_closing"))
        .unionByName(closing)
        .withColumn("_next", F.lead(F.struct(*columns)).over(inside))
        .where(~F.col("_closing"))
        .drop("_range", "_closing")
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row.

    Null text counts as empty; a text without words has the empty fingerprint; a
    text of fewer than SHINGLE words has one shingle, all of them; repeated rows
    each get a row; a null id stays null; other columns are ignored; an empty table
    gives an empty result.
    """
    return df.select(F.col(id_col), fingerprint(text_of(text_col)).alias("fingerprint"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with an edited text, the fingerprints of both and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many, or all, of the next document's.  Returns id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next.  A single row is
    followed by itself.
    """
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_print", fingerprint(F.col("_text")))
    n = F.char_length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - quarter), F.substring(F.col("_next._text"), F.lit(1), quarter))
    both = with_next(rows, ["_text", "_print"]).select(
        "_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "_print", F.col("_next._print").alias("_after")
    )
    return both.select("*", fingerprint(F.col("edited")).alias("_edited_print")).select(
        id_of(F.col("_id")).alias(id_col),
        "n_chars",
        "edited",
        F.col("_print").alias("fingerprint"),
        F.col("_edited_print").alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("_print"), F.col("_after")).alias("near_next"),
    )
