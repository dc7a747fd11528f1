"""Exact dedup by a 128-bit content hash with a comparison of bytes.

Native: DataFrame functions only.  The text is shuffled once, after equal
texts have met on the map side, so a group of copies that holds a third of all
rows reaches the reducers as one row for each map task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG_MAX, SPACES, id_of, materialise, order_id, text_of

_STEP = 1 << 64


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space.  The row with
    the most code points stays, then the one with the smallest id.

    * null text counts as empty; all empty texts are one group;
    * a null id is ordered after every other id and comes back as null;
    * repeated rows (same id, same text) are members like others; when they tie
      for the place that stays, each of them is marked kept, as they are one row;
    * an empty table gives an empty result; other columns are ignored.

    ``hash_fn`` may be weak: texts that share a hash are told apart by their bytes.
    """
    keyed = (
        df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
        .select("_id", F.char_length("_text").alias("_len"), F.translate("_text", SPACES, "").alias("_norm"))
        .withColumn("_hash", hash_fn(F.col("_norm")))
    )
    # One number that is largest for the row that stays: length, then smallest id.
    rank = F.col("_len").cast("decimal(10,0)") * F.lit(str(_STEP)).cast("decimal(20,0)") + (
        F.lit(LONG_MAX).cast("decimal(20,0)") - F.col("_id").cast("decimal(20,0)")
    )
    by_bytes = keyed.groupBy("_hash", "_norm").agg(F.count(F.lit(1)).alias("_size"), F.max(rank).alias("_best"))
    by_hash = materialise(
        by_bytes.groupBy("_hash").agg(
            F.count(F.lit(1)).alias("_texts"), F.max("_size").alias("_size"), F.max("_best").alias("_best")
        ),
        "exact-groups",
    )
    digest = F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha")
    rows = keyed.select("_id", "_len", "_hash", digest).join(
        by_hash.where("_texts = 1").drop("_texts"), "_hash"
    )
    collided = by_hash.where("_texts > 1").select("_hash")
    if not collided.isEmpty():
        apart = keyed.join(collided, "_hash", "left_semi")
        rows = rows.unionByName(
            apart.join(
                apart.groupBy("_hash", "_norm").agg(F.count(F.lit(1)).alias("_size"), F.max(rank).alias("_best")),
                ["_hash", "_norm"],
            ).select("_hash", "_id", "_len", digest, "_size", "_best")
        )
    step = F.lit(str(_STEP)).cast("decimal(20,0)")
    keep = (F.lit(LONG_MAX).cast("decimal(20,0)") - F.col("_best") % step).cast("long")
    return (
        rows.withColumn("_keep", keep)
        .withColumn("_longest", F.floor(F.col("_best") / step).cast("long"))
        .select(
            id_of(F.col("_id")).alias(id_col),
            id_of(F.col("_keep")).alias("keep_id"),
            F.col("_size").alias("group_size"),
            ((F.col("_id") == F.col("_keep")) & (F.col("_len") == F.col("_longest"))).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, once each, with all their columns."""
    text = text_of(text_col)
    norm = F.translate(text, SPACES, "").cast("binary")
    keyed = df.select(
        F.struct("*").alias("_row"), order_id(id_col).alias("_own"), F.sha2(norm, 256).alias("_sha"), F.char_length(text).alias("_len")
    )
    groups = exact_groups(df.select(id_col, text_col), id_col, text_col)
    stays = groups.where("kept").select(order_id(id_col).alias("_own"), F.col("text_sha256").alias("_sha")).distinct()
    # Rows that repeat a row that stays differ from it in nothing that counts, or are shorter.
    longest = F.max_by("_row", "_len").alias("_row")
    return keyed.join(stays, ["_own", "_sha"], "left_semi").groupBy("_own", "_sha").agg(longest).select("_row.*")
