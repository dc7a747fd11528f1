"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles have one global order, from rare to frequent.  A document whose set of n
shingles must share ``need`` of them with a partner shares at least l of them within
the first n - need + l of both, for every l.  A longer prefix (larger l) costs
more postings but asks for l common ones, so each document takes the l of the
least estimated cost, from the exact list lengths of its prefix shingles; a pair
uses the smaller l of its two documents.  What passes is verified on the whole sets.

Documents of equal sets are one class from the start.  Candidates of a token are
compared with one hub first, and in pairs only across components (linking.links).
Links never leave a component, so the links of a document are then counted inside its
component, in blocks (linking.degrees).
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_of, materialise, order_id, small_batches, text_of, written
from .kernels import tidy
from .linking import connected_components, degrees, id_filter, links, may_hold

#: Buckets of the counts that order shingles; a fixed 16 MB.
SKETCH_BITS = 23
SLICE = 1 << 17
#: Larger counts are alike.
MOST = (1 << 16) - 1
#: Largest number of common prefix shingles that is asked for.
MOST_MATCHES = 8
#: Cost of verifying one shingle, in units of reading one posting.
VERIFY_COST = 1 / 32


def _digest(found: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, as two numbers."""
    return np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)


def _sets(batches, size: int):
    from .kernels import shingle_set, utf8_views, word_hashes

    for batch in batches:
        for i, data in enumerate(utf8_views(batch.column("_text"))):
            yield batch, i, shingle_set(word_hashes(data), size)


@tidy
def _sketch_batches(batches, size: int):
    """Counts of shingles by hash bucket of a whole partition, in packed slices."""
    import pyarrow as pa

    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    held, waiting = 0, []

    def add(parts: list) -> None:
        bucket, times = np.unique(np.concatenate(parts).astype(np.int32), return_counts=True)
        counts[bucket] += times.astype(np.int32)

    for _, _, found in _sets(batches, size):
        waiting.append(found >> np.uint64(64 - SKETCH_BITS))
        held += len(found)
        if held > 1 << 20:
            add(waiting)
            held, waiting = 0, []
    if waiting:
        add(waiting)
    if counts.any():
        parts = counts.reshape(-1, SLICE)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(np.arange(len(parts)), pa.int32()),
                "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
            }
        )


@tidy
def _add_batches(batches):
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(zlib.decompress(packed.as_py()), np.int32)
            total[part] = total[part] + counts if part in total else counts
            total[part] = np.minimum(total[part], MOST)
    if total:
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(total), pa.int32()), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())}
        )


def shingle_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of all documents' shingles by hash bucket (a fixed number of buckets).

    The tasks' counts are added in two levels, so no task adds those of all the others.
    """
    schema = "part int, counts binary"
    fan = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = (
        rows.mapInArrow(lambda batches: _sketch_batches(batches, size), schema)
        .repartition("part", F.pmod(F.spark_partition_id(), F.lit(fan)))
        .mapInArrow(_add_batches, schema)
        .repartition("part")
        .mapInArrow(_add_batches, schema)
        .collect()
    )
    counts = np.zeros(1 << SKETCH_BITS, np.uint16).reshape(-1, SLICE)
    for part, packed in parts:  # one row for each slice
        counts[part] = np.frombuffer(zlib.decompress(packed), np.int32)
    return counts.reshape(-1)


@tidy
def _prefix_batches(batches, counts, size: int, percent: int):
    import pyarrow as pa

    counts, rows = counts.value, []
    shift = np.uint64(64 - SKETCH_BITS)

    def flush(batch):
        at, n, d1, d2, weight, prefix = zip(*rows, strict=True)
        rows.clear()
        return pa.RecordBatch.from_pydict(
            {
                "id": batch.column("_id").take(pa.array(at)),
                "size": pa.array(n, pa.int64()),
                "d1": pa.array(d1, pa.int64()),
                "d2": pa.array(d2, pa.int64()),
                "weight": pa.array(weight, pa.int64()),
                "prefix": pa.array(prefix, pa.list_(pa.int64())),
            }
        )

    last = None
    for batch, i, found in _sets(batches, size):
        if rows and (batch is not last or len(rows) >= 2000):
            yield flush(last)
        last, n = batch, len(found)
        digest = _digest(found)
        often = counts[(found >> shift).astype(np.int64)]
        need = -(-percent * n // 100)
        order = np.lexsort((found, often))[: n - need + MOST_MATCHES] if n else np.empty(0, np.int64)
        rows.append((i, n, int(digest[0]), int(digest[1]), int(often[order].sum()), found[order].view(np.int64)))
    if rows:
        yield flush(last)


@tidy
def _set_batches(batches, wanted, size: int):
    import pyarrow as pa

    from .kernels import shingle_set, utf8_views, word_hashes

    for batch in batches:
        ids = batch.column("_id").to_pylist()
        at = [i for i, x in enumerate(ids) if may_hold(wanted.value, x)]
        for lo in range(0, len(at), 1000):
            part = pa.array(at[lo : lo + 1000])
            found = [shingle_set(word_hashes(v), size) for v in utf8_views(batch.column("_text").take(part))]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("_id").take(part),
                    "digest": pa.array([int(_digest(x)[0]) for x in found], pa.int64()),
                    "items": pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                }
            )


def _best_matches(postings: DataFrame, percent: int) -> DataFrame:
    """(id, matches): the number of common prefix shingles that costs least.

    The prefix is that for a partner of equal size, as most partners are about as large.
    """
    first = F.col("size") - F.ceil(F.col("size") * 2 * percent / (100 + percent)) + 1
    sums = [F.sum(F.when(F.col("pos") < first + k, F.col("listed") - 1).otherwise(0)).alias(f"s{k + 1}") for k in range(MOST_MATCHES)]
    cost = lambda k: F.col(f"s{k}") * (1 + F.col("size") * VERIFY_COST / k)
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * percent / 100))
    options = F.array(*[F.struct(cost(k).alias("cost"), F.lit(k).alias("k")) for k in range(1, MOST_MATCHES + 1)])
    best = F.array_min(F.filter(options, lambda o: o["k"] <= need))["k"]
    return postings.groupBy("id", "size").agg(*sums).select("id", best.alias("matches"))


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share as many tokens as their prefixes must.

    pairs: x_ and y_ id, size, pos, matches, a row for each common token.
    """
    need = F.ceil((F.col("x_size") + F.col("y_size")) * percent / (100 + percent))
    matches = F.least("x_matches", "y_matches")
    close = (
        (F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent)
        & (F.col("x_pos") < F.col("x_size") - need + matches)
        & (F.col("y_pos") < F.col("y_size") - need + matches)
    )
    return (
        pairs.where(close)
        .groupBy(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("common"), F.max(matches).alias("matches"))
        .where("common >= matches")
        .select("a", "b")
    )


_SIDE = ("id", "size", "pos", "matches")


def _stars(percent: int):
    def pairs(postings: DataFrame) -> DataFrame:
        hub = [(-F.col("hub.minus")).alias("y_id"), *[F.col(f"hub.{c}").alias(f"y_{c}") for c in _SIDE[1:]]]
        return _enough(postings.select(*[F.col(c).alias(f"x_{c}") for c in _SIDE], *hub), percent)

    return pairs


def _pairs_between(percent: int):
    def pairs(postings: DataFrame) -> DataFrame:
        x = postings.select("token", *[F.col(c).alias(f"x_{c}") for c in (*_SIDE, "component")])
        y = postings.select("token", *[F.col(c).alias(f"y_{c}") for c in (*_SIDE, "component")])
        return _enough(x.join(y, "token").where("x_component < y_component"), percent)

    return pairs


def similar_sets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, count_links: bool = True
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, n_copies, n_links.

    Texts link when 100 * |A and B| >= percent * |A or B| on their sets of distinct
    ``size``-word shingles (fewer words: the whole sequence as one).  component_id
    is the smallest id that links reach; n_copies the number of other rows with an
    equal set; n_links that of all other rows that the row links with, copies among
    them (absent without ``count_links``).

    * null, empty or blank text has an empty set and links with nothing;
    * a null id is ordered after all others and comes back as null;
    * rows that share an id are one document and so in one component;
    * ties and equal sets are one class; an empty table gives an empty result;
    * other columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    counts = spark.sparkContext.broadcast(shingle_counts(rows, size))
    prefixed = materialise(
        rows.mapInArrow(
            lambda batches: _prefix_batches(batches, counts, size, percent),
            "id long, size long, d1 long, d2 long, weight long, prefix array<long>",
        ),
        "prefixes",
    )
    classes = materialise(
        prefixed.where("size > 0")
        .groupBy("d1", "d2")
        .agg(
            F.min("id").alias("class_id"),
            F.count(F.lit(1)).alias("members"),
            F.first("size").alias("size"),
            F.first("weight").alias("weight"),
            F.first("prefix").alias("prefix"),
        ),
        "classes",
    )
    begun = written()
    postings = classes.select(F.col("class_id").alias("id"), "size", "weight", F.posexplode("prefix").alias("pos", "token"))
    listed = postings.groupBy("token").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    shared = materialise(postings.join(listed, "token"), "shared-postings")
    chosen = _best_matches(shared, percent)
    last = F.col("size") - F.ceil(F.col("size") * percent / 100) + F.col("matches")
    adaptive = materialise(shared.join(chosen, "id").where(F.col("pos") < last), "adaptive-postings")

    read: list[DataFrame] = []

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(id_filter(ids, "id"))
        sets = rows.mapInArrow(lambda batches: _set_batches(batches, wanted, size), "id long, digest long, items array<long>")
        read.append(materialise(sets.join(ids, "id", "left_semi"), "sets"))
        return read[-1]

    found = connected_components(links(adaptive, _stars(percent), _pairs_between(percent), sets_of, percent, 100))
    placed = classes.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select("d1", "d2", "class_id", "members", "component")
    if count_links:
        linked = placed.where("component IS NOT NULL").select(F.col("d1").alias("id"), "component", "members")
        every = functools.reduce(DataFrame.unionByName, read).groupBy(F.col("digest").alias("id")).agg(F.first("items").alias("items"))
        counted = degrees(linked, every, percent, 100).select(F.col("id").alias("d1"), F.col("n").alias("others"))
        placed = materialise(placed.join(counted, "d1", "left"), "labelled")
        discard(begun, placed)
    else:
        discard(begun, found)
    copies = F.coalesce("members", F.lit(1)) - 1
    links_ = [(copies + F.coalesce("others", F.lit(0))).alias("n_links")] if count_links else []
    return (
        prefixed.select("id", "size", "d1", "d2")
        .join(placed, ["d1", "d2"], "left")
        .select(
            id_of(F.col("id")).alias(id_col),
            F.col("size").alias("n_shingles"),
            id_of(F.coalesce("component", "class_id", "id")).alias("component_id"),
            copies.alias("n_copies"),
            *links_,
        )
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay: one document of each component, with all their columns.

    Texts without words all stay; repeated rows of a document that stays do too; nulls,
    ties and empty tables as in similar_sets().
    """
    found = similar_sets(df.select(id_col, text_col), id_col, text_col, size, percent, count_links=False)
    own = found.select(order_id(id_col).alias("_own"), order_id("component_id").alias("_group"))
    stays = own.where("_own = _group").select("_own").distinct()
    return df.select(F.struct("*").alias("_row"), order_id(id_col).alias("_own")).join(stays, "_own", "left_semi").select("_row.*")
