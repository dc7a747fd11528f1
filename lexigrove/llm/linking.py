"""Links between sets: verification, stars before pairs, components."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, written
from .kernels import tidy

#: Bits of the filter that spares most texts a second look: as many for each id, within bounds
#: (1 to 16 MB).  A fuller filter only lets more through.
BITS_PER_ID = 16
FEWEST_BITS, MOST_BITS = 1 << 23, 1 << 27
#: Sets that are compared with each other at once, and columns of the matrix that does it.
BLOCK, COLUMNS = 256, 4096


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); a component is its smallest node.

    Alternating large and small stars.  Each round is written to the shared folder.
    """
    begun = written()
    edges = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct()
    edges = materialise(edges, "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())
    before = mark(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(below, "hi")
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo <> hi").unionByName(
            below.select(F.col("m").alias("lo"), "hi")
        )
        edges = materialise(small.distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
        discard(begun, edges)
    labels = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
    labels = materialise(labels, "components")
    discard(begun, labels)
    return labels


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of crc32(id as text) modulo the number of bits, as 64-bit words."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_PER_ID * ids.count()).bit_length()))
    at = (F.crc32(F.col(column).cast("string").cast("binary")) % bits).alias("_at")
    words = (
        ids.select(at)
        .groupBy((F.shiftright("_at", 6)).cast("int").alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
        .toArrow()  # at most MOST_BITS / 64 rows
    )
    out = np.zeros(bits // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def may_hold(bits: np.ndarray, value: int) -> bool:
    at = zlib.crc32(str(value).encode()) % (64 * len(bits))
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


@tidy
def _overlap_batches(batches, numerator: int, denominator: int):
    import pyarrow as pa

    for batch in batches:
        left, right = batch.column("_left"), batch.column("_right")
        a, b = left.values.to_numpy(), right.values.to_numpy()
        p, q = left.offsets.to_numpy(), right.offsets.to_numpy()
        keep = np.zeros(len(left), bool)
        for i in range(len(left)):
            x, y = a[p[i] : p[i + 1]], b[q[i] : q[i + 1]]
            common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            keep[i] = denominator * common >= numerator * (len(x) + len(y) - common)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def verified(pairs: DataFrame, sets_of, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of which the sets have a Jaccard similarity of
    numerator / denominator or more, exactly.  ``sets_of(ids)`` gives (id, items),
    of other ids too if that is cheaper; it is read twice."""
    pairs = materialise(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(ids)
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("_left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("_right")), "b")
        .select("a", "b", "_left", "_right")
        .mapInArrow(lambda batches: _overlap_batches(batches, numerator, denominator), "a long, b long")
    )


def links(postings: DataFrame, stars, pairs_between, sets_of, numerator: int, denominator: int) -> DataFrame:
    """Edges that have the same components as all links.

    postings: (token, id, weight, ...), tokens that several ids share.

    1. In each token's list every id is compared with one hub only, the posting of
       the largest weight: ``stars(postings with hub)`` picks from as many pairs as
       there are postings.
    2. Ids that these links put in one component need no more comparison.  For the
       rest, ``pairs_between(postings with component)`` gives all candidate pairs of
       different components, so no link between two components is missed.
    """
    rest = [c for c in postings.columns if c not in ("token", "id", "weight")]
    hub = postings.groupBy("token").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), *rest)).alias("hub"))
    first = materialise(verified(stars(postings.join(hub, "token").where("id <> -hub.minus")), sets_of, numerator, denominator), "star-links")
    labels = connected_components(first).select(F.col("node").alias("id"), "component")
    placed = postings.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        placed.groupBy("token")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where("_low <> _high")
        .select("token")
    )
    open_ones = materialise(placed.join(mixed, "token"), "open-postings")
    return first.unionByName(verified(pairs_between(open_ones), sets_of, numerator, denominator))


def shared_counts(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many items each two of the sets share: products of slices of the matrix of sets and items."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    met = often[column] > 1
    row, column = row[met], column[met]
    renumbered = np.cumsum(often > 1) - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], renumbered[column[order]]
    out = np.zeros((n, n), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


@tidy
def _degree_batches(batches, numerator: int, denominator: int):
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("sets")
        edges, flat = lists.offsets.to_numpy(), lists.values
        ids, members, blocks = (flat.field(k).to_numpy() for k in ("id", "members", "block"))
        items = flat.field("items")
        starts, values = items.offsets.to_numpy(), items.values.to_numpy()
        for k in range(len(batch)):
            lo, hi = edges[k], edges[k + 1]
            own = starts[lo : hi + 1]
            size = np.diff(own)
            common = shared_counts(own - own[0], values[own[0] : own[-1]])
            linked = denominator * common >= numerator * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(linked, False)
            if batch.column("lo")[k].as_py() != batch.column("hi")[k].as_py():
                linked &= blocks[lo:hi][:, None] != blocks[lo:hi][None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(linked @ members[lo:hi])], names=["id", "n"])


def degrees(classes: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(id, n): members of the other classes that a class links with, exactly.

    classes: (id, component, members); sets: (id, items) of at least the classes in components
    of three classes or more.  Links never leave a component, so all pairs of a component are
    all that there is to compare: BLOCK sets against BLOCK others at a time, in tasks that a
    large component is spread over.  Pairs are counted where they are compared and never made rows.
    """
    of = classes.groupBy("component").agg(F.count(F.lit(1)).alias("g"), F.sum("members").alias("every"))
    placed = classes.join(of.where("g > 1"), "component")
    two = placed.where("g = 2").select("id", (F.col("every") - F.col("members")).alias("n"))
    blocks = F.ceil(F.col("g") / BLOCK)
    many = placed.where("g > 2").select("id", "component", "members", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    spread = many.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    grouped = (
        spread.groupBy("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        .agg(F.collect_list(F.struct("id", "members", "block", "items")).alias("sets"))
        .select("lo", "hi", "sets")
    )
    counted = grouped.mapInArrow(lambda batches: _degree_batches(batches, numerator, denominator), "id long, n long")
    return two.unionByName(counted.groupBy("id").agg(F.sum("n").alias("n")))
