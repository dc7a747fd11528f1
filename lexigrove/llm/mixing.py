"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks.  With weight w, block k (from 1) of a source is
released at slot floor((k - 1) / w) and due by slot ceil(k / w); in each slot the
released block with the earliest deadline runs.  As the weights sum to 1, every
deadline is met, so after t slots a source has had w * t blocks to within less
than one.

Weights are whole numbers of slots in a frame.  At the end of a frame no source is
ahead or behind, so the schedule of one frame, made once, repeats: the slot of
any block follows from its number by arithmetic, and nothing sequential grows
with the data.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import order_id

#: Slots of a frame, at least 16 for each source.
FRAME = 1 << 14
BLOCK_ROWS = 16
#: Rows in a part of a source, about: each part is numbered by itself.
PART_ROWS = 20_000


def capped_shares(counts: dict[str, int], largest: float) -> dict[str, Fraction]:
    """Natural shares, those above ``largest`` cut to it, the rest in proportion.

    ``largest`` is raised to 1 / number of sources where it is below.
    """
    top = max(Fraction(str(largest)), Fraction(1, max(1, len(counts))))
    cut: set[str] = set()
    while True:
        free = sum(n for s, n in counts.items() if s not in cut)
        left = 1 - top * len(cut)
        over = {s for s, n in counts.items() if s not in cut and Fraction(n, free) * left > top}
        if not over:
            return {s: top if s in cut else Fraction(n, free) * left for s, n in counts.items()}
        cut |= over


def whole_slots(weights: dict[str, float | Fraction], frame: int = FRAME) -> dict[str, int]:
    """Slots of each source in a frame: largest remainders, one at least.

    If a multiple of all denominators fits in ``frame`` it is the frame, and the
    weights are met exactly.
    """
    parts = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if not parts or min(parts.values()) <= 0:
        raise ValueError("weights must be above zero")
    total = sum(parts.values())
    parts = {s: w / total for s, w in parts.items()}
    exact = 1
    for w in parts.values():
        exact = exact * w.denominator // _gcd(exact, w.denominator)
        if exact > frame:
            break
    frame = exact if exact <= frame else max(frame, 1 << (16 * len(parts) - 1).bit_length())
    slots = {s: max(1, int(w * frame)) for s, w in parts.items()}
    spare = frame - sum(slots.values())
    order = sorted(parts, key=lambda s: (slots[s] - parts[s] * frame, s))
    for s in order[: max(0, spare)]:
        slots[s] += 1
    for s in sorted(slots, key=lambda s: (-slots[s], s))[: max(0, -spare)]:
        slots[s] -= 1
    return slots


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, number in the frame from 0, slot, release, deadline) of one frame."""
    frame = sum(slots.values())
    released: list[list[tuple[int, str, int, int]]] = [[] for _ in range(frame)]
    for source, q in slots.items():
        for k in range(q):
            release, deadline = k * frame // q, -((k + 1) * -frame // q)
            released[release].append((deadline, source, k, release))
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(frame):
        for item in released[slot]:
            heapq.heappush(ready, item)
        deadline, source, k, release = heapq.heappop(ready)
        out.append((source, k, slot, release, deadline))
    return out


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    frame: int = FRAME,
) -> DataFrame:
    """All rows as a struct ``row``, with block, place, slot, release, deadline and in_mix.

    Order by (slot, place) is the mix.  Without ``weights``, targets are the
    natural shares and every row is in the mix, however large its source and however
    many sources there are.  Shares are met exactly where all blocks fit in a frame
    and else rounded to whole slots of a frame.  With ``weights`` (by source), the mix
    ends where a source first runs out (in_mix false from there); sources without a
    weight are not in the mix and have no slot.

    Rows of a source are taken in the order of a hash of the id.  Null is a source
    of its own, named "" in ``weights`` like the empty name; repeated rows count like others; a null id is ordered
    like the largest; an empty table gives an empty result.  One number for each
    source goes to the driver, which makes the schedule of one frame: this is for up to
    some ten thousand sources.
    """
    spark = df.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = {r["s"]: r["n"] for r in df.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    count = {s: -(-n // block_rows) for s, n in counts.items()}
    targets = {s: w for s, w in weights.items() if s in counts} if weights else {s: Fraction(n, sum(count.values())) for s, n in count.items()}
    slots = whole_slots(targets, frame) if targets else {}
    plan = schedule(slots) if slots else []
    length = len(plan)
    at = {(s, k): slot for s, k, slot, _, _ in plan}
    blocks = {s: count[s] for s in slots}
    slot_of = lambda s, b: b // slots[s] * length + at[s, b % slots[s]]
    ends = (slot_of(s, n) for s, n in blocks.items()) if weights else (slot_of(s, n - 1) + 1 for s, n in blocks.items())
    end = (min if weights else max)(ends, default=0)

    by_hash = F.xxhash64(order_id(id_col))
    parts = max(64, -(-max(counts.values(), default=0) // PART_ROWS))
    part = F.shiftrightunsigned(by_hash, 1) % F.lit(parts)
    numbered = df.select(F.struct("*").alias("row"), order_id(id_col).alias("_id"), source.alias("_source"), by_hash.alias("_hash"), part.alias("_part"))
    sizes = numbered.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_part").orderBy("_hash", "_id")
    rank = F.col("_offset") + F.row_number().over(inside) - 1
    share = spark.createDataFrame([(s, q) for s, q in slots.items()], "_source string, _q long")
    table = spark.createDataFrame(plan, "_source string, _k long, _at long, _from long, _to long")
    if length <= 1 << 20:  # rows of the frame: bounded by the parameter or 32 for each source
        share, table = F.broadcast(share), F.broadcast(table)
    turn = F.floor(F.col("_block") / F.col("_q")).cast("long") * length
    return (
        numbered.join(offsets, ["_source", "_part"])
        .withColumn("_rank", rank)
        .withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("long"))
        .withColumn("place", (F.col("_rank") % block_rows).cast("int"))
        .join(share, "_source", "left")
        .withColumn("_k", F.col("_block") % F.col("_q"))
        .join(table, ["_source", "_k"], "left")
        .select(
            "row",
            F.col("_block").alias("block"),
            "place",
            (turn + F.col("_at")).alias("slot"),
            (turn + F.col("_from")).alias("release"),
            (turn + F.col("_to")).alias("deadline"),
            F.coalesce(turn + F.col("_at") < end, F.lit(False)).alias("in_mix"),
        )
    )


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix, with the columns of ``df``, in the order of the mix."""
    return (
        mix(df, id_col, source_col, **how)
        .where("in_mix")
        .repartitionByRange("slot", "place")
        .sortWithinPartitions("slot", "place")
        .select("row.*")
    )
