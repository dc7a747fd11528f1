"""Substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds, both of MIN_WORDS words or more:

* lines, compared by MinHash: BANDS bands of ROWS hashes of 5-word shingles find
  pairs of similarity 0.8 with a probability of 1 - (1 - 0.8^ROWS)^BANDS = 0.996 and
  pairs of 0.9 nearly surely; colliding lines are verified by exact Jaccard;
* windows of MIN_WORDS words, for passages inside other text.  Anchors are the runs of
  ANCHOR words whose hash is the smallest of some REACH successive ones, so two
  texts that share ANCHOR + REACH - 1 = 23 words share an anchor.  Windows begin
  at the anchors that two documents have and, where the words around an anchor are
  not the same everywhere, at each word near it: a passage of 23 words or more is
  covered from its first word to its last.  They find exact repeats;
* bridges, for passages inside other text that were edited: stretches of two texts
  from one exact repeat of MIN_WORDS words or more to another, of which the Jaccard
  similarity of 5-word shingles is 0.8 or more by the repeats alone.

Equal paragraphs are one node.  Verified links join nodes into components; a
component that occurs in two documents or more is a cluster.  Its first
occurrence, by id and position, stays; the others are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_of, materialise, order_id, small_batches, text_of, written
from .kernels import tidy
from .linking import connected_components, links

MIN_WORDS = 20
ANCHOR, REACH = 10, 14
SHINGLE = 5
BANDS, ROWS = 14, 5
PERCENT = 80
#: Bits of the filters on paragraph hashes (8 MB).
NODE_BITS = 26
#: Bytes of text that are worked on together; a longer text is by itself.
GROUP_BYTES = 1 << 20
#: Rows of an Arrow batch.
OUT_ROWS = 50_000
#: Runs that are looked at one by one without finding anything new, before all are looked at together.
IN_VAIN = 4
#: Hashes that are made at once.
MATRIX = 1 << 16

_PRIME = np.uint64(0x9E3779B97F4A7C15)


_table: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the prime and of its inverse; kept, and made anew only when more are asked for."""
    if not _table or len(_table[0]) <= n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            steps = np.full(size, _PRIME), np.full(size, np.uint64(pow(int(_PRIME), -1, 1 << 64)))
            _table[:] = [np.cumprod(np.concatenate(([np.uint64(1)], x)), dtype=np.uint64) for x in steps]
    return _table[0], _table[1]


class Group:
    """Words of some texts in a row, text by text.

    ids and first (the number of the first word, one more than texts) by text; words: their
    hashes; line_start and line_stop: words of the lines of MIN_WORDS words or more.
    """

    def __init__(self, ids: list[int], texts: list[np.ndarray]) -> None:
        from .kernels import spaces, word_hashes

        newline = np.array([10], np.uint8)
        data = np.concatenate([x for t in texts for x in (t, newline)])
        space = spaces(data)
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.ids = np.array(ids, np.int64)
        self.first = np.concatenate(([0], np.searchsorted(begins, ends)))
        self.words = word_hashes(data)
        edges = np.concatenate(([0], np.searchsorted(begins, np.flatnonzero(data == 10))))
        long = np.diff(edges) >= MIN_WORDS
        self.line_start, self.line_stop = edges[:-1][long], edges[1:][long]
        self.up, self.down = _powers(len(self.words))
        with np.errstate(over="ignore"):
            self.total = np.concatenate(([np.uint64(0)], np.cumsum(self.words * self.up[: len(self.words)], dtype=np.uint64)))

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The number of the text that a word is in."""
        return np.searchsorted(self.first, word, side="right") - 1

    def digests(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the word runs [start, stop)."""
        from .kernels import mix

        with np.errstate(over="ignore"):
            return mix((self.total[stop] - self.total[start]) * self.down[start] ^ (stop - start).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the anchors, in order, their hashes, and their texts.

        The smallest of each REACH successive runs of one text are anchors.
        """
        n = len(self.words) - ANCHOR + 1
        if n < REACH:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        start = np.arange(n)
        value = self.digests(start, start + ANCHOR)
        least = _slide(value, np.minimum)
        # Windows of REACH runs that one text holds whole.
        left = np.repeat(self.first[1:], np.diff(self.first))[: len(least)] - start[: len(least)]
        least[left < ANCHOR + REACH - 1] = 0
        edge = np.zeros(REACH - 1, np.uint64)
        top = _slide(np.concatenate((edge, least, edge)), np.maximum)
        at = np.flatnonzero((top == value) & (top > 0))
        return at, value[at], self.text_of(at)


def _slide(x: np.ndarray, of) -> np.ndarray:
    """Minimum or maximum of each REACH successive values."""
    width = 1
    while 2 * width <= REACH:
        x = of(x[:-width], x[width:])
        width *= 2
    rest = REACH - width
    return of(x[:-rest], x[rest:]) if rest else x


def window_starts(first: np.ndarray, stop: np.ndarray, at: np.ndarray, shared: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where windows begin: at shared anchors and, for those that may be the first or last of a
    passage, wherever the passage may begin or its last window may.  first and stop: of the
    anchors' texts."""
    near = at[ends][:, None] + np.arange(1 - REACH, MIN_WORDS)
    low, high = first[ends][:, None], np.minimum(at[ends] + ANCHOR + REACH - 1, stop[ends])[:, None] - MIN_WORDS
    inside = at[shared]
    inside = inside[inside <= stop[shared] - MIN_WORDS]
    return np.unique(np.concatenate((inside, near[(near >= low) & (near <= high)])))


def _groups(batches):
    from .kernels import utf8_views

    ids, texts, held = [], [], 0
    for batch in batches:
        for key, data in zip(batch.column("_id").to_pylist(), utf8_views(batch.column("_text")), strict=True):
            if texts and held + len(data) > GROUP_BYTES:
                yield Group(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(key)
            texts.append(data)
            held += len(data)
    if texts:
        yield Group(ids, texts)


def _rows_of(columns: dict[str, np.ndarray]):
    """Arrow batches of equal columns, OUT_ROWS rows each."""
    import pyarrow as pa

    n = len(next(iter(columns.values())))
    for lo in range(0, n, OUT_ROWS):
        part = {k: x[lo : lo + OUT_ROWS] for k, x in columns.items()}
        yield pa.RecordBatch.from_pydict({k: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for k, x in part.items()})


@tidy
def _anchor_batches(batches):
    """(node, id, around) of all anchors: a hash of the words from the anchor before to the next one."""
    from .kernels import mix

    for group in _groups(batches):
        at, node, text = group.anchors()
        if not len(at):
            continue
        between = group.digests(at[:-1], at[1:] + ANCHOR)
        between[text[1:] != text[:-1]] = 0  # of two texts
        edge = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            around = mix(np.concatenate((edge, between)) * _PRIME + np.concatenate((between, edge)))
        yield from _rows_of({"node": node, "id": group.ids[text], "around": around})


def _maybe(wanted, node: np.ndarray) -> np.ndarray:
    at = (node >> np.uint64(64 - NODE_BITS)).astype(np.int64)
    return (wanted.value[at >> 6] >> (at & 63)) & 1 > 0


@tidy
def _unit_batches(batches, repeated, varied):
    """(node, id, start, stop) of all lines and of the windows around repeated anchors."""
    for group in _groups(batches):
        start, stop = group.line_start, group.line_stop
        at, node, text = group.anchors()
        if len(at):
            shared, ends = _maybe(repeated, node), _maybe(varied, node)
            ends |= np.concatenate(([True], text[1:] != text[:-1])) | np.concatenate((text[1:] != text[:-1], [True]))  # first and last of a text
            own = window_starts(group.first[text], group.first[text + 1], at, shared, shared & ends)
            start, stop = np.concatenate((start, own)), np.concatenate((stop, own + MIN_WORDS))
        if len(start):
            of = group.text_of(start)
            begun = group.first[of]
            yield from _rows_of({"node": group.digests(start, stop), "id": group.ids[of], "start": (start - begun).astype(np.int32), "stop": (stop - begun).astype(np.int32)})


@tidy
def _band_batches(batches):
    """(token, id) for each band of each distinct line of a group of documents."""
    from .kernels import mix, shingle_hashes

    numbers = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _PRIME)
    factor, shift = (numbers[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (numbers[1::2] >> np.uint64(32)).astype(np.uint32)

    for group in _groups(batches):
        if not len(group.line_start):
            continue
        flat = (shingle_hashes(group.words, SHINGLE) >> np.uint64(32)).astype(np.uint32)
        node, first = np.unique(group.digests(group.line_start, group.line_stop), return_index=True)
        start, stop = group.line_start[first], group.line_stop[first] - SHINGLE + 1
        order = np.argsort(stop - start, kind="stable")  # lines of about one length make a matrix
        least = np.empty((BANDS * ROWS, len(node)), np.uint32)
        lo = 0
        while lo < len(order):
            width = int(stop[order[lo]] - start[order[lo]])
            wide = width + max(4, width // 8)
            hi = lo + int(np.searchsorted((stop - start)[order[lo:]], wide, side="right"))
            hi = min(hi, lo + max(1, MATRIX // wide))
            own = order[lo:hi]
            size = stop[own] - start[own]
            rows = np.minimum(np.arange(int(size.max()))[:, None], size - 1)
            matrix = flat[start[own] + rows]
            hashed = np.empty_like(matrix)
            for k in range(BANDS * ROWS):
                np.multiply(matrix, factor[k], out=hashed)
                hashed += shift[k]
                least[k, own] = hashed.min(axis=0)
            lo = hi
        for b in range(BANDS):
            with np.errstate(over="ignore"):
                token = np.full(len(node), b, np.uint64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    token = mix(token * _PRIME + least[k])
            yield from _rows_of({"token": token, "id": node})


@tidy
def _set_batches(batches, wanted):
    """(id, items): shingle sets of the lines whose node may be wanted."""
    import pyarrow as pa

    from .kernels import shingle_hashes

    found: dict[int, np.ndarray] = {}

    def flush():
        out = pa.RecordBatch.from_pydict(
            {"id": pa.array(list(found), pa.int64()), "items": pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64()))}
        )
        found.clear()
        return out

    for group in _groups(batches):
        start, stop = group.line_start, group.line_stop
        node = group.digests(start, stop)
        some = np.flatnonzero(_maybe(wanted, node)) if len(node) else node
        flat = shingle_hashes(group.words, SHINGLE) if len(some) else node
        for key, a, b in zip(node[some].view(np.int64).tolist(), start[some].tolist(), (stop[some] - SHINGLE + 1).tolist(), strict=True):
            if key not in found:
                found[key] = np.unique(flat[a:b])
        if len(found) > 5000:
            yield flush()
    if found:
        yield flush()


def _node_bits(nodes: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of the upper NODE_BITS bits of the nodes, as 64-bit words."""
    at = F.shiftrightunsigned(F.col(column), 64 - NODE_BITS).alias("_at")
    words = (
        nodes.select(at)
        .groupBy(F.shiftright("_at", 6).cast("int").alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
        .toArrow()  # at most 2^NODE_BITS / 64 rows
    )
    out = np.zeros((1 << NODE_BITS) // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _node_filter(nodes: DataFrame, column: str):
    return nodes.sparkSession.sparkContext.broadcast(_node_bits(nodes, column))


def _where_maybe(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows of which the column's value has its bit in _node_bits()."""
    import pyarrow as pa

    words = pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))
    filter_ = rows.sparkSession.createDataFrame(pa.table({"_bits": words}))  # one row, that all rows meet
    at = F.shiftrightunsigned(F.col(column), 64 - NODE_BITS)
    word = F.get("_bits", F.shiftright(at, 6).cast("int"))
    bit = F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return rows.crossJoin(F.broadcast(filter_)).where(bit == 1).select(*rows.columns)


def _stars(postings: DataFrame) -> DataFrame:
    return postings.select(F.col("id").alias("a"), (-F.col("hub.minus")).alias("b")).distinct()


def _pairs_between(sets: DataFrame):
    """Candidate pairs of different components, of lines that collide with a line of another one.

    Two sets of similarity PERCENT share one of their rarest shingles: of n, the first
    n - need + 1 in a common order, where need is what the pair must share.  So variants
    of one line that all differ by too much meet nowhere, however many they are.
    """

    def pairs(postings: DataFrame) -> DataFrame:
        ids = postings.select("id", "component").distinct()
        items = sets.join(ids, "id").select("id", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
        often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("often", "item"))
        first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
        rare = items.join(often, "item").withColumn("rank", rank).where((F.col("rank") <= first) & (F.col("often") > 1))
        x = rare.select("item", *[F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "rank")])
        y = rare.select("item", *[F.col(c).alias(f"y_{c}") for c in ("id", "component", "n", "rank")])
        need = F.ceil((F.col("x_n") + F.col("y_n")) * PERCENT / (100 + PERCENT))
        close = (
            (F.col("x_component") < F.col("y_component"))
            & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * PERCENT)
            & (F.col("x_rank") <= F.col("x_n") - need + 1)
            & (F.col("y_rank") <= F.col("y_n") - need + 1)
        )
        return x.join(y, "item").where(close).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()

    return pairs


def similar_lines(rows: DataFrame) -> DataFrame:
    """(node, component) of lines that are similar to another, unequal line."""
    bands = materialise(rows.mapInArrow(_band_batches, "token long, id long"), "bands")
    listed = bands.groupBy("token").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count(F.lit(1)).alias("listed"))
    listed = materialise(listed.where("_low <> _high").select("token", "listed"), "paragraph-tokens")
    # Most bands are in no list: they are left out before the rest meet by their tokens.
    postings = _where_maybe(bands, "token", _node_bits(listed, "token")).join(listed, "token").distinct()
    # The line that collides most is the hub of all its lists, so each line meets few hubs.
    postings = postings.withColumn("weight", F.sum("listed").over(Window.partitionBy("id")))
    postings = materialise(postings.select("token", "id", "weight"), "paragraph-bands")
    ids = postings.select("id").distinct()
    wanted = _node_filter(ids, "id")
    sets = rows.mapInArrow(lambda batches: _set_batches(batches, wanted), "id long, items array<long>")
    sets = materialise(sets.join(ids, "id", "left_semi").groupBy("id").agg(F.first("items").alias("items")), "paragraph-sets")
    return connected_components(links(postings, _stars, _pairs_between(sets), lambda _: sets, PERCENT, 100))


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of paragraphs in clusters and ends of bridges: _id, start, stop (words),
    removed, keep_id (where the occurrence is that stays).  Paragraphs that meet and are kept in
    the same document are one stretch."""
    small_batches(df.sparkSession)
    rows = df.select(order_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    begun = written()
    found = rows.mapInArrow(_anchor_batches, "node long, id long, around long").groupBy("node")
    found = found.agg(*[f(c).alias(f"{n}_{c}") for c in ("id", "around") for n, f in (("low", F.min), ("high", F.max))])
    same = F.col("low_around") == F.col("high_around")
    found = materialise(found.where("low_id <> high_id").select("node", same.alias("same")), "repeated-anchors")
    shared, varied = _node_filter(found, "node"), _node_filter(found.where("NOT same"), "node")
    units = rows.mapInArrow(lambda batches: _unit_batches(batches, shared, varied), "node long, id long, start int, stop int")
    units = materialise(units, "paragraph-units")
    discard(begun, units)
    repeated = units.groupBy("node").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low <> _high").select("node")
    repeated = materialise(repeated, "repeated-paragraphs")
    labels = repeated.join(similar_lines(rows), "node", "full").select("node", F.coalesce("component", "node").alias("cluster"))
    labels = materialise(labels, "paragraph-labels")
    discard(begun, units, labels)
    members = materialise(units.join(labels, "node").select("cluster", "node", F.col("id").alias("_id"), "start", "stop"), "paragraph-members")
    discard(begun, members)
    stays = (
        members.groupBy("cluster")
        .agg(F.min(F.struct("_id", "start", "node")).alias("_keep"), F.max("_id").alias("_last"))
        .where("_keep._id <> _last")
        .select("cluster", F.col("_keep._id").alias("keep_id"), F.col("_keep.start").alias("keep_start"), F.col("_keep.node").alias("keep_node"))
    )
    removed = (F.col("_id") != F.col("keep_id")) | (F.col("start") != F.col("keep_start"))
    found = materialise(members.join(stays, "cluster").withColumn("removed", removed), "paragraph-units-kept")
    discard(begun, found)
    exact = (F.col("node") == F.col("keep_node")) & (F.col("_id") != F.col("keep_id"))
    rows = found.select("_id", "keep_id", "removed", "start", "stop", F.when(exact, F.col("keep_start")).otherwise(-1).alias("keep_start"))
    sorted_ = rows.repartition("_id").sortWithinPartitions("_id", "keep_id")
    return sorted_.mapInArrow(_stretch_batches, "_id long, start int, stop int, removed boolean, keep_id long")


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, stop, first member) of the intervals of each owner, those that meet joined."""
    if not len(owner):
        return owner, start, stop, owner
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    apart = int(stop.max()) + 2  # owners never meet
    at = np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1]))) * apart
    reach = np.maximum.accumulate(stop + at)
    begins = np.flatnonzero(np.concatenate(([True], (start + at)[1:] > reach[:-1])))
    last = np.concatenate((begins[1:], [len(owner)])) - 1
    return owner[begins], start[begins], (reach - at)[last], order[begins]


def exact_runs(pair: np.ndarray, start: np.ndarray, stop: np.ndarray, keep_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, start, stop, keep_start), in order, of repeats; those of a pair that meet at one offset are joined."""
    offset = start.astype(np.int64) - keep_start
    least = offset.min(initial=0)
    span = int(offset.max(initial=0) - least) + 1
    of, begin, end, _ = merged(pair * span + (offset - least), start, stop)
    pair, keep_start = of // span, begin - (of % span + least)
    order = np.lexsort((keep_start, end, begin, pair))
    return pair[order], begin[order], end[order], keep_start[order]


def bridges(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, stop, keep_start, keep_stop): from each run as far as the similarity holds."""
    out = []
    rest = [0]  # words of all runs from each one on
    for start, stop, _ in reversed(runs):
        rest.append(rest[-1] + stop - start)
    rest.reverse()
    if len(runs) > IN_VAIN:
        begins, ends, others = np.array(runs, np.int64).T.copy()
        keep_ends = others + (ends - begins)
    for i, (start, stop, keep_start) in enumerate(runs):
        keep_stop = keep_start + stop - start
        shared, best = stop - start - SHINGLE + 1, None
        every = shared
        j, passed = i + 1, 0
        while j < len(runs):
            if (shared + rest[j]) * 100 < (every + rest[j]) * PERCENT:  # not even with all that follows
                break
            begin, end, other = runs[j]
            over = max(0, stop - begin, keep_stop - other)
            j += 1
            if end - begin - over < SHINGLE:  # another order, or nothing new
                passed += 1
                if passed > IN_VAIN and j < len(runs):  # a text that repeats itself: on to the next run with something new
                    new = (ends[j:] - stop >= SHINGLE) & (keep_ends[j:] - keep_stop >= SHINGLE)
                    at = int(new.argmax())
                    j = j + at if new[at] else len(runs)
                continue
            passed = 0
            shared += end - begin - over - SHINGLE + 1
            stop, keep_stop = end, other + end - begin
            every = (stop - start) + (keep_stop - keep_start) - 2 * (SHINGLE - 1) - shared
            if shared * 100 >= every * PERCENT:
                best = (start, stop, keep_start, keep_stop)
        if best:
            out.append(best)
    return out


def _whole_documents(batches):
    """Columns of sorted batches, some OUT_ROWS rows together, cut where the first column changes: a document
    is never in two of them."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        columns = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        if not len(columns[0]):
            continue
        held.append(columns)
        n += len(columns[0])
        if n >= OUT_ROWS and held[0][0][0] != columns[0][-1]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            yield [c[:last] for c in columns]
            held, n = [[c[last:] for c in columns]], n - last
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


@tidy
def _stretch_batches(batches):
    """Paragraphs (_id, keep_id, removed, start, stop, keep_start; sorted) to stretches, and bridges between
    exact repeats, which have a keep_start."""
    import pyarrow as pa

    for key, keep, removed, start, stop, keep_start in _whole_documents(batches):
        pair = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (keep[1:] != keep[:-1]))))
        of, begin, end, member = merged(pair * 2 + removed, start, stop)
        out = [key[member], begin, end, removed[member], keep[member]]
        rows = []
        exact = keep_start >= 0
        pairs, *runs = exact_runs(pair[exact], start[exact], stop[exact], keep_start[exact])
        first, sizes = np.unique(pairs, return_index=True, return_counts=True)[1:]
        at = np.searchsorted(pair, pairs[first])
        for a, size, i in zip(first.tolist(), sizes.tolist(), at.tolist(), strict=True):
            if size < 2:
                continue
            for x, y, u, v in bridges(list(zip(*(c[a : a + size].tolist() for c in runs), strict=True))):
                rows += [(key[i], x, y, True, keep[i]), (keep[i], u, v, False, keep[i])]
        if rows:
            out = [np.concatenate((c, np.array(more, c.dtype))) for c, more in zip(out, zip(*rows, strict=True), strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["_id", "start", "stop", "removed", "keep_id"])


@tidy
def _report_batches(batches):
    import pyarrow as pa

    for batch in batches:
        n, lists = len(batch), batch.column("units")
        edges, flat = lists.offsets.to_numpy(), lists.values
        lo, hi = edges[0], edges[-1]
        row = np.repeat(np.arange(n), np.diff(edges))
        start, stop, keep = (flat.field(k).to_numpy()[lo:hi] for k in ("start", "stop", "keep_id"))
        removed = np.asarray(flat.field("removed").to_numpy(zero_copy_only=False)[lo:hi], bool)
        columns = [batch.column("_id")]
        texts = []
        for some in (slice(None), removed):
            of, begin, end, _ = merged(row[some], start[some], stop[some])
            columns.append(pa.array(np.bincount(of, end - begin, n).astype(np.int64)))
            cuts = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            names = [f"{a}:{b}" for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            texts.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(names, pa.string())))
        order = np.lexsort((keep, row))
        new = np.concatenate(([True], (row[order][1:] != row[order][:-1]) | (keep[order][1:] != keep[order][:-1]))) if len(row) else np.empty(0, bool)
        kept = order[new] if len(row) else order
        cuts = np.searchsorted(row[kept], np.arange(n + 1)).astype(np.int32)
        texts.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(keep[kept])))
        yield pa.RecordBatch.from_arrays([*columns, *texts], names=["_id", "n_repeated", "n_removed", "spans", "removed_spans", "kept_in"])


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a repeated paragraph; other documents have none.

    id, n_repeated and n_removed (words), spans and removed_spans (start:stop in
    words, overlapping ones merged), kept_in (ids of the documents where the first
    occurrences stay).

    Null and empty texts have no paragraphs; a null id is ordered after all
    others and comes back as null; rows that share an id are one document, so
    copies among them alone are no repeats; other columns are ignored; an empty
    table gives an empty result.
    """
    unit = F.struct("start", "stop", "removed", "keep_id")
    found = clusters(df, id_col, text_col).groupBy("_id").agg(F.collect_set(unit).alias("units"))
    schema = "_id long, n_repeated long, n_removed long, spans array<string>, removed_spans array<string>, kept_in array<long>"
    out = found.mapInArrow(_report_batches, schema)
    return out.select(
        id_of(F.col("_id")).alias(id_col),
        *out.columns[1:-1],
        F.transform("kept_in", lambda x: id_of(x)).alias("kept_in"),
    )
