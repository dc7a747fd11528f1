"""Katz backoff language model: Good-Turing discounted bigram counts with exactly
normalised backoff weights, in tables partitioned by word and by context.

    P(w | h) = d(r) r / c(h)          if r = c(h w) > 0
               alpha(h) P(w)          otherwise (alpha = 1 for an unseen h)
    P(w)     = (1 - u) c(w) / N       if c(w) > 0
               u                      otherwise: the mass of all unknown words

u = (n1 + 1/2) / (N + 1) is Turing's estimate.  Counts r up to 5 are discounted as
Katz does; larger ones, and those where the estimate leaves (0, 1), lose half an
occurrence, so every context has mass to give away and alpha(h) makes its
probabilities sum to one exactly.

One shuffle serves counting and lookup.  Every (previous word, word, document)
goes to the part of its word, where c(w) and c(h w) are complete: a token has one
predecessor.  As a token is also the context of its successor, c(h) is c of the
token itself.  Only alpha(h), wanted where a held-out document has an unseen
bigram, needs sums by context, which go to the part of the context in a second,
smaller shuffle.  Frequent words (at least 1 / (4 parts) of the tokens, so at most 4
times as many as parts, and the MOST_HOT most frequent of these) are counted beforehand and
spread over all parts.

Rows travel as packed columns, one for each group of documents and part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_of, materialise, order_id, small_batches, text_of
from .kernels import release, tidy

#: Bytes of text in a group of documents, and documents at most.
GROUP_BYTES = 4 << 20
GROUP_DOCS = 1 << 15
#: Counts up to this are discounted by Good-Turing.
DISCOUNTED = 5
#: Bytes of text in a part: about 1.2 million tokens.
PART_BYTES = 7_500_000
#: Words that are spread over all parts, at most.
MOST_HOT = 200_000
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_TRAIN = np.uint16(1 << 15)
_CONTEXT = np.uint64(16)  # contexts are known by the upper 48 bits of their hash


# --- packing -----------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        raw = zlib.compress(np.ascontiguousarray(a).tobytes(), 1)
        parts.append(np.array([len(raw)], "<u4").tobytes() + a.dtype.str[1:].encode() + raw)
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int(np.frombuffer(data, "<u4", 1, at)[0])
        kind = "<" + data[at + 4 : at + 6].decode()
        out.append(np.frombuffer(zlib.decompress(data[at + 6 : at + 6 + n]), kind))
        at += 6 + n
    return out


def _to_six(values: np.ndarray) -> np.ndarray:
    """48-bit values as byte planes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.copy().reshape(-1)


def _from_six(planes: np.ndarray) -> np.ndarray:
    n = len(planes) // 6
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = planes.reshape(6, n).T
    return out.reshape(-1).view("<u8")


def _runs(owner: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, positions) for each owner that there is; ``order`` sorts them."""
    held = owner[order]
    edges = np.flatnonzero(np.concatenate((np.ones(min(len(held), 1), bool), held[1:] != held[:-1], [True]))) if len(held) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(held[a]), order[a:b]


# --- tokens ------------------------------------------------------------------


def _groups(batches) -> Iterator[tuple[list, list[bool], list[np.ndarray]]]:
    """(ids, train flags, word hashes of each text) of groups of documents."""
    from .kernels import utf8_views, word_hashes

    ids, train, words, held = [], [], [], 0
    for batch in batches:
        flags, keys = batch.column("_train").to_pylist(), batch.column("_id").to_pylist()
        for i, data in enumerate(utf8_views(batch.column("_text"))):
            ids.append(keys[i])
            train.append(flags[i])
            words.append(word_hashes(data))
            held += len(data)
            if held >= GROUP_BYTES or len(ids) >= GROUP_DOCS:
                yield ids, train, words
                ids, train, words, held = [], [], [], 0
    if ids:
        yield ids, train, words


@tidy
def _frequent_batches(batches, share: float):
    """Words with at least ``share`` of a group's training tokens; token counts."""
    import pyarrow as pa

    total, docs = 0, 0
    for _, train, words in _groups(batches):
        taught = [w for w, t in zip(words, train, strict=True) if t]
        docs += len(taught)
        if taught:
            flat = np.concatenate(taught)
            total += len(flat)
            word, n = np.unique(flat, return_counts=True)
            top = n >= max(2, share * len(flat))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word[top].view(np.int64)), "n": pa.array(n[top].astype(np.int64))})
    yield pa.RecordBatch.from_pydict({"word": pa.array([None, None], pa.int64()), "n": pa.array([total, -docs], pa.int64())})


@tidy
def _count_batches(batches, hot: np.ndarray):
    import pyarrow as pa

    total = np.zeros(len(hot), np.int64)
    for _, train, words in _groups(batches):
        for w, t in zip(words, train, strict=True):
            if t and len(w) and len(hot):
                at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
                total += np.bincount(at[hot[at] == w], minlength=len(hot))
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(hot))), "n": pa.array(total)})


@tidy
def _send_batches(batches, hot: np.ndarray, parts: int):
    """Rows (part, group, kind, data): each group's bigrams by the part of the word."""
    import pyarrow as pa
    from pyspark import TaskContext

    from .kernels import mix

    task = TaskContext.get().partitionId()
    for number, (ids, train, words) in enumerate(_groups(batches)):
        group = (task << 32) | number
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        vocabulary, inverse = np.unique(np.concatenate((flat, [START, END])), return_inverse=True)
        start, end = inverse[-2], inverse[-1]
        rank = inverse[:-2]
        last = np.cumsum(sizes + 1) - 1  # where END stands
        n = len(flat) + len(words)
        is_end = np.zeros(n, bool)
        is_end[last] = True
        word = np.empty(n, np.int64)
        word[is_end], word[~is_end] = end, rank
        before = np.empty(n, np.int64)
        before[0], before[1:] = start, word[:-1]
        before[last[:-1] + 1] = start
        doc = np.repeat(np.arange(len(words)), sizes + 1)
        # One sort groups equal (word, context, document).
        bits_v, bits_d = int(len(vocabulary)).bit_length(), int(len(words)).bit_length()
        key = (word.astype(np.uint64) << np.uint64(bits_v + bits_d)) | (before.astype(np.uint64) << np.uint64(bits_d)) | doc.astype(np.uint64)
        key.sort()
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(begin, n))
        key = key[begin]
        doc = (key & np.uint64((1 << bits_d) - 1)).astype(np.uint16)
        context = vocabulary[((key >> np.uint64(bits_d)) & np.uint64((1 << bits_v) - 1)).astype(np.int64)]
        at = (key >> np.uint64(bits_v + bits_d)).astype(np.int64)
        is_hot = np.isin(vocabulary, hot)
        route = vocabulary[at]
        spread = is_hot[at]
        route[spread] = mix(route[spread] ^ mix(context[spread]))
        part = ((route >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        taught = np.array(train, bool)
        doc = doc | np.where(taught[doc], _TRAIN, np.uint16(0))
        out: dict[str, list] = {"part": [], "group": [], "kind": [], "data": []}
        for p, own in _runs(part, order):
            a = at[own]
            edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            runs = np.diff(np.append(edge, len(a))).astype(np.uint32)
            out["part"].append(p)
            out["kind"].append("rows")
            out["data"].append(
                _pack(vocabulary[a[edge]], runs, _to_six(context[own] >> _CONTEXT), doc[own], times[own].astype(np.uint32))
            )
        out["part"].append(int(mix(np.array([group], np.uint64))[0] % np.uint64(parts)))
        out["kind"].append("docs")
        out["data"].append(_pack(np.array(ids, np.int64), (sizes + 1).astype(np.int64), taught.astype(np.uint8)))
        out["group"] = [group] * len(out["part"])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("group", pa.int64()), ("kind", pa.string()), ("data", pa.binary())]))


# --- the part of a word ------------------------------------------------------

#: Rows that parts give: kind, key (part of a context or group) and packed columns.
_OUT = "kind string, key long, group long, data binary"


def _out(rows: list[tuple]):
    import pyarrow as pa

    kinds = [("kind", pa.string()), ("key", pa.int64()), ("group", pa.int64()), ("data", pa.binary())]
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.Table.from_pydict({k: pa.array(list(c), t) for (k, t), c in zip(kinds, columns, strict=True)}, schema=pa.schema(kinds))


def _split(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield from _runs(owner, np.argsort(owner, kind="stable"))


def _count_part(table, hot: np.ndarray, hot_counts: np.ndarray, parts: int):
    from .kernels import mix

    forwarded, blobs = [], []
    for group, kind, data in zip(table.column("group").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == "docs":
            forwarded.append(("docs", 0, group, data))
        else:
            blobs.append((group, _unpack(data)))
    release()
    if not blobs:
        return _out(forwarded)
    groups = [g for g, _ in blobs]
    names = np.concatenate([b[0] for _, b in blobs])
    runs = np.concatenate([b[1] for _, b in blobs])
    context = np.concatenate([_from_six(b[2]) for _, b in blobs])
    doc = np.concatenate([b[3] for _, b in blobs])
    times = np.concatenate([b[4] for _, b in blobs])
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b[3]) for _, b in blobs])
    del blobs
    taught = (doc & _TRAIN) > 0
    doc = (doc & ~_TRAIN).astype(np.int32)
    # Counts of words and bigrams in training documents.
    vocabulary, inverse = np.unique(names, return_inverse=True)
    word = np.repeat(inverse.astype(np.int32), runs)
    counted = times * taught
    of_word = np.bincount(word, counted, len(vocabulary)).astype(np.int64)
    at = np.minimum(np.searchsorted(hot, vocabulary), len(hot) - 1)
    is_hot = hot[at] == vocabulary
    of_word[is_hot] = hot_counts[at[is_hot]]
    _, first, bigram = np.unique(mix(vocabulary[word] ^ mix(context)), return_index=True, return_inverse=True)
    bigram = bigram.astype(np.int32)
    of_bigram = np.bincount(bigram, counted, len(first)).astype(np.int64)
    del counted
    cold = ~is_hot
    stats = [int((of_word[cold] > 0).sum()), int((of_word[cold] == 1).sum()), *[int((of_bigram == r).sum()) for r in range(1, DISCOUNTED + 2)]]
    rows = [*forwarded, ("stats", 0, 0, _pack(np.array(stats, np.int64)))]
    # What each document gets from here.
    c, r = of_word[word], of_bigram[bigram]
    known, seen = c > 0, r > 0
    with np.errstate(divide="ignore"):
        log_c = np.where(known, np.log10(np.maximum(c, 1)), 0.0)
        log_r = np.where(r > DISCOUNTED, np.log10(np.maximum(r, 1) - 0.5), np.log10(np.maximum(r, 1)))
    lm = np.where(seen, log_r, log_c) - np.where(vocabulary[word] == END, 0.0, log_c)
    del log_c, log_r
    slot, place = np.unique((owner.astype(np.int64) << 16) | doc, return_inverse=True)
    place = place.astype(np.int32)
    total = lambda x: np.bincount(place, x, len(slot))
    sums = [total(times * np.log10(c + 0.1)), total(times * lm)]
    numbers = [total(times * known), total(times * (~seen & known)), total(times * ~known)]
    numbers += [total(times * (r == k)) for k in range(1, DISCOUNTED + 1)]
    for k, own in _split(slot >> 16):
        rows.append(("sums", 0, groups[k], _pack((slot[own] & 0xFFFF).astype(np.uint16), *[s[own] for s in sums], *[x[own].astype(np.uint32) for x in numbers])))
    # The counts themselves, by context: what backoff weights are made of.
    kept = np.flatnonzero(of_bigram)
    h, into = np.unique(context[first[kept]], return_inverse=True)
    gather = lambda x: np.bincount(into, x, len(h)).astype(np.int64)
    r = of_bigram[kept]
    types = [gather(np.minimum(r, DISCOUNTED + 1) == k).astype(np.uint32) for k in range(1, DISCOUNTED + 2)]
    columns = [*types, gather(r), gather(of_word[word[first[kept]]])]
    for k, own in _split((h % np.uint64(parts)).astype(np.int64)):
        rows.append(("contexts", k, 0, _pack(_to_six(h[own]), *[x[own] for x in columns])))
    # Unseen bigrams: frequent contexts wait for their weight in the group, others go to the context.
    unseen = np.flatnonzero(~seen)
    hot_contexts = np.unique(hot >> _CONTEXT)
    where = np.minimum(np.searchsorted(hot_contexts, context[unseen]), len(hot_contexts) - 1)
    here = hot_contexts[where] == context[unseen]
    for k, own in _split(owner[unseen[here]]):
        x = unseen[here][own]
        rows.append(("waiting", 0, groups[k], _pack(_to_six(context[x]), doc[x].astype(np.uint16), times[x].astype(np.uint32))))
    rest = unseen[~here]
    group_ids = np.array(groups, np.int64)
    for k, own in _split((context[rest] % np.uint64(parts)).astype(np.int64)):
        x = rest[own]
        rows.append(("unseen", k, 0, _pack(_to_six(context[x]), group_ids[owner[x]], doc[x].astype(np.uint16), times[x].astype(np.uint32))))
    return _out(rows)


# --- the part of a context ---------------------------------------------------


def discounts(types: list[int]) -> list[float]:
    """d(1) ... d(5) from the numbers of bigrams seen once ... six times."""
    n = [0, *types]
    last = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 0.0
    out = []
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _weigh_part(table, hot: np.ndarray, model: dict):
    contexts, unseen = [], []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        (contexts if kind == "contexts" else unseen).append(_unpack(data))
    if not contexts:
        return _out([])
    columns = [np.concatenate(c) for c in zip(*contexts, strict=True)] if len(contexts) > 1 else contexts[0]
    name = np.concatenate([_from_six(c[0]) for c in contexts])
    h, into = np.unique(name, return_inverse=True)
    gather = lambda x: np.bincount(into, x, len(h))
    lost = np.zeros(len(h))
    for k in range(1, DISCOUNTED + 2):
        lost += gather(columns[k]) * (k * (1 - model["d"][k - 1]) if k <= DISCOUNTED else 0.5)
    total, successors = gather(columns[DISCOUNTED + 2]), gather(columns[DISCOUNTED + 3])
    free = 1 - (1 - model["u"]) * successors / model["n"]
    # log10(alpha(h) c(h)): documents have -log10 c(h) for every token already.
    weight = np.log10(lost / total / np.maximum(free, 1e-300)) + np.log10(total)
    rows = []
    hot_contexts = np.unique(hot >> _CONTEXT)
    own = np.isin(h, hot_contexts)
    if own.any():
        rows.append(("weights", 0, 0, _pack(h[own], weight[own])))
    if unseen:
        name = np.concatenate([_from_six(u[0]) for u in unseen])
        at = np.minimum(np.searchsorted(h, name), len(h) - 1)
        found = h[at] == name
        group, doc, times = (np.concatenate([u[k] for u in unseen])[found] for k in (1, 2, 3))
        value = times * weight[at[found]]
        groups, place = np.unique(group, return_inverse=True)
        for k, mine in _split(place):
            docs, into = np.unique(doc[mine], return_inverse=True)
            rows.append(("adds", 0, int(groups[k]), _pack(docs.astype(np.uint16), np.bincount(into, value[mine], len(docs)))))
    return _out(rows)


def _finish_group(table, model: dict):
    import pyarrow as pa

    by_kind: dict[str, list] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        by_kind.setdefault(kind, []).append(_unpack(data))
    (ids, n_tokens, taught), *_ = by_kind["docs"]
    size = len(ids)
    totals = [np.zeros(size) for _ in range(5 + DISCOUNTED)]
    for doc, *columns in by_kind.get("sums", []):
        for total, x in zip(totals, columns, strict=True):
            total[doc] += x
    base, score, known, backed, unknown, *small = totals
    for doc, x in by_kind.get("adds", []):
        score[doc] += x
    for context, doc, times in by_kind.get("waiting", []):
        name = _from_six(context)
        if len(model["hot"]):
            at = np.minimum(np.searchsorted(model["hot"], name), len(model["hot"]) - 1)
            found = model["hot"][at] == name
            score += np.bincount(doc[found], times[found] * model["weights"][at[found]], size)
    n, v, u = model["n"], model["v"], model["u"]
    score = score + sum(k * math.log10(d) for k, d in zip(small, model["d"], strict=True))
    score = score + backed * math.log10((1 - u) / max(n, 1)) + unknown * math.log10(u)
    if model["docs"]:
        score = score - math.log10(model["docs"])  # the context that begins a text
    return pa.Table.from_pydict(
        {
            "_id": pa.array(ids),
            "_train": pa.array(taught.astype(bool)),
            "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(np.rint(known).astype(np.int64)),
            "base_score": pa.array(base - n_tokens * math.log10(n + 0.1 * (v + 1))),
            "score": pa.array(score),
        }
    )


def score(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where the column ``train`` holds and score all rows.

    Returns id, trained, n_tokens, n_known, train_tokens, base_score, score (log10 of
    the text's probability), one row per input row.  Words are lower-cased (A-Z);
    every text, also a null or empty one, ends with one end token.

    A null id is ordered after all others; repeated rows count as often as they
    stand; other columns are ignored; an empty table gives an empty result; with
    nothing to learn from all words are unknown.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(order_id(id_col).alias("_id"), F.coalesce(train, F.lit(False)).alias("_train"), text_of(text_col).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    counted = materialise(
        rows.mapInArrow(lambda b: _frequent_batches(b, 1 / (4 * parts)), "word long, n long").groupBy("word", F.col("n") < 0).agg(F.sum("n").alias("n")).select("word", "n"),
        "frequent-words",
    )
    ends = {r["n"] < 0: r["n"] for r in counted.where("word IS NULL").collect()}
    n_docs = -ends.get(True, 0)
    n_tokens = ends.get(False, 0) + n_docs
    found = counted.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(min(4 * parts, MOST_HOT)).toArrow()
    hot = np.unique(np.concatenate((found.column("word").to_numpy().view(np.uint64), [START, END])))
    hot_counts = np.zeros(len(hot), np.int64)
    for at, n in rows.mapInArrow(lambda b: _count_batches(b, hot), "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        hot_counts[at] = n  # at most MOST_HOT + 2 rows
    hot_counts[hot == END] = n_docs
    shared = spark.sparkContext.broadcast((hot, hot_counts))
    sent = rows.mapInArrow(lambda b: _send_batches(b, shared.value[0], parts), "part int, group long, kind string, data binary")
    tables = materialise(sent.groupBy("part").applyInArrow(lambda t: _count_part(t, *shared.value, parts), _OUT), "katz-counts")
    stats = np.zeros(DISCOUNTED + 3, np.int64)
    for (data,) in tables.where("kind = 'stats'").select("data").collect():  # one row for each part
        stats += _unpack(data)[0]
    real = hot_counts[(hot != START)]
    v, n1 = int(stats[0] + (real > 0).sum()), int(stats[1] + (real == 1).sum())
    model = {"n": n_tokens, "v": v, "docs": n_docs, "u": (n1 + 0.5) / (n_tokens + 1), "d": discounts([int(x) for x in stats[2:]])}
    by_context = tables.where(F.col("kind").isin("contexts", "unseen")).groupBy("key")
    weighed = materialise(by_context.applyInArrow(lambda t: _weigh_part(t, shared.value[0], model), _OUT), "katz-weights")
    pairs = [_unpack(data) for (data,) in weighed.where("kind = 'weights'").select("data").collect()]  # of frequent words
    names = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
    order = np.argsort(names)
    model |= {"hot": names[order], "weights": (np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0))[order]}
    final = spark.sparkContext.broadcast(model)
    out = (
        tables.where(F.col("kind").isin("docs", "sums", "waiting"))
        .unionByName(weighed.where("kind = 'adds'"))
        .groupBy("group")
        .applyInArrow(lambda t: _finish_group(t, final.value), "_id long, _train boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return out.select(
        id_of(F.col("_id")).alias(id_col),
        F.col("_train").alias("trained"),
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def held_out_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """score() with the documents of fold 0 (crc32 of the id) held out."""
    out = score(df, fold(id_col, folds) != 0, id_col, text_col)
    return out.select(id_col, (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
