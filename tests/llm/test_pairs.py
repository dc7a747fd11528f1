"""Operators that compare documents, against brute force."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import exact_dedup, fingerprint, kernels, line_dedup, linking, ngram_join, paragraphs

LAST = (1 << 63) - 1
SPACES = " \t\n\x0b\f\r"


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size, percent):
    nodes = [(LAST if i is None else i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(nodes):
        for b, t in nodes[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_similar_sets(documents, size, percent):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = components(rows, size, percent)
    got = ngram_join.similar_sets(documents, size=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        i = LAST if r.doc_id is None else r.doc_id
        assert (LAST if r.component_id is None else r.component_id) == want[i]
    sets = [shingles(t, size) for _, t in rows]
    linked = [sum(bool(s and t and 100 * len(s & t) >= percent * len(s | t)) for t in sets) - bool(s) for s in sets]
    # Rows of one id with other texts are one node; their links are their own.
    assert collections.Counter((i, n) for (i, _), n in zip(rows, linked, strict=True)) == collections.Counter((r.doc_id, r.n_links) for r in got)
    sizes = collections.Counter((i, len(shingles(t, size))) for i, t in rows)
    assert sizes == collections.Counter((r.doc_id, r.n_shingles) for r in got)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.similar_sets(df, size=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == components(rows, 4, 85)
    sets = {i: shingles(t, 4) for i, t in rows}
    links = {i: sum(100 * len(s & t) >= 85 * len(s | t) for t in sets.values()) - 1 for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in found} == links and len(rows) > linking.BLOCK


def test_one_of_each(documents, nothing):
    kept = ngram_join.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {200, 201, 202, 203, 206} <= ids and 205 not in ids and None not in ids
    assert ngram_join.one_of_each(nothing).count() == 0
    assert ngram_join.similar_sets(nothing).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 9), (20, 21), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in linking.connected_components(edges).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 2, 9: 2, 20: 20, 21: 20}


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[t.translate({ord(c): None for c in SPACES})].append((-len(t), LAST if i is None else i))
    return {norm: (min(m)[1], len(m)) for norm, m in groups.items()}


@pytest.mark.parametrize("bits", [128, 2])
def test_exact_groups(documents, bits):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(4))
    got = exact_dedup.exact_groups(documents, hash_fn=exact_dedup.content_hash if bits == 128 else weak).collect()
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    import hashlib

    want = collections.Counter()
    groups = exact(rows)
    for i, t in rows:
        norm = (t or "").translate({ord(c): None for c in SPACES})
        keep, n = groups[norm]
        want[i, keep, n, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert want == collections.Counter((r.doc_id, LAST if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got)
    assert {r.doc_id for r in got if r.kept} >= {203, 205}


def test_drop_copies(documents, nothing):
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 not in ids and 205 in ids and 202 in ids and 200 not in ids
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_line_dedup(documents, nothing):
    rows = [(LAST if r.doc_id is None else r.doc_id, r.text or "") for r in documents.collect()]
    key = lambda x: lower(x.strip(SPACES))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    want = collections.Counter()
    for i, t in rows:
        lines = t.split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    got = line_dedup.drop_lines(documents).collect()
    assert want == collections.Counter((LAST if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got)
    assert line_dedup.drop_lines(nothing).count() == 0


def test_line_dedup_with_hot_line(spark):
    rows = [(i, f"the one hot line\nline number {i} alone\nThe one hot line ") for i in range(400)]
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0
    assert all(got[i].n_dropped == 2 and got[i].text == f"line number {i} alone" for i in range(1, 400))
    assert got[5].drops == [(0, 0b101)]


def test_fingerprints(documents, nothing, prose):
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(documents).collect()}
    assert got[200] == got[201] == got[202] == ""
    assert got[0] == got[204] == got[205] and len(got[0]) == 2 * fingerprint.BINS
    pairs = fingerprint.edited_pairs(documents).orderBy(F.col("doc_id").asc_nulls_last(), "n_chars").collect()
    texts = sorted(((LAST if r.doc_id is None else r.doc_id, r.text or "") for r in documents.collect()))
    errors = []
    for k, (r, (i, t)) in enumerate(zip(pairs, texts, strict=True)):
        after, cut = texts[(k + 1) % len(texts)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (r.n_chars, r.edited) == (len(t), edited)
        a, b, c = shingles(t, 5), shingles(edited, 5), shingles(after, 5)
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        if len(a) > 60:
            errors += [r.near_edited - jaccard(a, b), r.near_next - jaccard(a, c)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.25
    assert fingerprint.edited_pairs(nothing).count() == 0


def test_paragraphs(documents, nothing):
    rows = [(i, r.text or "") for r in documents.collect() if (i := r.doc_id) is not None]
    windows = collections.defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 50):
            windows[tuple(w[k : k + 51])].add(i)
    planted = {i for v in windows.values() if len(v) > 1 for i in v}
    found = paragraphs.repeats(documents).collect()
    got = {r.doc_id for r in found}
    assert len(planted - got) <= 0.03 * len(planted)
    shared = collections.defaultdict(set)
    for i, t in rows:
        for s in shingles(t, 10):
            shared[s].add(i)
    assert all(any(len(shared[s]) > 1 for s in shingles(dict(rows)[i], 10)) for i in got - {None})
    first = min((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id)
    assert first.n_removed == 0 and first.kept_in == [first.doc_id]
    assert paragraphs.repeats(nothing).count() == 0


def test_similar_lines(spark):
    rng = random.Random(5)
    line = [f"t{rng.randrange(1000)}" for _ in range(60)]
    near = line[:30] + ["other"] + line[31:]
    df = spark.createDataFrame([(1, " ".join(line)), (2, "start\n" + " ".join(near)), (3, " ".join(line[::-1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in paragraphs.repeats(df).collect()}
    assert set(got) == {1, 2} and got[2].n_removed == 60 and got[1].n_removed == 0


def test_passages_inside_text(spark):
    """Every passage of 51 words or more is found, from its first word to its last."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(400):
        passage, long = fresh(n := 51 + k % 10), k % 3 != 2
        for i in (2 * k, 2 * k + 1):
            before = rng.choice([0, rng.randrange(30, 90)])  # too much for similar lines
            text = fresh(before) + passage + fresh(rng.choice([0, rng.randrange(30, 90)]))
            rows.append((i, " ".join(text) if long else "\n".join(" ".join(text[j : j + 7]) for j in range(0, len(text), 7))))
            want[i] = [f"{before}:{before + n}"]
    got = {r.doc_id: r for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.spans for i, r in got.items()} == want
    assert all(r.removed_spans == (want[i] if i % 2 else []) and r.kept_in == [i - i % 2] for i, r in got.items())


def test_edited_passages_inside_text(spark):
    """A passage of 60 words with one edit in its middle, in a long line or in short ones, is one repeat."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want, gone = [], {}, {}
    for k in range(200):
        passage = fresh(60)
        edit = {0: ["edit"], 1: [], 2: ["edit", passage[30]]}[k % 3]
        for i, text in ((2 * k, passage), (2 * k + 1, passage[:30] + edit + passage[31:])):
            before, n = rng.randrange(30, 90), len(text)
            text = fresh(before) + text + fresh(rng.randrange(30, 90))
            rows.append((i, " ".join(text) if k % 2 else "\n".join(" ".join(text[j : j + 9]) for j in range(0, len(text), 9))))
            want[i], gone[i] = [f"{before}:{before + n}"], n if i % 2 else 0
    got = {r.doc_id: r for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.spans for i, r in got.items()} == want
    assert {i: r.n_removed for i, r in got.items()} == gone


def test_bridges():
    assert paragraphs.bridges([(0, 30, 100), (31, 60, 131)]) == [(0, 60, 100, 160)]
    assert paragraphs.bridges([(0, 20, 100), (21, 41, 121)]) == []  # 32 of 42 shingles
    assert paragraphs.bridges([(0, 20, 100), (21, 41, 121), (42, 142, 142)]) == [(0, 142, 100, 242), (21, 142, 121, 242)]
    assert paragraphs.bridges([(0, 30, 100), (31, 60, 50)]) == []


def plain_bridges(runs):
    """As paragraphs.bridges, run by run."""
    out = []
    for i, (start, stop, keep_start) in enumerate(runs):
        keep_stop, shared, best = keep_start + stop - start, stop - start - 4, None
        for begin, end, other in runs[i + 1 :]:
            new = end - begin - max(0, stop - begin, keep_stop - other)
            if new >= 5:
                shared, stop, keep_stop = shared + new - 4, end, other + end - begin
                if 10 * shared >= 8 * (stop - start + keep_stop - keep_start - 8 - shared):
                    best = (start, stop, keep_start, keep_stop)
        if best:
            out.append(best)
    return out


def test_bridges_run_by_run():
    rng = random.Random(13)
    for _ in range(300):
        runs, far = [], rng.choice([40, 400, 4000])
        for _ in range(rng.randrange(40)):
            start, n = rng.randrange(far), rng.choice([20, 20, 21, 25, 60])
            runs.append((start, start + n, max(0, start + rng.choice([0, 0, 0, 1, -2, -30, 50]))))
        runs.sort()
        assert paragraphs.bridges(runs) == plain_bridges(runs)


def test_bridges_of_a_text_that_repeats_itself():
    """20,000 runs that all repeat one passage: their pairs are not gone through one by one (which took half a minute)."""
    began = time.process_time()
    n = 20_000
    got = paragraphs.bridges([(k, k + 20, 7) for k in range(n)] + [(n + 19, n + 79, 27)])
    assert got == [(k, n + 79, 7, 87) for k in range(n - 11, n)]  # 72 of up to 90 shingles
    assert time.process_time() - began < 10


def test_runs_of_many_pairs():
    pair, start, keep = (np.array(x) for x in ([0, 0, 0, 1, 1, 5], [0, 10, 40, 40, 0, 7], [100, 110, 90, 90, 3, 0]))
    got = paragraphs.exact_runs(pair, start, start + 20, keep)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(0, 0, 30, 100), (0, 40, 60, 90), (1, 0, 20, 3), (1, 40, 60, 90), (5, 7, 27, 0)]
    assert [len(x) for x in paragraphs.exact_runs(*[np.empty(0, np.int64)] * 4)] == [0] * 4


def test_whole_documents_of_batches():
    """Batches are taken together, but a document is never in two of the parts."""
    for most in (1, 7, 50, 10**6):
        key = np.sort(np.random.default_rng(most).integers(0, 30, 400))
        batches = [pa.RecordBatch.from_pydict({"_id": key[k : k + 9], "at": np.arange(k, min(k + 9, 400))}) for k in range(0, 400, 9)]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(paragraphs, "OUT_ROWS", most)
            parts = list(paragraphs._whole_documents(iter(batches)))
        assert np.concatenate([x for x, _ in parts]).tolist() == key.tolist() and np.concatenate([x for _, x in parts]).tolist() == list(range(400))
        assert all(a[-1] < b[0] for (a, _), (b, _) in zip(parts[:-1], parts[1:], strict=True))
        assert len(parts) == 1 if most > 400 else len(parts) > 1


def test_node_filter_on_rows(spark):
    """Rows whose bit is set stay, whatever the sign of their node; few others do."""
    rng = random.Random(14)
    nodes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(2000)] + [-1, 0, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(x,) for x in nodes], "node long")
    some = spark.createDataFrame([(x,) for x in nodes[1000:]], "node long")
    got = [r.node for r in paragraphs._where_maybe(rows, "node", paragraphs._node_bits(some, "node")).collect()]
    assert set(nodes[1000:]) <= set(got) and len(got) < 1100
    assert paragraphs._where_maybe(rows, "node", paragraphs._node_bits(some.limit(0), "node")).count() == 0


def test_white_space_of_bytes():
    every = np.arange(256, dtype=np.uint8)
    assert bytes(every[kernels.spaces(every)]) == b"\t\n\x0b\x0c\r "
