"""Operators that treat each document by itself, mixing and the pipeline."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexigrove.llm import byte_bpe, katz, language_id, mixing, pii
from lexigrove.llm.kernels import shingle_hashes, word_hashes
from lexigrove.llm.queries import ORACLES, QUERIES, byte_vocabulary, piece_vocabulary

LAST = (1 << 63) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_word_hashes():
    import numpy as np

    from lexigrove.llm import kernels

    texts = ["A b  a\tb", "", " \n", "x", "wörd wörd"]
    hashed = [word_hashes(np.frombuffer(t.encode(), np.uint8)).tolist() for t in texts]
    assert hashed[0][:2] == hashed[0][2:] and hashed[0][0] != hashed[0][1]
    assert hashed[1] == hashed[2] == [] and hashed[4][0] == hashed[4][1]
    long = (b"word " * 10 + b"q" * kernels.SLICE_BYTES * 2 + b" tail") * 2
    got = word_hashes(np.frombuffer(long, np.uint8))
    assert len(got) == 23 and got[10] != got[0]
    assert len(shingle_hashes(got[:3], 5)) == 1 and len(shingle_hashes(got[:7], 5)) == 3


def katz_by_hand(rows):
    taught = [words(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c, b, total, after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for w in taught:
        s = [None, *w, 0]
        c.update(s[1:])
        b.update(zip(s, s[1:]))
    for (h, w), n in b.items():
        total[h] += n
        after[h].append((w, n))
    n, v = sum(c.values()), len(c)
    u = (sum(x == 1 for x in c.values()) + 0.5) / (n + 1)
    d = katz.discounts([sum(x == r for x in b.values()) for r in range(1, 7)])
    star = lambda r: r * d[r - 1] if r <= 5 else r - 0.5
    one = lambda w: (1 - u) * c[w] / n if c[w] else u
    alpha = {h: (1 - sum(star(m) for _, m in x) / total[h]) / (1 - sum(one(w) for w, _ in x)) for h, x in after.items()}
    p = lambda h, w: star(b[h, w]) / total[h] if b[h, w] else alpha.get(h, 1.0) * one(w)
    for h in [*list(after)[:3], "never seen"]:
        assert math.isclose(sum(p(h, w) for w in c) + p(h, "never seen"), 1.0)
    for i, t in rows:
        s = [None, *words(t), 0]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:])
        yield (i, len(s) - 1, sum(c[w] > 0 for w in s[1:]), n, round(base, 5), round(sum(math.log10(p(*x)) for x in zip(s, s[1:])), 5))


def test_katz(documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = collections.Counter(
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.held_out_scores(documents).collect()
    )
    assert got == collections.Counter(katz_by_hand(rows))
    assert katz.held_out_scores(nothing).count() == 0
    untaught = katz.score(documents, F.lit(False)).first()
    assert untaught.n_known == 0 and math.isfinite(untaught.score)


def test_discounts():
    assert katz.discounts([100, 40, 20, 10, 6, 4])[0] < 1
    assert katz.discounts([0] * 6) == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]


@pytest.mark.parametrize("weights", [{"a": 1, "b": 3, "c": 7.5, "d": 0.11}, {str(i): i + 1 for i in range(40)}, {"x": 1}])
def test_schedule(weights):
    slots = mixing.whole_slots(weights, 4096)
    frame, had = sum(slots.values()), collections.Counter()
    for t, (source, _, slot, release, deadline) in enumerate(mixing.schedule(slots), 1):
        assert slot == t - 1 and release <= slot < deadline
        had[source] += 1
        assert all(abs(had[s] - q * t / frame) < 1 for s, q in slots.items())


def test_mix_of_odd_rows(spark, documents):
    """Every row, also with a null source or id and under clashing names, has the place that the schedule gives it."""
    odd = documents.withColumnsRenamed({"kept": "row", "component": "block", "start": "slot", "_id": "place"}).withColumn("in_mix", F.lit("x")).withColumn("release", F.lit(1))
    got = mixing.mix(odd, block_rows=3).collect()
    assert len(got) == odd.count() and all(r.in_mix for r in got)
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.row.source or ""].append(r)
    count = {s: -(-len(x) // 3) for s, x in by_source.items()}
    slots = mixing.whole_slots({s: Fraction(n, sum(count.values())) for s, n in count.items()})
    plan = {(s, k): (slot, release, deadline) for s, k, slot, release, deadline in mixing.schedule(slots)}
    for s, found in by_source.items():
        found.sort(key=lambda r: (r.block, r.place))
        assert [(r.block, r.place) for r in found] == [(i // 3, i % 3) for i in range(len(found))]
        assert all((r.slot, r.release, r.deadline) == plan[s, r.block] for r in found)
    assert any(r.row.doc_id is None for r in got) and "" in by_source
    mixed = mixing.mixed(odd, block_rows=3)
    assert mixed.columns == odd.columns and mixed.count() == odd.count()


def test_shares():
    shares = mixing.capped_shares({"big": 700, "mid": 200, "small": 100}, 0.5)
    assert float(shares["big"]) == 0.5 and math.isclose(shares["mid"], 1 / 3) and sum(shares.values()) == 1
    assert sum(mixing.capped_shares({"a": 1, "b": 1}, 0.25).values()) == 1


def test_mix(spark, documents, nothing):
    got = mixing.mix(documents, block_rows=2).collect()
    assert len(got) == documents.count()
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert mixing.mixed(documents).columns == documents.columns
    assert mixing.mix(nothing).count() == 0
    rows = spark.createDataFrame([(i, "ab"[i % 10 > 0]) for i in range(1000)], "doc_id long, source string")
    mixed = mixing.mix(rows, weights={"a": 0.5, "b": 0.5}, block_rows=10).where("in_mix").collect()
    assert collections.Counter(r.row.source for r in mixed) == {"a": 100, "b": 100}


@pytest.mark.parametrize("others", [1, 3, 4, 9])
def test_mix_keeps_a_large_source(spark, others):
    """One source of 90 %: no row is left out, and each source keeps to its share to within a block."""
    sizes = {"large": 3600} | {f"s{k}": 400 // others for k in range(others)}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    assert mixing.mixed(rows).count() == len(names)
    got = mixing.mix(rows, block_rows=4).collect()
    assert all(r.in_mix for r in got) and len({r.row.doc_id for r in got}) == len(names)
    at = sorted({(r.slot, r.row.source) for r in got})
    assert [t for t, _ in at] == list(range(len(at)))
    share, had = {s: -(-n // 4) / len(at) for s, n in sizes.items()}, collections.Counter()
    for t, s in at:
        had[s] += 1
        assert all(abs(had[x] - w * (t + 1)) < 1 for x, w in share.items())


KIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, rule in KIND.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d)))
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 13 <= len(d) <= 19 and doubled % 10 == 0,
                "phone": lambda: 9 <= len(d) <= 15,
            }
            if ok[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, nothing):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 2.3@-+4()5_%90é😀") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [None, "", "4111 1111 1111 1111, 4111-1111-1111-1112", "call +1 (743) 555-3824 or a.b@c.de", "a" * 30_000, "1." * 9000, "a@b" + ".c" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base_spans(texts[r.doc_id])
        counts = collections.Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in KIND)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert pii.report(nothing).count() == 0


def masked_data(seed=3, n=400):
    """Texts with personal data in forms that the base rules miss, and with decoys of the same forms;
    and the masked spans (text number, kind, start, end)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["anna", "j.smith", "paul_k", "info", "m.rossi"]) + digits(2)
    host = lambda: rng.choice(["mail", "example", "univ-paris", "web4"])
    end = lambda: rng.choice(["com", "org", "de", "fr", "net"])

    def card():
        d = "4" + digits(14)
        return d + next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d + c))) % 10 == 0)

    grouped = lambda c, sep: sep.join(c[k : k + 4] for k in range(0, 16, 4))
    octets = lambda: [str(rng.randint(1, 223)), *[str(rng.randint(0, 255)) for _ in range(3)]]
    phone = lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format("2" + digits(2), "5" + digits(2), digits(4))
    true = [
        ("email", "write to ", lambda: f"{name()} [at] {host()} [dot] {end()}", " for more"),
        ("email", "contact: ", lambda: f"{name()} (at) {host()}.{end()}", ", please"),
        ("email", "e-mail ", lambda: f"{name()} AT {host()} DOT {end()}", " soon"),
        ("ip", "the server at ", lambda: "[.]".join(octets()), " logged it"),
        ("ip", "host ", lambda: ":".join(["2001", *["%x" % rng.randint(1, 65535) for _ in range(7)]]), " was down"),
        ("card", "my card ", lambda: grouped(card(), rng.choice("./_")), " exp 09/27"),
        ("phone", "call ", phone, " between nine and five"),
        ("phone", "tel. ", lambda: f"0049 {digits(3)} {digits(4)} {digits(2)}", " or write"),
        ("secret", "token = \"", lambda: "%040x" % rng.getrandbits(160), "\" in the file"),
    ]
    decoys = [
        ("we met ", lambda: f"{rng.choice(['noon', 'home', 'work'])} (at) the.{rng.choice(['corner', 'station', 'sea'])}", " again"),
        ("order no. ", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", "a was late"),
        ("part number A", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", "B is out"),
        ("serial ", lambda: grouped("9" + digits(15), "/"), " on the box"),
        ("style=\"", lambda: "background-color-of-the-page", "\" here"),
    ]
    filler = ["the day was long", "we walked by the river", "nobody said a word", "it rained all night", "she read the letter"]
    texts, spans = [], set()
    for i in range(n):
        text = rng.choice(filler) + ", "
        if i % 4 == 0:  # data that the base rules find, as in any corpus
            text += f"mail {name()}@{host()}.{end()} from host {'.'.join(octets())}, card {card()}, phone +49 30 {digits(7)}; "
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.6:
                kind, before, value, after = rng.choice(true)
                text += before
                made = value()
                spans.add((i, kind, len(text), len(text) + len(made)))
                text += made + after
            else:
                before, value, after = rng.choice(decoys)
                text += before + value() + after
            text += ". " + rng.choice(filler) + ". "
        texts.append(text)
    return texts, spans


def test_pii_adds_masked_spans(spark):
    texts, want = masked_data()
    got = set()
    for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        base = set(base_spans(texts[r.doc_id]))
        found = [s.split(":") for s in r.spans.split(",") if s] + [["secret", *s.split(":")] for s in r.secrets.split(",") if s]
        assert r.n_spans == len(found)
        got |= {(r.doc_id, k, int(a), int(b)) for k, a, b in found if (k, int(a), int(b)) not in base}
    assert len(want) > 200
    right = len(got & want)
    print("added", len(got), "planted", len(want), "right", right, sorted(got - want)[:5], sorted(want - got)[:8])
    assert right / len(got) >= 0.9 and right / len(want) >= 0.9


def test_reliabilities_tell_good_labelers_from_bad():
    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = lambda right, p=truth: 0 if rng.random() < 0.3 else (1 if (rng.random() < right) == p else -1)
        counts[("card", tuple(vote(x) for x in (0.95, 0.9, 0.9, 0.8, 0.55, 0.8, 0.5)), truth)] += 1
    patterns = collections.Counter()
    for (kind, votes, _), n in counts.items():
        patterns[kind, votes] += n
    posterior, yes = pii.reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    assert yes["v_rule"][True] > 0.9 > 0.65 > yes["v_after"][True]
    right = sum(n for (k, v, truth), n in counts.items() if (posterior[k, v] > 0.5) == truth)
    assert right / 4000 > 0.93


def test_pii_odd_rows(documents):
    assert pii.report(documents).count() == documents.count()


def _rank_encoder(rank_file, pattern):
    import base64

    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(documents, nothing):
    rank_file, pattern = byte_vocabulary()
    bpe, exact = byte_bpe.load(rank_file, pattern), _rank_encoder(rank_file, pattern)
    got = byte_bpe.digests(documents, rank_file, pattern).collect()
    want = collections.Counter()
    for r in documents.collect():
        ids = exact.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert want == collections.Counter(tuple(r) for r in got)
    full = byte_bpe.encode(documents, rank_file, pattern, offsets=True).where("doc_id = 207").first()
    text = "é ß 中文 😀 \x00 \x1f  "
    for token, a, b in zip(full.ids, full.starts, full.ends, strict=True):
        assert bpe.table[token] in text[a:b].encode()
    assert all(r.round_trip for r in byte_bpe.tokens(documents, rank_file, pattern).collect())
    assert byte_bpe.digests(nothing, rank_file, pattern).count() == 0


def test_byte_bpe_equals_the_rank_encoder():
    """Also where overlapping pairs make one token, and on runs that are very long."""
    rank_file, pattern = byte_vocabulary()
    bpe, exact = byte_bpe.load(rank_file, pattern), _rank_encoder(rank_file, pattern)
    rng = random.Random(5)
    parts = ["ab", "aba", "a", "b", " ", "  ", "\n", "\t", "1", "12", "é", "漢", "字", "'s", "...", "--", "ABab", "😀", "\x1c", "\x85", "\u00a0"]
    tokens = [t.decode() for t in bpe.table if not any(b & 0x80 for b in t)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    texts += ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids.tolist() == exact.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()
    for text in (" " * 1_000_000, "a" * 1_000_000, "ab " * 300_000):
        (ids,) = bpe.encode([text])
        assert bpe.decode(ids) == text.encode()


def test_language_id(spark, documents, nothing):
    stems = {"en": "the of and to in", "de": "der die und zu ein", "fr": "le la les et un"}
    rows = [(i, " ".join(stems[k].split()[(i * j) % 5] for j in range(1, 20)), k) for i in range(120) for k in [list(stems)[i % 3]]]
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 34 !?", "fr"), (503, "der und die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, piece_vocabulary()).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "de"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    odd = language_id.identify(documents, piece_vocabulary())
    assert odd.count() == documents.count() and odd.where("score < 0 or score > 1").count() == 0
    kept = language_id.keep_identified(df, piece_vocabulary())
    assert kept.columns == df.columns and kept.count() == 121
    assert language_id.identify(nothing, piece_vocabulary()).count() == 0
    unlabelled = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), piece_vocabulary())
    assert unlabelled.where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    names = ["a", "ab", "b", "▁", "▁a"]
    gain = language_id._GAIN
    table = np.array([[0.2 * gain ** len(n)] for n in names] + [[0.0]])
    scorer = language_id.Scorer(names, table)
    (logs,) = scorer.score(["ab"])
    f = language_id.FLOOR
    begin_a, begin = 0.2 + (0.2 + f) * (0.2 + f), 0.2 + f
    want = begin_a * (0.2 + f) + begin * 0.2
    assert np.allclose(np.exp(logs[0]), want, rtol=1e-6)


def _log_by_hand(word, prob, k):
    """Sum over all segmentations, scaled as whole logarithms."""
    logs = [0.0]
    for end in range(1, len(word) + 1):
        terms = [logs[end - 1] + math.log(language_id.FLOOR)]
        terms += [logs[end - m] + math.log(prob[word[end - m : end]][k]) for m in range(1, min(end, 40) + 1) if word[end - m : end] in prob]
        top = max(terms)
        logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return logs[-1]


def test_language_id_by_hand(spark):
    """Every prediction and score, from the fitted table, by a plain sum over segmentations."""
    rng = random.Random(4)
    stems = {"en": "the of and to in house river", "de": "der die und zu ein haus fluß", "fr": "le la les et un maison rivière"}
    rows = [(i, " ".join(rng.choice(stems[k].split()) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", " 12", "!"]), k) for i in range(90) for k in [list(stems)[i % 3]]]
    rows += [(900, "der " + "und" * 60, "de"), (901, "x" * 5000 + " les", "fr"), (902, "Le_La-les2et", None), (903, "…", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vocabulary = piece_vocabulary()
    taught = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    languages, prior, table = language_id.train(taught, vocabulary)
    names = language_id.pieces(vocabulary)
    sizes = collections.Counter(k for i, _, k in rows if k and zlib.crc32(str(i).encode()) % 3 != 1)
    assert languages == sorted(sizes) and all(math.isclose(prior[languages.index(k)], math.log(n / sum(sizes.values()))) for k, n in sizes.items())
    prob = {p: table[i] / language_id._GAIN ** len(p) for i, p in enumerate(names)}
    assert all(abs(sum(table[i][k] / language_id._GAIN ** len(p) for i, p in enumerate(names)) - 1) < 1e-6 for k in range(len(languages)))
    got = {r.doc_id: r for r in language_id.identify(df, vocabulary).collect()}
    for i, text, _ in rows:
        runs = ["▁" + "".join(filter(str.isalpha, x)) for x in re.findall(r"[^\W\d_]+", text.lower())]
        runs = [x for x in runs if len(x) > 1]
        if not runs:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = [prior[k] + sum(_log_by_hand(x, prob, k) for x in runs) for k in range(len(languages))]
        best = max(range(len(logs)), key=logs.__getitem__)
        assert got[i].lang_pred == languages[best]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-6)


@pytest.fixture(scope="module")
def table_dir(documents, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    documents.write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_pipeline(spark, documents, table_dir):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "pfair_mixing", "byte_bpe"]
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, table_dir)
        assert docs.columns == documents.columns
    out = corpus_pipeline.run(spark, table_dir).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert len({r.doc_id for r in out}) == len(out)


COLUMNS = {
    "op1": "doc_id n_shingles component_id n_copies n_links", "op2": "doc_id n_repeated n_removed spans removed_spans kept_in",
    "op3": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4": "doc_id source block place slot release deadline in_mix",
    "op5": "doc_id n_lines n_dropped kept_sha256", "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_spans secrets",
    "op7": "doc_id keep_id group_size kept text_sha256", "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op10": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, table_dir, documents, nothing, tmp_path, name):
    """The registered queries themselves, on odd rows and on an empty table."""
    out = QUERIES[name](spark, table_dir)
    assert out.columns == COLUMNS[name.split("_")[0]].split()
    rows = out.collect()
    if not name.startswith("op2"):  # which has rows for documents with a repeat only
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in documents.select("doc_id").collect())
    if name.startswith("op9"):
        ids = [r.doc_id for r in documents.select("doc_id").collect()]
        texts = {r.doc_id: r.text or "" for r in documents.collect() if ids.count(r.doc_id) == 1}
        order = sorted(i for i in texts if i is not None)
        for r in rows:
            at = order.index(r.doc_id) if r.doc_id in order else -1
            if 0 <= at < len(order) - 1 and order[at + 1] != 203 and r.doc_id < 202:
                text, after = texts[r.doc_id], texts[order[at + 1]]
                k = len(text) // 4
                assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    import corpus_pipeline

    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [0, 16])
def test_encoding_goes_by_the_mix(spark, tmp_path, most):
    """Documents are encoded in the order of the mix, though readers deal files out by size; by a task's only file or by several."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, "ab c " * rng.randint(0, 400), "s%d" % min(2, i % 7)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_order", F.lit("x")).withColumn("_metadata", F.lit("x"))
    want = [r.doc_id for r in mixing.mix(docs).orderBy("slot", "place").select("row.doc_id").collect()]
    mixed, path = corpus_pipeline.mixed_sources(spark, docs, ""), str(tmp_path / "mixed")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would make one file
    try:
        mixed.write.option("maxRecordsPerFile", most).parquet(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    read = spark.read.parquet(path)
    assert len(read.inputFiles()) > 3 and [r.doc_id for r in read.collect()] != want
    for given in (read, mixed):  # written, and as it stands
        out = corpus_pipeline.encoded(spark, given, "").collect()
        assert [r.doc_id for r in out] == want != sorted(want)
        assert all(a.mix_order < b.mix_order for a, b in zip(out, out[1:]))
    spark.createDataFrame(out).write.parquet(str(tmp_path / "out"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).orderBy("mix_order").collect()] == want


def test_pipeline_goes_by_the_mix(spark, documents, table_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, table_dir).collect()
    sources = {r.doc_id: r.source for r in documents.collect()}
    left = spark.createDataFrame([(r.doc_id, sources[r.doc_id]) for r in out], "doc_id long, source string")
    assert [r.doc_id for r in out] == [r.doc_id for r in mixing.mix(left).orderBy("slot", "place").select("row.doc_id").collect()]
    assert all(a.mix_order < b.mix_order for a, b in zip(out, out[1:]))
