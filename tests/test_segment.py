"""Lookups and segmentation on a small lexicon."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from lexicon import ENTRIES  # noqa: E402

from lexigrove.functions import counting  # noqa: E402
from lexigrove.operators import compounds, pairs, segment  # noqa: E402
from lexigrove.operators.lookups import Lookups  # noqa: E402
from lexigrove.sources.lexicon import Lexicon, assemble  # noqa: E402


@pytest.fixture(scope="module")
def lexicon(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("lexicon"))
    Lexicon.of(spark, assemble(ENTRIES)).write(where)
    return Lexicon.read(spark, where)


@pytest.fixture(scope="module")
def features(lexicon):
    return segment.word_features(lexicon).cache()


def keys(spark, values, schema):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def test_lookups(spark, lexicon):
    look = Lookups(lexicon)
    get = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    seqs = keys(spark, [1, 2, 2, 99], "seq int")
    assert get(look.entry_by_seq(seqs), "seq") == [(1,), (2,)]
    assert get(look.root_seqs(keys(spark, [7, 10_000_001], "seq int")), "seq") == [(7,)]
    assert get(look.candidate_seqs_kana(keys(spark, ["は", "せかい"], "text string")), "text", "seq") == [("は", 5)]
    assert get(look.candidate_seqs_kanji(keys(spark, [("世界", "せかい"), ("世界", None)], "text string, reading string")), "seq") == [(1,)]
    assert get(look.headword_text(seqs, "kana"), "text") == [("せかい",), ("にほん",)]
    assert get(look.texts_by_seq(seqs, "kana"), "seq", "text", "place") == [(1, "せかい", 1), (2, "にっぽん", 2), (2, "にほん", 1)]
    assert get(look.texts_by_text(keys(spark, ["読んで"], "text string"), "kanji"), "seq") == [(10_000_001,)]
    assert get(look.texts_by_text(keys(spark, ["読んで"], "text string"), "kanji", root_only=True), "seq") == []
    assert get(look.texts_conjugated_from(keys(spark, [("よんで", 7)], "text string, from int"), "kana"), "seq") == [(10_000_001,)]
    assert get(look.texts_with_pos(keys(spark, [("は", "prt"), ("ご", "prt")], "text string, pos string"), "kana"), "text") == [("は",)]
    assert get(look.kana_forms(keys(spark, [7], "seq int")), "of", "text") == [(7, "よみ"), (7, "よむ"), (7, "よんで")]
    assert get(look.texts_by_regex("^に.*ん$"), "text") == [("にっぽん",), ("にほん",)]
    assert get(look.kanji_words_containing(keys(spark, ["語"], "char string")), "text") == [("日本語",), ("語",)]
    assert get(look.parents(keys(spark, [(10_000_001, "読んで")], "seq int, text string"), "kanji"), "conj_id") == [(1,)]
    assert get(look.derived_seqs(keys(spark, [7], "seq int")), "seq") == [(10_000_001,), (10_000_002,)]
    assert (1,) in get(look.underived(), "seq") and (10_000_001,) not in get(look.underived(), "seq")
    assert get(look.sense_glosses(seqs), "seq", "glosses") == [(1, "the world; society"), (2, "Japan")]
    assert get(look.first_glosses(keys(spark, [12], "seq int"), "ctr"), "glosses") == [("counter for long things",)]
    assert get(look.used_pos(keys(spark, [10, 4], "seq int")), "seq", "pos") == [(4, "n"), (4, "n-suf")]
    assert get(look.archaic_seqs(), "seq") == [(10,)]
    assert get(look.counter_seqs(), "seq") == [(12,)]
    assert get(look.usually_kana_senses(keys(spark, [9, 8], "seq int")), "seq") == [(9,)]
    with pytest.raises(Exception, match="no text of id 999"):
        look.texts_by_id(keys(spark, [999], "id int"), "kana").collect()


def test_score(features):
    scored = segment.analysed(features, F.lit(False))
    assert scored.where("text = '世界'").first()["_a"]["score"] == 325


def test_sticky_positions(spark):
    got = spark.createDataFrame([("がっこう",), ("きゃー",), ("かあ",)], "run string").select(segment.sticky_positions(F.col("run")).alias("s"))
    assert [r.s for r in got.collect()] == [[2], [1], []]


def test_best_paths():
    segments = [(0, 1, 10), (0, 2, 30), (1, 3, 25), (2, 3, 5)]
    assert segment.best_paths(3, segments, 2) == [(35, [0, 2]), (35, [1, 3])]
    assert segment.best_paths(2, []) == [(-1000, [])]


def test_pair_rules():
    word = lambda text, seq, pos, at=0, **kw: pairs.Word(at, at + len(text), text, frozenset({seq}), frozenset(pos), **({"solid": True} | kw))
    noun, ha = word("世界", 1, ["n"]), word("は", 2028920, ["prt"], 2, solid=False)
    assert pairs.value(noun, ha) == 14
    assert pairs.value(noun, word("は", 2028920, ["prt"], 3, solid=False)) == 0
    assert pairs.value(word("え", 5, ["int"], solid=False), word("か", 6, ["prt"], 1, solid=False)) == -9
    assert pairs.value(word("ね", 2029080, ["prt"], solid=False), word("世界", 1, ["n"], 1)) == -15
    assert pairs.value(word("ゆっくり", 7, ["adv-to"], primary=True, solid=False), word("と", 1008490, ["prt"], 4, solid=False)) == 50
    segments = [(0, 2, 30), (2, 3, 10)]
    assert segment.best_paths(3, segments, 1, lambda i, j: 14) == [(54, [0, 1])]


def test_tokens(spark, features):
    texts = spark.createDataFrame([(1, "Hello 世界！"), (2, "私は日本語を読んで"), (3, ""), (4, "私xセンター"), (5, None)], "id int, text string")
    out = segment.tokens(texts, features)
    got = {}
    for r in out.orderBy("id", "run_no", "token_no").collect():
        got.setdefault(r.id, []).append((r.token, r.romaji))
    assert got[1] == [("Hello ", "Hello "), ("世界", "sekai"), ("! ", "! ")]
    assert got[2] == [("私", "watashi"), ("は", "ha"), ("日本語", "nihongo"), ("を", "wo"), ("読んで", "yonde")]
    assert got[4] == [("私", "watashi"), ("x", "x"), ("センター", "senta")]
    assert set(got) == {1, 2, 4}
    lines = {r.id: r.romaji for r in segment.romanized(out, "id").collect()}
    assert lines[1] == "Hello sekai! " and lines[2] == "watashi ha nihongo wo yonde"


def test_suffixes_and_counters(spark, lexicon, features):
    suffixes = compounds.suffix_forms(lexicon, [("tai", 20), ("teiru", 21)])
    texts = spark.createDataFrame([(1, "日本語を読みたい"), (2, "本を読んでいる"), (3, "三本"), (4, "8本")], "id int, text string")
    out = segment.tokens(texts, features, suffixes=suffixes)
    got = {}
    for r in out.orderBy("id", "run_no", "token_no").collect():
        got.setdefault(r.id, []).append((r.token, r.kana))
    assert got[1][-1] == ("読みたい", "よみたい") and got[2][-1] == ("読んでいる", "よんでいる")
    assert got[3] == [("三本", "さんぼん")] and got[4] == [("8本", "はっぽん")]


def test_counting():
    assert [counting.counted(n, "ほん") for n in (1, 2, 3, 6, 10, 100)] == ["いっぽん", "にほん", "さんぽん", "ろっぽん", "じゅっぽん", "ひゃっぽん"]
    assert counting.counted(8, "かい") == "はっかい" and counting.counted(1, "ページ", foreign=True) == "いちページ"
    assert [counting.ordinal(n) for n in (1, 2, 3, 11, 112, 23)] == ["1st", "2nd", "3rd", "11th", "112th", "23rd"]
    assert [counting.last_digit(n) for n in (7, 10, 500, 20_000, 10**8)] == [7, 10, 100, 10_000, None]
