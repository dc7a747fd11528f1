"""Single words on the small lexicon."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from lexicon import ENTRIES  # noqa: E402

from lexigrove.functions import romaji  # noqa: E402
from lexigrove.operators import segment, words  # noqa: E402
from lexigrove.operators.lookups import Lookups  # noqa: E402
from lexigrove.sources.lexicon import Lexicon, assemble  # noqa: E402


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.of(spark, assemble(ENTRIES))


@pytest.fixture(scope="module")
def features(lexicon):
    return segment.word_features(lexicon).cache()


def test_spellings():
    assert romaji.spellings("tokyo")[0] == "ときょ"
    assert set(romaji.spellings("tokyo")) == {"ときょ", "ときょう", "とうきょ", "とうきょう"}
    assert romaji.spellings("9") == []


def test_word_info(spark, lexicon, features):
    keys = spark.createDataFrame([("世界", None), ("日本", "にほん"), ("日本", "ふそう"), ("無い", None)], "text string, reading string")
    rows = words.word_info(keys, features).collect()
    assert {(r.text, r.seq, r.score) for r in rows if r.text == "世界"} == {("世界", 1, 325)}
    assert {(r.text, r.reading) for r in rows} == {("世界", None), ("日本", "にほん")}
    glosses = Lookups(lexicon).sense_glosses(keys.select(F.lit(1).alias("seq"))).select("seq", "glosses")
    assert words.with_glosses(words.word_info(keys, features), glosses, F.array(F.lit("World"))).where("text = '世界'").first()["seq"] == 1


def test_suggestions(spark, lexicon):
    rows = {r.romaji: r for r in words.suggestions(spark.createDataFrame([("sekai",), ("yomu",), ("zzz9",), ("kani",)], "romaji string"), lexicon).collect()}
    assert rows["sekai"].hiragana == ["せかい"] and rows["sekai"].katakana == ["セカイ"] and rows["sekai"].kanji == ["世界"]
    assert rows["yomu"].kanji == ["読む"] and rows["kani"].kanji == [] and "zzz9" not in rows


def test_as_hiragana(spark, features):
    rows = words.as_hiragana(spark.createDataFrame([("ワタシ",), ("センター",), ("私",)], "text string"), features).collect()
    assert [(r.text, r.seq, r.kana) for r in rows] == [("ワタシ", 8, "わたし")]
