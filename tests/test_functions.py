"""Scalar functions on known values."""

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import numerals, romaji
from lexigrove.functions import text as tx


def value(spark, column, *args):
    row = spark.createDataFrame([args], [f"c{i}" for i in range(len(args))]) if args else spark.range(1)
    return row.select(column(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize(("kana", "given", "want"), [
    (False, "０", "0"), (False, "か゛", "が"), (False, "、", ", "), (False, "・・・・", "...  "), (False, "ｶﾞ", "ガ"),
    (True, "ｱ", "ア"), (True, "か゛", "が"), (True, "、", "、"), (True, "は゜", "ぱ"),
])
def test_normalize(spark, kana, given, want):
    assert value(spark, lambda c: tx.normalize(c, kana), given) == want


def test_scripts(spark):
    assert value(spark, tx.as_hiragana, "カタカナ日本ｱ") == "かたかな日本あ"
    assert value(spark, tx.as_katakana, "ひらがな") == "ヒラガナ"
    assert value(spark, tx.mora_length, "きゃっと") == 2
    assert value(spark, lambda c: tx.destem(c, 2), "食べたい") == "食べ"
    assert value(spark, lambda c: tx.destem(c, 9), "食べたい") == ""
    assert value(spark, lambda c: tx.in_class(c, "hiragana"), "ひらがな") is True
    assert value(spark, lambda c: tx.in_class(c, "hiragana"), "ひらガな") is False
    assert value(spark, lambda c: tx.count_class(c, "kanji"), "日本のご飯") == 3
    assert value(spark, lambda c: tx.collect_class(c, "kanji"), "日本のご飯") == ["日", "本", "飯"]
    assert value(spark, tx.char_class_of, "ヴ") == "vu"
    assert value(spark, lambda c: tx.long_vowel_modifier(F.lit("+a"), c), "か") is True


def test_splitting(spark):
    parts = value(spark, tx.basic_split, "Hello 世界！3月1日 2.5本")
    assert [(p["matched"], p["text"]) for p in parts] == [(False, "Hello "), (True, "世界"), (False, "！"), (True, "3月1日"), (False, " 2.5"), (True, "本")]
    assert [tuple(r) for r in value(spark, lambda c: tx.class_runs(c, "number"), "十二月3日")] == [(0, 2), (3, 4)]
    assert value(spark, lambda c: tx.split_by_regex(c, "[0-9]+"), "a12b3") == ["a", "12", "b", "3"]


def test_kanji(spark):
    assert value(spark, tx.kanji_boundaries, "日本語") == [1, 2]
    assert value(spark, lambda c: tx.kanji_boundaries(c, 5), "日本語") == [6, 7]
    assert value(spark, tx.kanji_boundaries, "日の本") == []
    assert value(spark, tx.kanji_mask, "お茶を飲む") == "お%を%む"
    assert value(spark, tx.kanji_match, "お茶", "おちゃ") is True
    assert value(spark, tx.kanji_match, "お茶", "にちゃ") is False
    assert value(spark, tx.kanji_prefix, "お茶を飲む") == "お茶を飲"
    assert value(spark, tx.kanji_prefix, "ひらがな") == ""
    assert value(spark, tx.kanji_cross_match, "食べる", "たべる", "食べた") == "たべた"
    assert value(spark, lambda c: tx.safe_substring(c, F.lit(1), F.lit(9)), "abc") is None
    assert value(spark, lambda c: tx.safe_substring(c, F.lit(1)), "abc") == "bc"


def test_voicing(spark):
    assert value(spark, tx.rendaku, "かみ") == "がみ"
    assert value(spark, lambda c: tx.rendaku(c, True), "はこ") == "ぱこ"
    assert value(spark, tx.unrendaku, "ガラス") == "カラス"
    assert value(spark, tx.geminate, "いち") == "いっ"


def test_match_diff(spark):
    assert tx.align("abc", "abc") == ([("abc", "abc")], 3)
    assert tx.align("食べる", "たべる") == ([("食", "た"), ("べる", "べる")], 2)
    assert tx.align("", "a") is None
    row = spark.createDataFrame([("飲む", "のむ")], "a string, b string").select(tx.match_diff("a", "b").alias("m")).first()["m"]
    assert row["score"] == 1 and [b["equal"] for b in row["blocks"]] == [False, True]


@pytest.mark.parametrize(("n", "kanji", "kana"), [
    (0, "〇", "れい"), (7, "七", "なな"), (10, "十", "じゅう"), (1000, "千", "せん"), (10_000, "一万", "いちまん"), (11_000, "一万千", "いちまんせん"),
    (1234, "千二百三十四", "せんにひゃくさんじゅうよん"), (20_020_001, "二千二万一", "にせんにまんいち"), (12_423_000_430, "百二十四億二千三百万四百三十", None),
    (3600, "三千六百", "さんぜんろっぴゃく"), (888, "八百八十八", "はっぴゃくはちじゅうはち"), (10**12, "一兆", "いっちょう"),
])
def test_numbers(n, kanji, kana):
    assert numerals.to_kanji(n) == kanji and numerals.parse(kanji) == n
    assert kana is None or numerals.to_kana(n) == kana


def test_number_columns(spark):
    rows = spark.createDataFrame([("二〇二〇",), ("百万",), ("100万500",), ("１２３",), ("一X",), (None,)], "s string")
    assert [r.v and int(r.v) for r in rows.select(numerals.parse_number("s").alias("v")).collect()] == [2020, 1_000_000, 1_000_500, 123, None, None]
    assert value(spark, numerals.number_to_kanji, 1234) == "千二百三十四"
    assert value(spark, numerals.number_to_kana, 300) == "さんびゃく"


def test_percentage(spark):
    """As %.2f of C: ties to the even digit, and by the binary value, not by its shortest decimal form."""
    values = [33.125, 3.375, 2.675, 1.005, 50.125, 99.995, 99.999, 0.0, 0.005, 100.0, 12345.675, *(100.0 * n / 640 for n in range(641)), *(100.0 * n / 4000 for n in range(4001))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", numerals.percentage(F.col("v")).alias("p")).collect()
    assert len(rows) == len(values) and [r.p for r in rows] == ["%.2f%%" % r.v for r in rows]


@pytest.mark.parametrize(("word", "method", "want"), [
    ("がっこう", "hepburn_traditional", "gakkō"), ("しんぶん", "hepburn_traditional", "shimbun"), ("まっちゃ", "hepburn_traditional", "matcha"),
    ("きんえん", "hepburn_traditional", "kin-en"), ("センター", "hepburn_traditional", "senta"), ("こんにちは", "hepburn_traditional", "konnichiha"),
    ("‌は", "hepburn_traditional", "wa"), ("っ", "hepburn_traditional", "!"), ("ー", "hepburn_traditional", "~"), ("しゃしん", "kunrei_siki", "syasin"),
    ("とうきょう", "hepburn_simple", "tokyo"), ("おおの", "hepburn_passport", "ohno"), ("おかあさん", "hepburn_modified", "okāsan"), ("きんえん", "hepburn_basic", "kin'en"),
    ("こゞ", "hepburn_basic", "kogo"), ("うぃ", "hepburn_basic", "wi"), ("ファン", "hepburn_basic", "fan"),
])
def test_romanize(word, method, want):
    assert romaji.romanize(word, method) == want


def test_from_romaji(spark):
    assert romaji.readings("kanji") == ("かんじ", "^かんじ$")
    assert romaji.readings("tokyo")[0] == "ときょ" and romaji.readings("tokyo")[1] == "^とう?きょう?$"
    assert romaji.readings("shimbun")[0] == "しんぶん" and romaji.readings("x9") is None
    assert len(romaji.romaji_table()) > 280
    assert value(spark, romaji.romaji_kana, "kitte")["canonical"] == "きって"
    assert romaji.prefixes(["abc", "x"]) == {"a", "ab"}
    parts = F.array(*map(F.lit, ["Hello ", "sekai", "! ", "desu", "."]))
    assert value(spark, lambda: romaji.join_parts(parts)) == "Hello sekai! desu."
    assert value(spark, romaji.romanize_place, "とうきょう") == "Tōkyō"
