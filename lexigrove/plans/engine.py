"""Queries that run the engine itself on the small lexicon, with SQL over the same rows.

Lookups have SQL of their own; functions, compounds and segmentation have the rows that they must give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counting, numerals, romaji
from ..functions import text as tx
from ..operators import analyses, compounds, conjugation, kanji, patches, segment, senses, splits, words
from ..operators.documents import render
from ..operators.lookups import DESU, Lookups
from ..sources import places
from ..sources.tables import settled
from . import small_lexicon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _show(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], schema: str) -> str:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {"string": "VARCHAR", "long": "BIGINT"}
    cast = ", ".join(f'CAST("{n.strip("`")}" AS {kinds.get(k, k)}) AS "{n.strip("`")}"' for n, k in fields)
    names = ", ".join(f'"{n.strip("`")}"' for n, _ in fields)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_show, r)) + ')' for r in rows)}) v({names})"


def lookup(name: str, keys: list[tuple], schema: str, sql: str, columns: str | None = None):
    """Register a lookup: keys, and SQL over the tables and ``keys``."""

    def add(f: Callable[[Lookups, DataFrame], DataFrame]):
        def query(spark: SparkSession, d: str) -> DataFrame:
            look = Lookups(small_lexicon.lexicon(spark))
            out = f(look, spark.createDataFrame(keys, schema) if keys else None)
            return out.select(*columns.split()) if columns else out

        made = f"keys AS ({_values(keys, schema)}), " if keys else ""
        QUERIES[f"engine_{name}"], SQL[f"engine_{name}"] = query, f"WITH {made}{small_lexicon.as_sql()}\n{sql}"
        return f

    return add


def known(name: str, rows: list[tuple], schema: str):
    """Register a query with the rows that it must give."""

    def add(f: Query):
        QUERIES[f"engine_{name}"], SQL[f"engine_{name}"] = f, _values(rows, schema)
        return f

    return add


_SEQS = [(1,), (2,), (2,), (8,), (13,), (99,)]
lookup("entry_by_seq", _SEQS, "seq int", "SELECT seq, root_p, n_kanji FROM entry WHERE seq IN (SELECT seq FROM keys)", "seq root_p n_kanji")(lambda k, x: k.entry_by_seq(x))
lookup("root_seqs", [(7,), (10_000_001,)], "seq int", "SELECT seq FROM entry WHERE root_p AND seq IN (SELECT seq FROM keys)")(lambda k, x: k.root_seqs(x))
lookup(
    "candidate_seqs_kana", [("は",), ("せかい",), ("センター",)], "text string",
    "SELECT DISTINCT t.text, t.seq FROM kana_text t JOIN entry e USING (seq) LEFT JOIN kanji_text k ON k.seq = t.seq WHERE e.root_p AND t.ord = 0 AND k.id IS NULL AND t.text IN (SELECT text FROM keys)",
    "text seq",
)(lambda k, x: k.candidate_seqs_kana(x))
lookup(
    "candidate_seqs_kanji", [("世界", "せかい"), ("日本", "にっぽん"), ("本", "ほん")], "text string, reading string",
    "SELECT k.text, r.text AS reading, k.seq FROM kanji_text k JOIN kana_text r USING (seq) JOIN entry e USING (seq) JOIN keys x ON x.text = k.text AND x.reading = r.text WHERE e.root_p AND k.ord = 0 AND r.ord = 0",
    "text reading seq",
)(lambda k, x: k.candidate_seqs_kanji(x))
for _kind in ("kanji", "kana"):
    lookup(f"headword_{_kind}", _SEQS, "seq int", f"SELECT seq, text FROM {_kind}_text WHERE ord = 0 AND seq IN (SELECT seq FROM keys)")(lambda k, x, n=_kind: k.headword_text(x, n))
    lookup(
        f"{_kind}_texts_by_seq_and_text", [(2, "にほん"), (2, "日本"), (8, "わたし"), (1, "無")], "seq int, text string",
        f"SELECT seq, text, id, ord, common FROM {_kind}_text t WHERE (seq, text) IN (SELECT seq, text FROM keys)", "seq text id ord common",
    )(lambda k, x, n=_kind: k.texts_by_seq_and_text(x, n))
    lookup(
        f"{_kind}_texts_by_seq", _SEQS, "seq int",
        f"SELECT seq, text, row_number() OVER (PARTITION BY seq ORDER BY ord, ordinal) AS place FROM {_kind}_text WHERE seq IN (SELECT seq FROM keys)", "seq text place",
    )(lambda k, x, n=_kind: k.texts_by_seq(x, n))
    lookup(f"{_kind}_text_by_id", [(1,), (3,), (3,)], "id int", f"SELECT id, seq, text FROM {_kind}_text WHERE id IN (SELECT id FROM keys)", "id seq text")(lambda k, x, n=_kind: k.texts_by_id(x, n))
    lookup(
        f"{_kind}_texts_by_text", [("読んで",), ("よんで",), ("本",), ("ほん",)], "text string", f"SELECT text, seq FROM {_kind}_text WHERE text IN (SELECT text FROM keys)", "text seq"
    )(lambda k, x, n=_kind: k.texts_by_text(x, n))
    lookup(
        f"{_kind}_texts_root_by_text", [("読んで",), ("よんで",), ("本",), ("ほん",)], "text string",
        f"SELECT t.text, t.seq FROM {_kind}_text t JOIN entry e USING (seq) WHERE e.root_p AND t.text IN (SELECT text FROM keys)", "text seq",
    )(lambda k, x, n=_kind: k.texts_by_text(x, n, root_only=True))
    lookup(
        f"{_kind}_texts_by_text_and_seqs", [("本", 12), ("ほん", 12), ("食べ", 10_000_004), ("世界", 2)], "text string, seq int",
        f"SELECT text, seq FROM {_kind}_text WHERE text IN (SELECT text FROM keys) AND seq IN (SELECT seq FROM keys)", "text seq",
    )(lambda k, x, n=_kind: k.texts_by_text_and_seqs(x.select("text"), x.select("seq"), n))
    lookup(
        f"{_kind}_texts_conj_of", [("食べた", 13), ("たべた", 13), ("食べられた", 13), ("読み", 13)], "text string, from int",
        f'SELECT t.text, t.seq, c."from" FROM {_kind}_text t JOIN conjugation c USING (seq) JOIN keys x ON x.text = t.text AND x."from" = c."from"', "text seq from",
    )(lambda k, x, n=_kind: k.texts_conjugated_from(x, n))
    lookup(
        f"{_kind}_texts_with_pos", [("は", "prt"), ("本", "ctr"), ("ほん", "ctr"), ("ほん", "v1")], "text string, pos string",
        f"SELECT DISTINCT t.text, t.seq FROM {_kind}_text t JOIN sense_prop p USING (seq) JOIN keys x ON x.text = t.text AND x.pos = p.text WHERE p.tag = 'pos'", "text seq",
    )(lambda k, x, n=_kind: k.texts_with_pos(x, n))
    lookup(f"{_kind}_seqs_by_text", [("本",), ("ほん",), ("は",)], "text string", f"SELECT text, seq FROM {_kind}_text WHERE text IN (SELECT text FROM keys)", "text seq")(lambda k, x, n=_kind: k.seqs_by_text(x, n))
    lookup(
        f"parents_{_kind}", [(10_000_001, "読んで"), (10_000_001, "よんで"), (10_000_018, "食べられた"), (10_000_018, "たべられた")], "seq int, text string",
        f'SELECT x.seq, x.text, t.id AS text_id, c.id AS conj_id FROM keys x JOIN conjugation c ON c.seq = x.seq JOIN conj_source_reading s ON s.conj_id = c.id AND s.text = x.text JOIN {_kind}_text t ON t.seq = coalesce(c.via, c."from") AND t.text = s.source_text',
    )(lambda k, x, n=_kind: k.parents(x, n))
lookup(
    "kana_forms", [(7,), (2017560,)], "seq int",
    'SELECT t.seq AS "of", t.text FROM kana_text t WHERE t.seq IN (SELECT seq FROM keys) UNION SELECT c."from", t.text FROM kana_text t JOIN conjugation c USING (seq) WHERE c."from" IN (SELECT seq FROM keys)', "of text",
)(lambda k, x: k.kana_forms(x))
lookup("reading_texts", _SEQS, "seq int", "SELECT seq, text, row_number() OVER (PARTITION BY seq ORDER BY id) AS place FROM kana_text WHERE seq IN (SELECT seq FROM keys)")(lambda k, x: k.reading_texts(x))
lookup("kana_texts_by_regex", [], "", "SELECT text, seq FROM kana_text WHERE regexp_matches(text, '^(に|た).*[んい]$')", "text seq")(lambda k, x: k.texts_by_regex("^(に|た).*[んい]$"))
lookup(
    "kanji_words_containing", [("語",), ("本",), ("食",)], "char string",
    "SELECT x.char, k.seq, k.text, k.best_kana, k.common FROM keys x JOIN kanji_text k ON contains(k.text, x.char) JOIN kana_text r ON r.seq = k.seq AND r.text = k.best_kana JOIN entry e ON e.seq = k.seq WHERE e.root_p AND k.common IS NOT NULL",
)(lambda k, x: k.kanji_words_containing(x))
lookup("conjs_by_seq", [(10_000_001,), (10_000_018,), (1,)], "seq int", 'SELECT id, seq, "from", via FROM conjugation WHERE seq IN (SELECT seq FROM keys)', "id seq from via")(lambda k, x: k.conjugations(x))
lookup("conjs_by_seq_and_from", [(10_000_001, 7), (10_000_003, 7)], "seq int, from int", 'SELECT id, seq, "from" FROM conjugation WHERE (seq, "from") IN (SELECT seq, "from" FROM keys)', "id seq from")(lambda k, x: k.conjugations(x, "seq", "from"))
lookup("conjs_by_seq_and_ids", [(10_000_001, 1), (10_000_003, 1)], "seq int, id int", "SELECT id, seq FROM conjugation WHERE (seq, id) IN (SELECT seq, id FROM keys)", "id seq")(lambda k, x: k.conjugations(x, "seq", "id"))
lookup("conj_by_id", [(1,), (4,)], "id int", "SELECT id, seq FROM conjugation WHERE id IN (SELECT id FROM keys)", "id seq")(lambda k, x: k.conjugations(x, "id"))
lookup("conjs_by_seq_via_null", [(10_000_017,), (10_000_018,)], "seq int", "SELECT id, seq FROM conjugation WHERE via IS NULL AND seq IN (SELECT seq FROM keys)", "id seq")(lambda k, x: k.direct_conjugations(x))
lookup("conj_seqs_of_desu", [(10_000_001,)], "seq int", f'SELECT DISTINCT seq FROM conjugation WHERE "from" = {DESU} AND seq IN (SELECT seq FROM keys)')(lambda k, x: k.desu_seqs(x))
lookup("conj_seqs_from_any", [(13,), (7,)], "seq int", 'SELECT DISTINCT seq FROM conjugation WHERE "from" IN (SELECT seq FROM keys)')(lambda k, x: k.derived_seqs(x))
lookup("no_conj_seqs", [], "", "SELECT seq FROM entry e WHERE NOT EXISTS (SELECT 1 FROM conjugation c WHERE c.seq = e.seq)")(lambda k, x: k.underived())
lookup("conj_props", [(1,), (5,)], "conj_id int", "SELECT conj_id, conj_type, pos, neg, fml FROM conj_prop WHERE conj_id IN (SELECT conj_id FROM keys)", "conj_id conj_type pos neg fml")(lambda k, x: k.conj_props(x))
lookup("source_readings", [(1,), (18,)], "conj_id int", "SELECT conj_id, text, source_text FROM conj_source_reading WHERE conj_id IN (SELECT conj_id FROM keys)", "conj_id text source_text")(lambda k, x: k.source_readings(x))
lookup("source_readings_by_text", [(1, "よんで"), (18, "食べ")], "conj_id int, text string", "SELECT conj_id, text, source_text FROM conj_source_reading WHERE (conj_id, text) IN (SELECT conj_id, text FROM keys)", "conj_id text source_text")(lambda k, x: k.source_readings(x, "conj_id", "text"))
lookup(
    "sense_gloss_rows", _SEQS, "seq int",
    "SELECT s.seq, s.id AS sense_id, s.ord, string_agg(g.text, '; ' ORDER BY g.ord) AS glosses FROM sense s LEFT JOIN gloss g ON g.sense_id = s.id WHERE s.seq IN (SELECT seq FROM keys) GROUP BY ALL", "seq sense_id ord glosses",
)(lambda k, x: k.sense_glosses(x))
lookup(
    "sense_props", [(4,), (9,), (12,)], "seq int",
    "SELECT s.seq, p.tag, p.text, row_number() OVER (PARTITION BY s.seq ORDER BY s.ord, p.tag, p.ord, p.ordinal) AS place FROM sense s JOIN sense_prop p ON p.sense_id = s.id WHERE p.tag IN ('pos', 'misc') AND s.seq IN (SELECT seq FROM keys)", "seq tag text place",
)(lambda k, x: k.sense_props(x, ["pos", "misc"]))
lookup("first_glosses", [(1,), (12,)], "seq int", "SELECT s.seq, string_agg(g.text, '; ' ORDER BY g.ord) AS glosses FROM sense s JOIN gloss g ON g.sense_id = s.id WHERE s.ord = 0 AND s.seq IN (SELECT seq FROM keys) GROUP BY ALL")(lambda k, x: k.first_glosses(x))
lookup(
    "first_glosses_with_pos", [(1,), (12,)], "seq int",
    "SELECT s.seq, string_agg(g.text, '; ' ORDER BY g.ord) AS glosses FROM sense s JOIN gloss g ON g.sense_id = s.id JOIN sense_prop p ON p.sense_id = s.id WHERE p.tag = 'pos' AND p.text = 'ctr' AND s.seq IN (SELECT seq FROM keys) GROUP BY ALL",
)(lambda k, x: k.first_glosses(x, "ctr"))
lookup("glosses", _SEQS, "seq int", "SELECT s.seq, g.text, row_number() OVER (PARTITION BY s.seq ORDER BY s.ord, g.ord) AS place FROM sense s JOIN gloss g ON g.sense_id = s.id WHERE s.seq IN (SELECT seq FROM keys)")(lambda k, x: k.glosses(x))
lookup("uk_sense_ids", [(9,), (8,), (1577980,)], "seq int", "SELECT seq, sense_id FROM sense_prop WHERE tag = 'misc' AND text = 'uk' AND seq IN (SELECT seq FROM keys)")(lambda k, x: k.usually_kana_senses(x))
lookup("first_senses", [(1,), (11,), (12,)], "id int", "SELECT id FROM sense WHERE ord = 0 AND id IN (SELECT id FROM keys)")(lambda k, x: k.first_senses(x))
lookup(
    "non_arch_posi", [(10,), (4,), (12,)], "seq int",
    "SELECT DISTINCT p.seq, p.text AS pos FROM sense_prop p WHERE p.tag = 'pos' AND p.seq IN (SELECT seq FROM keys) AND NOT EXISTS (SELECT 1 FROM sense_prop a WHERE a.sense_id = p.sense_id AND a.tag = 'misc' AND a.text IN ('arch', 'obsc', 'rare'))",
)(lambda k, x: k.used_pos(x))
lookup(
    "arch_only_seqs", [], "",
    "SELECT s.seq FROM sense s LEFT JOIN sense_prop p ON p.sense_id = s.id AND p.tag = 'misc' AND p.text IN ('arch', 'obsc', 'rare') GROUP BY s.seq HAVING bool_and(p.id IS NOT NULL)",
)(lambda k, x: k.archaic_seqs())
lookup("counter_seqs", [], "", "SELECT DISTINCT seq FROM sense_prop WHERE tag = 'pos' AND text = 'ctr'")(lambda k, x: k.counter_seqs())
lookup("restricted_readings", [(8,), (1,)], "seq int", "SELECT seq, reading, text FROM restricted_readings WHERE seq IN (SELECT seq FROM keys)")(lambda k, x: k.restrictions(x))
lookup("kanji_by_text", [("日",), ("月",)], "text string", "SELECT id, text, grade, strokes FROM kanji WHERE text IN (SELECT text FROM keys)", "id text grade strokes")(lambda k, x: k.kanji_by_text(x))
lookup(
    "readings_non_nanori", [(1,), (3,)], "kanji_id int",
    "SELECT kanji_id, text, row_number() OVER (PARTITION BY kanji_id ORDER BY type DESC, stat_common DESC, ordinal) AS place FROM reading WHERE type <> 'ja_na' AND kanji_id IN (SELECT kanji_id FROM keys)", "kanji_id text place",
)(lambda k, x: k.kanji_readings(x))
lookup("meanings", [(1,), (2,)], "kanji_id int", "SELECT kanji_id, text, row_number() OVER (PARTITION BY kanji_id ORDER BY id) AS place FROM meaning WHERE kanji_id IN (SELECT kanji_id FROM keys)", "kanji_id text place")(lambda k, x: k.kanji_meanings(x))
lookup("okurigana", [(8,), (3,)], "reading_id int", "SELECT DISTINCT reading_id, text FROM okurigana WHERE reading_id IN (SELECT reading_id FROM keys)")(lambda k, x: k.okurigana(x))
lookup(
    "reading_stats_rows", [("日", "にち", "ja_on"), ("食", "た", "ja_kun"), ("食", "た", "ja_on")], "text string, reading string, type string",
    "SELECT k.text, r.text AS reading, r.type, r.stat_common AS reading_common, k.stat_common, k.grade FROM kanji k JOIN reading r ON r.kanji_id = k.id JOIN keys x ON x.text = k.text AND x.reading = r.text AND x.type = r.type",
    "text reading type reading_common stat_common grade",
)(lambda k, x: k.reading_statistics(x))
lookup(
    "kanji_reading_pairs", [("日",), ("本",)], "text string",
    "SELECT k.text, r.text AS reading, r.type, row_number() OVER (PARTITION BY k.text ORDER BY r.id) AS place FROM kanji k JOIN reading r ON r.kanji_id = k.id WHERE r.type <> 'ja_na' AND k.text IN (SELECT text FROM keys)",
)(lambda k, x: k.kanji_reading_pairs(x, ["ja_na"]))


# --- functions ---------------------------------------------------------------


def function(name: str, rows: list[tuple], schema: str):
    """Register a function of columns: rows of its arguments and of ``out``, which it must give."""

    def add(f: Callable):
        given = schema.rsplit(",", 1)[0]
        names = [x.strip().split(" ")[0] for x in given.split(",")]

        def query(spark: SparkSession, d: str) -> DataFrame:
            data = spark.createDataFrame([r[:-1] for r in rows], given)
            return data.select(*names, f(*map(F.col, names)).alias("out"))

        known(name, rows, schema)(query)
        return f

    return add


_S = "a string, out string"
function("normalize", [("０", "0"), ("か゛", "が"), ("、", ", "), ("・・・・", "...  "), ("ｶﾞ", "ガ")], _S)(tx.normalize)
function("normalize_kana", [("ｱ", "ア"), ("か゛", "が"), ("、", "、"), ("は゜", "ぱ")], _S)(lambda a: tx.normalize(a, True))
function("as_hiragana", [("カタカナ日本ｱ", "かたかな日本あ"), ("ヴ", "ゔ")], _S)(tx.as_hiragana)
function("as_katakana", [("ひらがな", "ヒラガナ"), ("漢字", "漢字")], _S)(tx.as_katakana)
function("mora_length", [("きゃっと", 2), ("がっこう", 3), ("センター", 3)], "a string, out int")(tx.mora_length)
function("destem", [("食べたい", "食べ"), ("いく", "")], _S)(lambda a: tx.destem(a, 2))
function("get_char_class", [("ヴ", "vu"), ("か", "ka"), ("x", None)], _S)(tx.char_class_of)
function("test_word", [("ひらがな", True), ("ひらガな", False), ("", False)], "a string, out boolean")(lambda a: tx.in_class(a, "hiragana"))
function("count_char_class", [("日本のご飯", 3), ("かな", 0)], "a string, out int")(lambda a: tx.count_class(a, "kanji"))
function("collect_char_class", [("日本のご飯", "日,本,飯"), ("かな", "")], _S)(lambda a: F.array_join(tx.collect_class(a, "kanji"), ","))
function("split_by_regex", [("a12b3", "a|12|b|3"), ("abc", "abc")], _S)(lambda a: F.array_join(tx.split_by_regex(a, "[0-9]+"), "|"))
function("basic_split", [("Hello 世界！3月1日 2.5本", "Hello |世界*|！|3月1日*| 2.5|本*")], _S)(lambda a: F.array_join(F.transform(tx.basic_split(a), lambda p: F.concat(p["text"], F.when(p["matched"], "*").otherwise(""))), "|"))
function("consecutive_char_groups", [("十二月3日", "0:2 3:4"), ("かな", "")], _S)(lambda a: F.array_join(F.transform(tx.class_runs(a, "number"), lambda r: F.concat_ws(":", r["start"], r["stop"])), " "))
function("sequential_kanji_positions", [("日本語", "1 2"), ("日の本", "")], _S)(lambda a: F.array_join(F.transform(tx.kanji_boundaries(a), lambda i: i.cast("string")), " "))
function("kanji_mask", [("お茶を飲む", "お%を%む")], _S)(tx.kanji_mask)
function("kanji_match", [("お茶", "おちゃ", True), ("お茶", "にちゃ", False)], "a string, b string, out boolean")(tx.kanji_match)
function("kanji_cross_match", [("食べる", "たべる", "食べた", "たべた")], "a string, b string, c string, out string")(tx.kanji_cross_match)
function("kanji_prefix", [("お茶を飲む", "お茶を飲"), ("ひらがな", "")], _S)(tx.kanji_prefix)
function("rendaku", [("かみ", "がみ"), ("さけ", "ざけ"), ("まど", "まど")], _S)(tx.rendaku)
function("unrendaku", [("ガラス", "カラス"), ("ぱ", "は")], _S)(tx.unrendaku)
function("geminate", [("いち", "いっ"), ("", "")], _S)(tx.geminate)
function("safe_subseq", [("abc", "bc"), ("", None)], _S)(lambda a: tx.safe_substring(a, F.lit(1)))
function("match_diff", [("食べる", "たべる", "食/た べる/べる"), ("飲む", "のむ", "飲/の む/む")], "a string, b string, out string")(
    lambda a, b: F.array_join(F.transform(tx.match_diff(a, b)["blocks"], lambda x: F.concat_ws("/", x["left"], x["right"])), " ")
)
function("number_to_kanji", [(0, "〇"), (1000, "千"), (11_000, "一万千"), (1234, "千二百三十四"), (12_423_000_430, "百二十四億二千三百万四百三十")], "a long, out string")(numerals.number_to_kanji)
function("number_to_kana", [(0, "れい"), (300, "さんびゃく"), (3600, "さんぜんろっぴゃく"), (888, "はっぴゃくはちじゅうはち"), (10**12, "いっちょう")], "a long, out string")(numerals.number_to_kana)
function("parse_number", [("二〇二〇", 2020), ("百万", 1_000_000), ("100万500", 1_000_500), ("１２３", 123), ("一X", None)], "a string, out long")(lambda a: numerals.parse_number(a).cast("long"))
function("counter_join", [("三", "ほん", "", "さんぽん"), ("三", "ほん", "本", "さんぼん"), ("一", "ほん", "本", "いっぽん"), ("八", "かい", "回", "はっかい"), ("十", "ほん", "本", "じゅっぽん"), ("百", "ほん", "本", "ひゃっぽん")], "a string, b string, c string, out string")(counting.counter_reading)
function(
    "special_counters",
    [("一", "にん", "人", "ひとり"), ("二", "にん", "人", "ふたり"), ("三", "にん", "人", "さんにん"), ("二十", "さい", "歳", "はたち"), ("三", "にち", "日", "みっか"), ("四", "がつ", "月", "しがつ"), ("九", "つ", "つ", "ここのつ"), ("X", "にん", "人", None)],
    "a string, b string, c string, out string",
)(counting.counter_reading)
function("counter_value", [("三", "本", "Value: 3"), ("二十三", "日", "23rd"), ("十一", "日", "11th")], "a string, b string, out string")(counting.counter_value)
_WORDS = [("がっこう", "gakkō"), ("しんぶん", "shimbun"), ("まっちゃ", "matcha"), ("きんえん", "kin-en"), ("センター", "senta"), ("こんにちは", "konnichiha"), ("‌は", "wa"), ("っ", "!"), ("ー", "~")]
function("romanize_word", _WORDS, _S)(romaji.romanize_column)
for _method, _a, _out in (
    ("hepburn_basic", "きんえん", "kin'en"), ("hepburn_simple", "とうきょう", "tokyo"), ("hepburn_passport", "おおの", "ohno"), ("hepburn_traditional", "がっこう", "gakkō"),
    ("hepburn_modified", "おかあさん", "okāsan"), ("kunrei_siki", "しゃしん", "syasin"),
):
    function(_method, [(_a, _out)], _S)(lambda a, m=_method: romaji.romanize_column(a, m))
function("romanize_word_geo", [("とうきょう", "Tōkyō")], _S)(romaji.romanize_place)
function("strip_hints", [("‌は", "は"), ("に​ほん", "にほん")], _S)(romaji.strip_hints)
function("romaji_kana", [("kitte", "きって"), ("tokyo", "ときょ"), ("shimbun", "しんぶん"), ("x9", None)], _S)(lambda a: romaji.romaji_kana(a)["canonical"])
function("romaji_pattern", [("tokyo", "^とう?きょう?$"), ("kanji", "^かんじ$")], _S)(lambda a: romaji.romaji_kana(a)["pattern"])
function("split_pos", [("[n,vs]", "n|vs"), ("[adj-i]", "adj-i")], _S)(lambda a: F.array_join(senses.split_pos(a), "|"))
function("reading_str", [("世界", "せかい", "世界 【せかい】"), (None, "は", "は")], "a string, b string, out string")(senses.reading_text)
function("calculate_perc", [(1, 4, "25.00%"), (0, 0, "--.--%")], "a int, b int, out string")(kanji.share)
function("apply_patch", [("食べなさ", "食べない"), ("なさ", "ない")], _S)(lambda a: compounds.apply_patch(a, F.lit(1), F.lit("い")))
function("construct_conjugation", [("書く", 1, "いて", "", "", "書いて")], "a string, stem int, okuri string, euphr string, euphk string, out string")(lambda a, stem, okuri, euphr, euphk: conjugation.conjugated(a, stem, okuri, euphr, euphk))
function("find_sticky_positions", [("がっこう", "2"), ("きゃー", "1"), ("かあ", "")], _S)(lambda a: F.array_join(F.transform(segment.sticky_positions(a), lambda i: i.cast("string")), " "))
function("length_multiplier_coeff", [(1, 1), (3, 24), (5, 60), (7, 84)], "a int, out int")(lambda a: segment.length_weight(a, segment.STRONG))


# --- words and sentences -----------------------------------------------------


def _engine(spark: SparkSession):
    lex = small_lexicon.lexicon(spark)
    return lex, settled(segment.word_features(lex)), settled(small_lexicon.suffixes(lex))


_COMPOUNDS = [
    ("食べたい", "たべたい", "13,2017560"), ("食べたくない", "たべたくない", "13,10000008"), ("食べたくなかった", "たべたくなかった", "13,10000009"),
    ("食べちゃった", "たべちゃった", "13,10000011"), ("食べてしまいたい", "たべてしまいたい", "13,10000010,2017560"), ("食べている", "たべている", "13,1577980"),
    ("食べてる", "たべてる", "13,1577980"), ("読んでくれる", "よんで くれる", "7,1269130"), ("勉強した", "べんきょう した", "14,10000015"), ("高そう", "たかそう", "15,1006610"),
    ("高すぎる", "たかすぎる", "15,1195970"), ("高さ", "たかさ", "15,2029120"), ("食べねえ", "たべねえ", "13"), ("食べず", "たべず", "13"), ("食べなきゃ", "たべなきゃ", "13"), ("行きゃ", "いきゃ", "17"),
]


@known("find_word_suffix", _COMPOUNDS, "whole string, kana string, parts string")
def find_word_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Suffixes, chains of them, suffixes that rewrite their root, and contractions; parts are root entries."""
    lex, features, suffixes = _engine(spark)
    made = compounds.chains(spark.createDataFrame([(w,) for w, _, _ in _COMPOUNDS], "text string"), features, suffixes)
    whole = spark.createDataFrame([(w,) for w, _, _ in _COMPOUNDS], "whole string")
    first = F.coalesce(F.get(F.col("conj"), F.lit(0))["from"], F.col("seq"))
    rest = F.slice("parts", 2, F.size("parts"))
    parts = F.array_join(F.transform(F.concat(F.array(first), rest), lambda x: x.cast("string")), ",")
    return made.join(whole, "whole").where("kind = 'kanji'").select("whole", F.col("whole_kana").alias("kana"), parts.alias("parts")).distinct()


_LINES = [(1, "Hello 世界！"), (2, "私は日本語を読んで"), (4, "私xセンター"), (5, "日本語を読みたい"), (6, "本を読んでいる"), (7, "三本"), (8, "食べたくなかった")]
_ROMAJI = [(1, "Hello sekai! "), (2, "watashi ha nihongo wo yonde"), (4, "watashi x senta"), (5, "nihongo wo yomitai"), (6, "hon wo yondeiru"), (7, "sambon"), (8, "tabetakunakatta")]


@known("romanize", _ROMAJI, "id int, romaji string")
def romanize(spark: SparkSession, d: str) -> DataFrame:
    lex, features, suffixes = _engine(spark)
    texts = spark.createDataFrame([*_LINES, (3, ""), (9, None)], "id int, text string")
    return segment.romanized(segment.tokens(texts, features, suffixes=suffixes), "id")


_TOKENS = [(1, "Hello ", None), (1, "世界", 1), (1, "! ", None), (2, "私", 8), (2, "は", 2028920), (2, "日本語", 3), (2, "を", 2029010), (2, "読んで", 10_000_001), (4, "私", 8), (4, "x", None), (4, "センター", 11)]


@known("simple_segment", _TOKENS, "id int, token string, seq int")
def simple_segment(spark: SparkSession, d: str) -> DataFrame:
    lex, features, _ = _engine(spark)
    return segment.tokens(spark.createDataFrame(_LINES[:3], "id int, text string"), features).select("id", "token", "seq")


@known("calc_score", [("世界", 325)], "text string, score int")
def calc_score(spark: SparkSession, d: str) -> DataFrame:
    _, features, _ = _engine(spark)
    return segment.analysed(features, F.lit(False)).where("text = '世界'").select("text", "_a.score")


@known("find_word_info", [("世界", 1, "せかい"), ("日本", 2, "にほん")], "text string, seq int, kana string")
def find_word_info(spark: SparkSession, d: str) -> DataFrame:
    _, features, _ = _engine(spark)
    keys = spark.createDataFrame([("世界", None), ("日本", "にほん"), ("日本", "ふそう"), ("無い", None)], "text string, reading string")
    return words.word_info(keys, features).select("text", "seq", "kana")


@known("find_word_as_hiragana", [("ワタシ", 8, "わたし")], "text string, seq int, kana string")
def find_word_as_hiragana(spark: SparkSession, d: str) -> DataFrame:
    _, features, _ = _engine(spark)
    return words.as_hiragana(spark.createDataFrame([("ワタシ",), ("センター",), ("私",)], "text string"), features).select("text", "seq", "kana")


@known("romaji_suggest", [("sekai", "せかい", "セカイ", "世界"), ("yomu", "よむ", "ヨム", "読む")], "romaji string, hiragana string, katakana string, kanji string")
def romaji_suggest(spark: SparkSession, d: str) -> DataFrame:
    found = words.suggestions(spark.createDataFrame([("sekai",), ("yomu",), ("zzz9",)], "romaji string"), small_lexicon.lexicon(spark))
    return found.select("romaji", *[F.array_join(c, ",").alias(c) for c in ("hiragana", "katakana", "kanji")])


@known("get_senses_str", [(1, "1. [n] the world; society"), (12, "1. [n] book\n2. [ctr] counter for long things")], "seq int, text string")
def get_senses_str(spark: SparkSession, d: str) -> DataFrame:
    return senses.sense_text(senses.senses(small_lexicon.lexicon(spark), spark.createDataFrame([(1,), (12,)], "seq int")))


@known("entry_info_long", [(1, "世界 【せかい】", "1. [n] the world; society"), (11, "センター", "1. [n] centre")], "seq int, reading string, text string")
def entry_info_long(spark: SparkSession, d: str) -> DataFrame:
    return senses.entry_text(small_lexicon.lexicon(spark), spark.createDataFrame([(1,), (11,)], "seq int"))


@known("match_readings", [("日本", "にほん", "日=に* 本=ほん"), ("食べる", "たべる", "食=た べる=べる")], "text string, kana string, blocks string")
def match_readings(spark: SparkSession, d: str) -> DataFrame:
    lex = small_lexicon.lexicon(spark)
    readings = lex.kanji.select(F.col("id").alias("kanji_id"), F.col("text").alias("literal")).join(lex.reading.select("kanji_id", "text", "type"), "kanji_id")
    found = kanji.furigana(spark.createDataFrame([("日本", "にほん"), ("食べる", "たべる")], "text string, kana string"), readings)
    shown = F.transform("blocks", lambda b: F.concat(b["text"], F.lit("="), b["reading"], F.when(b["type"] == "irregular", "*").otherwise("")))
    return found.select("text", "kana", F.array_join(shown, " ").alias("blocks"))


@known("render_romanize", [(1, "Hello sekai! "), (2, "watashi ha nihongo wo yonde")], "id int, output string")
def render_romanize(spark: SparkSession, d: str) -> DataFrame:
    lex, features, _ = _engine(spark)
    return render(segment.tokens(spark.createDataFrame(_LINES[:2], "id int, text string"), features), lex, "id")


# --- analyses, splits, places ------------------------------------------------

_CHAINS = [("食べた", "2:食べる"), ("読んで", "3:読む"), ("食べられた", "5:食べる 2:食べられる"), ("食べない", "1:食べる")]


@known("flatten_conj", _CHAINS, "text string, steps string")
def flatten_conj(spark: SparkSession, d: str) -> DataFrame:
    lex = small_lexicon.lexicon(spark)
    keys = lex.kanji_text.join(spark.createDataFrame([(a,) for a, _ in _CHAINS], "text string"), "text").select("seq", "text")
    step = F.struct("step", F.concat_ws(":", "conj_type", "source_text").alias("s"))
    listed = analyses.chains(lex, keys).groupBy("text").agg(F.sort_array(F.collect_list(step)).alias("_s"))
    return listed.select("text", F.array_join(F.transform("_s", lambda x: x["s"]), " ").alias("steps"))


@known("get_original_text", [("食べられた", "食べる", 13), ("よんで", "よむ", 7)], "text string, source_text string, source int")
def get_original_text(spark: SparkSession, d: str) -> DataFrame:
    lex = small_lexicon.lexicon(spark)
    texts = lex.kanji_text.select("seq", "text").unionByName(lex.kana_text.select("seq", "text"))
    keys = texts.join(spark.createDataFrame([("食べられた",), ("よんで",)], "text string"), "text")
    return analyses.original_texts(lex, keys.select("seq", "text")).select("text", "source_text", "source")


lookup(
    "select_conjs", [(10_000_017, None), (10_000_018, None)], "seq int, text string",
    'SELECT c.seq, c.id AS conj_id, p.conj_type FROM conjugation c JOIN conj_prop p ON p.conj_id = c.id WHERE c.seq IN (SELECT seq FROM keys) AND (c.via IS NULL OR NOT EXISTS (SELECT 1 FROM conjugation o WHERE o.seq = c.seq AND o.via IS NULL))',
    "seq conj_id conj_type",
)(lambda k, x: analyses.selected(k.lex, x))
function("is_rareru", [("食べられる", True), ("食べられません", True), ("食べれる", False)], "a string, out boolean")(analyses.is_rareru)
function("conj_type_order", [(10, 13), (13, 10), (2, 2)], "a int, out int")(analyses.type_order)
function("simplify_reading_list", [("よんで くれる|よんでくれる", "よんで·くれる"), ("ほん を|ほん を", "ほん を"), ("あ|い", "あ|い")], _S)(lambda a: F.array_join(analyses.simplify_reading_list(F.split(a, "\\|")), "|"))
function("optprefix", [("ほん", "おほん"), ("おちゃ", "おちゃ")], _S)(lambda a: splits.optional_prefix(a, F.lit("お")))


@known("best_kana_conj", [("食べられた", "たべられた"), ("読んで", "よんで"), ("世界", "せかい"), ("高", "たか")], "text string, best string")
def best_kana_conj(spark: SparkSession, d: str) -> DataFrame:
    lex = small_lexicon.lexicon(spark)
    wanted = spark.createDataFrame([("食べられた",), ("読んで",), ("世界",), ("高",)], "text string")
    return lex.kanji_text.join(wanted, "text").select("id", "text").join(analyses.best_readings(lex), "id").select("text", "best")


@known("match_kana_kanji", [(8, "わたし", "私"), (8, "わたくし", "私"), (1, "せかい", "世界")], "seq int, reading string, kanji string")
def match_kana_kanji(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(8, "わたし", "私"), (8, "わたくし", "私"), (8, "わたくし", "他"), (1, "せかい", "世界")], "seq int, reading string, kanji string")
    return analyses.kana_kanji_allowed(small_lexicon.lexicon(spark), keys).select("seq", "reading", "kanji")


@known("process_word_info", [(1, 0, "なん"), (1, 1, "ばん"), (2, 0, "なに"), (2, 1, "か"), (3, 0, "なに")], "id int, token_no int, kana string")
def process_word_info(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, 0, 0, "何", "なに"), (1, 0, 1, "番", "ばん"), (2, 0, 0, "何", "なん"), (2, 0, 1, "か", "か"), (3, 0, 0, "何", "なに")]
    tokens = spark.createDataFrame(rows, "id int, run_no int, token_no int, token string, kana string")
    return analyses.reading_of_what(tokens, "id").select("id", "token_no", "kana")


@known("run_split", [(100, "日本語の本", -5, "2:日本 4:語 1469800:の 12:本")], "seq int, text string, score int, parts string")
def run_split(spark: SparkSession, d: str) -> DataFrame:
    rules = [(100, -5, 0, [2], "2", "entry", None), (100, -5, 1, [4], "1", "entry", None), (100, -5, 2, [1469800], "1", "entry", None), (100, -5, 3, [12], None, "entry", None), (101, 3, 0, [7], None, "derived", None)]
    given = spark.createDataFrame([(100, "日本語の本", []), (101, "無い", [])], "seq int, text string, conj_of array<int>")
    made = splits.split_words(given, spark.createDataFrame(rules, splits.SPLITS), small_lexicon.lexicon(spark))
    return made.select("seq", "text", "score", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["seq"], p["text"])), " ").alias("parts"))


@known("run_easy_hint", [("私は本", "わたし wa ほん")], "text string, shown string")
def run_easy_hint(spark: SparkSession, d: str) -> DataFrame:
    block = "array<struct<text:string,reading:string,type:string>>"
    words_ = spark.createDataFrame([(5, "私は本", "わたしはほん", [("私", "わたし", "ja_kun"), ("は", "は", "kana"), ("本", "ほん", "ja_on")])], f"seq int, text string, kana string, blocks {block}")
    found = splits.with_hints(words_, spark.createDataFrame([(5, "私 は 本")], "seq int, form string"))
    shown = F.replace(F.replace(F.col("kana"), F.lit(romaji.BREAK), F.lit(" ")), F.lit(romaji.PARTICLE + "は"), F.lit("wa"))
    return found.select("text", shown.alias("shown"))


_PLACES = [("東京都", "とうきょうと", "Tokyo Metropolis"), ("東京", "とうきょう", "Tokyo Metropolis"), ("北海道", "ほっかいどう", "Hokkaido"), ("横浜市", "よこはまし", "Yokohama (city), Kanagawa Prefecture"), ("横浜", "よこはま", "Yokohama (city), Kanagawa Prefecture")]


@known("municipalities", _PLACES, "text string, reading string, definition string")
def municipalities(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "東京都", None, "ﾄｳｷｮｳﾄ", None), (2, "北海道", None, "ﾎｯｶｲﾄﾞｳ", None), (3, "神奈川県", "横浜市", "ｶﾅｶﾞﾜｹﾝ", "ﾖｺﾊﾏｼ")]
    return places.municipalities(spark.createDataFrame(rows, "id int, pref string, muni string, pref_reading string, muni_reading string"))


@known("wards", [("中区", "なかく", "Naka Ward, Yokohama"), ("西区", "にしく", "Nishi Ward, Yokohama")], "text string, reading string, definition string")
def wards(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "横浜市", "よこはまし"), (2, "横浜市中区", "よこはましなかく"), (3, "横浜市西区", "よこはましにしく")]
    return places.wards(spark.createDataFrame(rows, "id int, text string, reading string"))


function("normalize_geo", [("Tōkyō", "tokyo"), ("Kyūshū", "kyushu")], _S)(places.normalize_geo)
function(
    "as_xml", [("東京", "とうきょう", "Tokyo & more", '<?xml version="1.0" encoding="UTF-8"?>\n<entry><ent_seq></ent_seq><k_ele><keb>東京</keb></k_ele><r_ele><reb>とうきょう</reb></r_ele><sense><pos>n</pos><gloss>Tokyo &amp; more</gloss></sense></entry>')],
    "a string, b string, c string, out string",
)(places.entry_xml)


_DERIVED = [("食べられる", 13, None, 5, "食べる"), ("食べた", 13, None, 2, "食べる"), ("食べられた", 13, "食べられる", 2, "食べられる"), ("たべられる", 13, None, 5, "たべる"), ("たべた", 13, None, 2, "たべる"), ("たべられた", 13, "食べられる", 2, "たべられる")]


@known("load_secondary_conjugations", _DERIVED, "text string, source int, via string, conj_type int, source_text string")
def load_secondary_conjugations(spark: SparkSession, d: str) -> DataFrame:
    """Direct and secondary forms of a verb, written into the tables and read back from them."""
    lex = small_lexicon.Lexicon.of(spark, small_lexicon.assemble([e for e in small_lexicon.ENTRIES if e["seq"] == 13]))
    lex = small_lexicon.Lexicon(lex.tables | {n: lex.tables[n].withColumn("conjugate_p", F.lit(True)) for n in ("kanji_text", "kana_text")})
    rules = spark.createDataFrame(
        [(28, 2, False, False, 1, 1, "た", "", ""), (28, 5, False, False, 1, 1, "られる", "", "")],
        "pos int, conj int, neg boolean, fml boolean, onum int, stem int, okuri string, euphr string, euphk string",
    )
    made = conjugation.with_conjugations(lex, rules, spark.createDataFrame([(28, "v1")], "pos int, kw string"))
    links = made.conjugation.select(F.col("id").alias("conj_id"), "seq", "from", "via").join(made.conj_prop.select("conj_id", "conj_type"), "conj_id")
    via = made.kanji_text.where("ord = 0").select(F.col("seq").alias("via"), F.col("text").alias("via_text"))
    forms = made.kanji_text.select("seq", "text").unionByName(made.kana_text.select("seq", "text"))
    found = links.join(made.conj_source_reading.select("conj_id", "text", "source_text"), "conj_id").join(forms, ["seq", "text"]).join(via, "via", "left")
    return found.select("text", F.col("from").alias("source"), F.col("via_text").alias("via"), "conj_type", "source_text")


# --- corrections and characters ----------------------------------------------


def correction(name: str, rows: list[tuple], schema: str):
    """Register a patch and what a table of the patched lexicon must then hold."""

    def add(f: Callable[[SparkSession, small_lexicon.Lexicon], DataFrame]):
        known(name, rows, schema)(lambda spark, d: f(spark, small_lexicon.lexicon(spark)))
        return f

    return add


@correction("add_sense", [(1, 0, "the world; society"), (1, 1, "universe; era")], "seq int, ord int, glosses string")
def add_sense(spark, lex):
    rows = spark.createDataFrame([(1, ["n"], ["universe", "era"]), (1, ["n"], ["the world", "society"])], "seq int, pos array<string>, glosses array<string>")
    return Lookups(patches.add_senses(rows)(lex)).sense_glosses(spark.createDataFrame([(1,)], "seq int")).select("seq", "ord", "glosses")


@correction("add_gloss", [(2, "Japan; Nippon")], "seq int, glosses string")
def add_gloss(spark, lex):
    rows = spark.createDataFrame([(2, 0, "Nippon")], "seq int, sense_ord int, text string")
    return Lookups(patches.add_glosses(rows)(lex)).sense_glosses(spark.createDataFrame([(2,)], "seq int")).select("seq", "glosses")


@correction("add_conj", [(8, "わたし", "よむ", 2)], "seq int, text string, source_text string, conj_type int")
def add_conj(spark, lex):
    rows = spark.createDataFrame([(8, 7, None, 2, "v5m", False, False, [("わたし", "よむ")])], "seq int, from int, via int, conj_type int, pos string, neg boolean, fml boolean, readings array<struct<text:string,source_text:string>>")
    made = patches.add_links(rows)(lex)
    links = made.conjugation.where("seq = 8").select(F.col("id").alias("conj_id"), "seq")
    return links.join(made.conj_source_reading, "conj_id").join(made.conj_prop.select("conj_id", "conj_type"), "conj_id").select("seq", "text", "source_text", "conj_type")


@correction("find_conj", [("食べない",)], "text string")
def find_conj(spark, lex):
    keys = spark.createDataFrame([(13, 1, "v1", True, False)], "from int, conj_type int, pos string, neg boolean, fml boolean")
    found = patches.find_links(lex, keys).join(lex.conjugation.select("id", "seq"), "id")
    return lex.kanji_text.join(found.select("seq"), "seq").select("text")


@correction("replace_reading_conj", [("くった",)], "text string")
def replace_reading_conj(spark, lex):
    made = patches.replace_prefix("kana", spark.createDataFrame([(13, "たべ", "くっ")], "from int, prefix string, new string"))(lex)
    return made.kana_text.where("text = 'くった'").select("text")


@correction("load_best_readings", [("日本", "にほん"), ("食べられた", "たべられた"), ("私", "わたくし")], "text string, best_kana string")
def load_best_readings(spark, lex):
    return patches.reset_best(lex).kanji_text.where("text IN ('日本', '食べられた', '私')").select("text", "best_kana")


@correction("add_deha_ja_readings", [("ではない", 0), ("じゃない", 1)], "text string, ord int")
def add_deha_ja_readings(spark, lex):
    more = small_lexicon.Lexicon.of(spark, small_lexicon.assemble([*small_lexicon.ENTRIES, small_lexicon._derived(small_lexicon.D + 50, 2089020, 1, "cop", [("ではない", "だ")], True, False)]))
    return patches.add_spoken_forms()(more).kana_text.where("text LIKE '%ない' AND seq = 10000050").select("text", "ord")


@correction("get_all_readings", [(8, "私"), (8, "わたし"), (8, "わたくし")], "seq int, text string")
def get_all_readings(spark, lex):
    return patches.all_readings(lex, spark.createDataFrame([(8,)], "seq int"))


@correction("pin_ambiguous_sense_prop_order", [(4, "n", 0), (4, "n-suf", 1)], "seq int, text string, ord int")
def pin_ambiguous_sense_prop_order(spark, lex):
    same = small_lexicon.Lexicon(lex.tables | {"sense_prop": lex.sense_prop.withColumn("ord", F.lit(0))})
    return patches.distinct_order(same).sense_prop.where("seq = 4").select("seq", "text", "ord")


@correction("kanji_info_json", [("食", "た:55.56%,しょく:44.44%", "eat", 2)], "text string, readings string, meanings string, grade int")
def kanji_info_json(spark, lex):
    made = kanji.documents(lex, spark.createDataFrame([("食",)], "text string"))
    back = F.from_json("json", "text string, grade int, readings array<struct<reading:string,perc:string>>, meanings array<string>")
    return made.select("text", back.alias("d")).select("text", F.array_join(F.transform("d.readings", lambda r: F.concat_ws(":", r["reading"], r["perc"])), ",").alias("readings"), F.array_join("d.meanings", ",").alias("meanings"), "d.grade")


function("get_original_reading", [("がっ", True, "く", "かく"), ("ほん", False, None, "ほん")], "a string, b boolean, c string, out string")(kanji.original_reading)


@known("find_kanji_for_pattern", [("にほん", "日本"), ("にっぽん", "日本"), ("にほんご", "日本語")], "kana string, kanji string")
def find_kanji_for_pattern(spark: SparkSession, d: str) -> DataFrame:
    return words.by_pattern(small_lexicon.lexicon(spark), "^に").select("kana", "kanji").where("kanji IS NOT NULL")


_BREAKS = [("日本語", "1 2"), ("本世界", "2")]


@known("kanji_breaks", _BREAKS, "run string, breaks string")
def kanji_breaks(spark: SparkSession, d: str) -> DataFrame:
    rows = [("日本語", 0, 2, "日本"), ("日本語", 0, 3, "日本語"), ("日本語", 2, 3, "語"), ("本世界", 0, 1, "本"), ("本世界", 1, 3, "世界"), ("食べ世", 1, 2, "べ")]
    found = segment.kanji_breaks(spark.createDataFrame(rows, "run string, start int, stop int, text string"))
    return found.select("run", F.array_join(F.transform("breaks", lambda i: i.cast("string")), " ").alias("breaks"))


@known("kanji_break_penalty", [(21, "a", 11), (21, "b", 21), (20, "c", 22), (4, "a", 4), (6, "a", 5)], "score int, kind string, out int")
def kanji_break_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = [(21, "a", True, False, "語", ["n"], [4]), (21, "b", False, False, "語", ["n"], [4]), (20, "c", False, True, "不", ["pref"], [6]), (4, "a", True, True, "語", ["n"], [4]), (6, "a", True, True, "語", ["n"], [4])]
    data = spark.createDataFrame(rows, "score int, kind string, at_start boolean, at_stop boolean, text string, posi array<string>, seqs array<int>")
    return data.select("score", "kind", segment.break_cost(F.col("score"), F.col("at_start"), F.col("at_stop"), F.col("text"), F.col("posi"), F.col("seqs")).alias("out"))


@known("cull_alternatives", [("日本語", 0, 3, "3")], "run string, start int, stop int, seqs string")
def cull_alternatives(spark: SparkSession, d: str) -> DataFrame:
    _, features, _ = _engine(spark)
    solved = settled(segment.solve(spark.createDataFrame([("日本語",)], "run string"), features))
    found = analyses.alternatives(solved)
    return found.select("run", "start", "stop", F.array_join(F.transform("words", lambda w: w["seq"].cast("string")), ",").alias("seqs"))


@known("ranked_paths", [("日本語", 0, "日本語"), ("日本語", 1, "日本 語")], "run string, rank int, words string")
def ranked_paths(spark: SparkSession, d: str) -> DataFrame:
    _, features, _ = _engine(spark)
    solved = segment.solve(spark.createDataFrame([("日本語",)], "run string"), features)
    return analyses.ranked_paths(solved).where("rank < 2").select("run", "rank", F.array_join("words", " ").alias("words"))
