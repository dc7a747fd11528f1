"""A small lexicon: what the engine's own queries run on, and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.lexicon import SCHEMAS, Lexicon, assemble

D = 10_000_000  # entries of derived forms


def _derived(seq: int, source: int, kind: int, pos: str, pairs: list[tuple[str, str]], neg=None, fml=None, via=None) -> dict:
    """A derived entry; forms with kanji are kanji forms."""
    is_kana = lambda x: all("ぁ" <= c <= "ー" for c in x)
    return {
        "seq": seq, "kanji": [(a, None) for a, _ in pairs if not is_kana(a)], "kana": [(a, None) for a, _ in pairs if is_kana(a)],
        "conjugations": [(source, via, kind, pos, neg, fml, pairs)],
    }


ENTRIES = [
    {"seq": 1, "kanji": [("世界", 1)], "kana": [("せかい", 1)], "senses": [(["n"], [], ["the world", "society"])]},
    {"seq": 2, "kanji": [("日本", 1)], "kana": [("にほん", 1), ("にっぽん", None)], "senses": [(["n"], [], ["Japan"])]},
    {"seq": 3, "kanji": [("日本語", 3)], "kana": [("にほんご", 3)], "senses": [(["n"], [], ["Japanese (language)"])]},
    {"seq": 4, "kanji": [("語", 5)], "kana": [("ご", 5)], "senses": [(["n", "n-suf"], [], ["word"])]},
    {"seq": 7, "kanji": [("読む", 2)], "kana": [("よむ", 2)], "senses": [(["v5m", "vt"], [], ["to read"])]},
    {"seq": 8, "kanji": [("私", 1)], "kana": [("わたし", 1), ("わたくし", 2)], "senses": [(["pn"], [], ["I", "me"])]},
    {"seq": 9, "kanji": [("有る", 4)], "kana": [("ある", 4)], "senses": [(["v5r-i"], ["uk"], ["to be"])]},
    {"seq": 10, "kanji": [("古語", None)], "kana": [("ふるご", None)], "senses": [(["n"], ["arch"], ["old word"])]},
    {"seq": 11, "kana": [("センター", 1)], "senses": [(["n"], [], ["centre"])]},
    {"seq": 12, "kanji": [("本", 1)], "kana": [("ほん", 1)], "senses": [(["n"], [], ["book"]), (["ctr"], [], ["counter for long things"])]},
    {"seq": 13, "kanji": [("食べる", 1)], "kana": [("たべる", 1)], "senses": [(["v1", "vt"], [], ["to eat"])]},
    {"seq": 14, "kanji": [("勉強", 1)], "kana": [("べんきょう", 1)], "senses": [(["n", "vs"], [], ["study"])]},
    {"seq": 15, "kanji": [("高い", 1)], "kana": [("たかい", 1)], "senses": [(["adj-i"], [], ["high", "expensive"])]},
    {"seq": 16, "kanji": [("静か", 1)], "kana": [("しずか", 1)], "senses": [(["adj-na"], [], ["quiet"])]},
    {"seq": 17, "kanji": [("行く", 1)], "kana": [("いく", 1)], "senses": [(["v5k-s", "vi"], [], ["to go"])]},
    {"seq": 1157170, "kanji": [("為る", None)], "kana": [("する", 1)], "senses": [(["vs-i"], ["uk"], ["to do"])]},
    {"seq": 1577980, "kanji": [("居る", 1)], "kana": [("いる", 1)], "senses": [(["v1"], ["uk"], ["to be"])]},
    {"seq": 1305380, "kanji": [("仕舞う", None)], "kana": [("しまう", 1)], "senses": [(["v5u"], ["uk"], ["to finish"])]},
    {"seq": 2013800, "kana": [("ちゃう", 1)], "senses": [(["v5u", "aux"], [], ["to do completely"])]},
    {"seq": 2017560, "kana": [("たい", 3)], "senses": [(["aux-adj"], [], ["want to"])]},
    {"seq": 1006610, "kana": [("そう", 1)], "senses": [(["aux"], [], ["looking like"])]},
    {"seq": 1195970, "kanji": [("過ぎる", 1)], "kana": [("すぎる", 1)], "senses": [(["v1"], [], ["to exceed"])]},
    {"seq": 1269130, "kana": [("くれる", 1)], "senses": [(["v1"], [], ["to give"])]},
    {"seq": 2028920, "kana": [("は", 0)], "senses": [(["prt"], [], ["topic marker"])]},
    {"seq": 2029010, "kana": [("を", 0)], "senses": [(["prt"], [], ["object marker"])]},
    {"seq": 1469800, "kana": [("の", 0)], "senses": [(["prt"], [], ["possessive"])]},
    {"seq": 2029120, "kana": [("さ", 0)], "senses": [(["prt"], [], ["-ness"])]},
    {"seq": 2089020, "kana": [("だ", 0)], "senses": [(["cop"], [], ["to be"])]},
    _derived(D + 1, 7, 3, "v5m", [("読んで", "読む"), ("よんで", "よむ")], False, False),
    _derived(D + 2, 7, 13, "v5m", [("読み", "読む"), ("よみ", "よむ")]),
    _derived(D + 3, 13, 3, "v1", [("食べて", "食べる"), ("たべて", "たべる")], False, False),
    _derived(D + 4, 13, 13, "v1", [("食べ", "食べる"), ("たべ", "たべる")]),
    _derived(D + 5, 13, 1, "v1", [("食べない", "食べる"), ("たべない", "たべる")], True, False),
    _derived(D + 6, 13, 2, "v1", [("食べた", "食べる"), ("たべた", "たべる")], False, False),
    _derived(D + 7, 13, 4, "v1", [("食べなければ", "食べる"), ("たべなければ", "たべる")], True, False),
    _derived(D + 8, 2017560, 1, "aux-adj", [("たくない", "たい")], True, False),
    _derived(D + 9, 2017560, 2, "aux-adj", [("たくなかった", "たい")], True, False),
    _derived(D + 10, 1305380, 13, "v5u", [("しまい", "しまう")]),
    _derived(D + 11, 2013800, 2, "v5u", [("ちゃった", "ちゃう")], False, False),
    _derived(D + 12, 15, 51, "adj-i", [("高", "高い"), ("たか", "たかい")]),
    _derived(D + 13, 15, 50, "adj-i", [("高く", "高い"), ("たかく", "たかい")]),
    _derived(D + 14, 1157170, 13, "vs-i", [("し", "する")]),
    _derived(D + 15, 1157170, 2, "vs-i", [("した", "する")], False, False),
    _derived(D + 16, 17, 4, "v5k-s", [("行けば", "行く"), ("いけば", "いく")], False, False),
    _derived(D + 17, 13, 5, "v1", [("食べられる", "食べる"), ("たべられる", "たべる")], False, False),
    _derived(D + 18, 13, 2, "v1", [("食べられた", "食べられる"), ("たべられた", "たべられる")], False, False, D + 17),
]
#: Characters: id, literal, radicals, grade, strokes, frequency and statistics; readings; meanings.
KANJI = [(1, "日", 72, 72, 1, 4, 1, 20, 2), (2, "本", 75, 75, 1, 5, 10, 12, 0), (3, "食", 184, 184, 2, 9, 328, 9, 0)]
READINGS = [
    (1, 1, "ja_on", "にち", False, False, 12), (2, 1, "ja_on", "じつ", False, False, 3), (3, 1, "ja_kun", "ひ", False, False, 5), (4, 1, "ja_na", "あき", False, False, 0),
    (5, 2, "ja_on", "ほん", False, False, 9), (6, 2, "ja_kun", "もと", False, False, 3), (7, 3, "ja_on", "しょく", False, False, 4), (8, 3, "ja_kun", "た", False, False, 5),
]
OKURIGANA = [(1, 8, "べる"), (2, 8, "べる"), (3, 3, "び")]
MEANINGS = [(1, 1, "day"), (2, 1, "sun"), (3, 2, "book"), (4, 3, "eat")]
RESTRICTED = [(1, 8, "わたくし", "私")]
#: The suffixes that the small lexicon has.
SUFFIX_WORDS = [("chau", 2013800, "chau"), ("te", 1305380, "chau"), ("tai", 2017560, "tai"), ("suru", 1157170, "suru"), ("sou", 1006610, "sou"), ("sugiru", 1195970, "sugiru"), ("te+space", 1269130, "kureru")]
SUFFIX_FORMS = [("sa", 2029120, "さ", "さ", "sa")]


def rows() -> dict[str, list[tuple]]:
    return assemble(ENTRIES) | {"kanji": KANJI, "reading": READINGS, "okurigana": OKURIGANA, "meaning": MEANINGS, "restricted_readings": RESTRICTED}


def lexicon(spark: SparkSession) -> Lexicon:
    return Lexicon.of(spark, rows())


def suffixes(lex: Lexicon) -> DataFrame:
    from ..operators.compounds import suffix_forms

    return suffix_forms(lex, SUFFIX_WORDS, SUFFIX_FORMS)


def as_sql() -> str:
    """The tables as common table expressions."""
    made = rows()

    def show(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    out = []
    for name, schema in SCHEMAS.items():
        fields = [f.strip().split(" ") for f in schema.split(",")]
        names = ", ".join(f'"{f[0].strip("`")}"' for f in fields)
        cast = ", ".join(f'CAST("{f[0].strip("`")}" AS {"VARCHAR" if f[1] == "string" else f[1]}) AS "{f[0].strip("`")}"' for f in fields)
        values = ", ".join("(" + ", ".join([*map(show, row), str(i)]) + ")" for i, row in enumerate(made[name])) or "(" + ", ".join(["NULL"] * (len(fields) + 1)) + ")"
        where = "" if made[name] else " WHERE false"
        out.append(f"{name} AS (SELECT {cast}, ordinal FROM (VALUES {values}) v({names}, ordinal){where})")
    return ",\n".join(out)
