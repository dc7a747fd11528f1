"""A small lexicon for the tests."""

ENTRIES = [
    {"seq": 1, "kanji": [("世界", 1)], "kana": [("せかい", 1)], "senses": [(["n"], [], ["the world", "society"])]},
    {"seq": 2, "kanji": [("日本", 1)], "kana": [("にほん", 1), ("にっぽん", None)], "senses": [(["n"], [], ["Japan"])]},
    {"seq": 3, "kanji": [("日本語", 3)], "kana": [("にほんご", 3)], "senses": [(["n"], [], ["Japanese (language)"])]},
    {"seq": 4, "kanji": [("語", 5)], "kana": [("ご", 5)], "senses": [(["n", "n-suf"], [], ["word"])]},
    {"seq": 5, "kana": [("は", 0)], "senses": [(["prt"], [], ["topic marker"])]},
    {"seq": 6, "kana": [("を", 0)], "senses": [(["prt"], [], ["object marker"])]},
    {"seq": 7, "kanji": [("読む", 2)], "kana": [("よむ", 2)], "senses": [(["v5m", "vt"], [], ["to read"])]},
    {
        "seq": 10_000_001, "kanji": [("読んで", None)], "kana": [("よんで", None)],
        "conjugations": [(7, None, 3, "v5m", False, False, [("読んで", "読む"), ("よんで", "よむ")])],
    },
    {"seq": 10_000_002, "kanji": [("読み", None)], "kana": [("よみ", None)], "conjugations": [(7, None, 13, "v5m", None, None, [("読み", "読む"), ("よみ", "よむ")])]},
    {"seq": 20, "kana": [("たい", 3)], "senses": [(["aux-adj"], [], ["want to"])]},
    {"seq": 21, "kana": [("いる", 1)], "senses": [(["v1"], [], ["to be doing"])]},
    {"seq": 8, "kanji": [("私", 1)], "kana": [("わたし", 1), ("わたくし", 2)], "senses": [(["pn"], [], ["I", "me"])]},
    {"seq": 9, "kanji": [("有る", 4)], "kana": [("ある", 4)], "senses": [(["v5r-i"], ["uk"], ["to be"])]},
    {"seq": 10, "kanji": [("古語", None)], "kana": [("ふるご", None)], "senses": [(["n"], ["arch"], ["old word"])]},
    {"seq": 11, "kana": [("センター", 1)], "senses": [(["n"], [], ["centre"])]},
    {"seq": 12, "kanji": [("本", 1)], "kana": [("ほん", 1)], "senses": [(["n"], [], ["book"]), (["ctr"], [], ["counter for long things"])]},
]
