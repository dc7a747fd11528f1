"""Kana, their classes, and marks."""

from __future__ import annotations

# The morae by consonant and vowel, then those without a row.
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの",
    "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ",
    "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
}
SINGLE = {"ya": "や", "yu": "ゆ", "yo": "よ", "wa": "わ", "wi": "ゐ", "we": "ゑ", "wo": "を", "n": "ん", "vu": "ゔ"}
#: Names that are not consonant + vowel.
NAMES = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "dji", "du": "dzu"}
SMALL = {"+a": "ぁ", "+i": "ぃ", "+u": "ぅ", "+e": "ぇ", "+o": "ぉ", "+ya": "ゃ", "+yu": "ゅ", "+yo": "ょ", "+wa": "ゎ"}
SOKUON, LONG, REPEAT, REPEAT_VOICED = "sokuon", "long-vowel", "iter", "iter-v"

#: Hiragana and katakana are this far apart.
KATAKANA = ord("ア") - ord("あ")


def katakana(text: str) -> str:
    return "".join(chr(ord(c) + KATAKANA) if "ぁ" <= c <= "ゔ" else c for c in text)


MORAE: dict[str, str] = {NAMES.get(c + v, c + v): kana for c, row in ROWS.items() for v, kana in zip("aiueo", row, strict=True)} | SINGLE
#: class -> hiragana, katakana
CLASSES: dict[str, str] = {name: kana + katakana(kana) for name, kana in (MORAE | SMALL).items()} | {
    SOKUON: "っッ", LONG: "ー", REPEAT: "ゝヽ", REPEAT_VOICED: "ゞヾ",
}
CLASS_OF: dict[str, str] = {c: name for name, chars in CLASSES.items() for c in chars}
# Fixed values.
MODIFIERS = (*SMALL, LONG)

# Voiced counterpart of each mora, by rows; and of u.
VOICED = {a: b for x, y in ("kg", "sz", "td", "hb") for a, b in zip(ROWS[x], ROWS[y], strict=True)} | {"う": "ゔ"}
HALF_VOICED = dict(zip(ROWS["h"], ROWS["p"], strict=True))
UNVOICED = {b: a for a, b in VOICED.items()} | {b: a for a, b in HALF_VOICED.items()}
#: The same with katakana.
VOICED |= {katakana(a): katakana(b) for a, b in VOICED.items()}
HALF_VOICED |= {katakana(a): katakana(b) for a, b in HALF_VOICED.items()}
UNVOICED |= {katakana(a): katakana(b) for a, b in UNVOICED.items()}

# Marks and what they are written as.
PUNCTUATION = [
    ("【", " ["), ("】", "] "), ("、", ", "), ("，", ", "), ("。", ". "), ("・・・", "... "), ("・", " "), ("　", " "), ("「", ' "'),
    ("」", '" '), ("゛", '"'), ("『", " «"), ("』", "» "), ("〜", " - "), ("：", ": "), ("！", "! "), ("？", "? "), ("；", "; "),
]
HALF_WIDTH = "･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_WIDTH = "・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
#: Full-width forms of these ASCII characters count as abnormal; < ' and ~ have forms of their own.
NARROW = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&()*+/=>?@[]^_{|}"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in NARROW) + "〈‘～"
ABNORMAL, NORMAL = WIDE + HALF_WIDTH, NARROW + "<`~" + FULL_WIDTH

# Character classes.
_KANJI, _KATA, _HIRA = "々ヶ〆一-龯", "ァ-ヺヽヾ", "ぁ-ゔゝゞー"
CHARACTER_CLASSES = {
    "katakana": f"[{_KATA}ー]",
    "katakana_uniq": f"[{_KATA}]",
    "hiragana": f"[{_HIRA}]",
    "kanji": f"[{_KANJI}]",
    "kanji_char": "[一-龯]",
    "kana": f"[{_KATA}{_HIRA}]",
    "traditional": f"[{_HIRA}{_KANJI}]",
    "nonword": f"[^{_KANJI}{_KATA}{_HIRA}〇]",
    "number": "[0-9０-９〇一二三四五六七八九零壱弐参拾十百千万億兆京]",
}
WORD = f"[{_KANJI}{_KATA}{_HIRA}〇]"
NUMBER_OR_WORD = f"[0-9０-９〇{_KANJI}{_KATA}{_HIRA}]"
DIGIT = "[0-9０-９〇]"
