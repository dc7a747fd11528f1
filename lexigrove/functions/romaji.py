"""Romanization and its inverse."""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import tables as t

VOWELS = "aiueo"
# Marks that guide reading.  A break is read as a space; before は and へ
# the other mark gives their reading as particles, elsewhere it is not read.
BREAK, PARTICLE = "\u200b", "\u200c"
HINTED = {BREAK: " ", PARTICLE + "は": "わ", PARTICLE + "ハ": "ワ", PARTICLE + "へ": "え", PARTICLE + "ヘ": "エ", PARTICLE: ""}
_HINTED = re.compile("|".join(HINTED))


def apply_hints(kana: str) -> str:
    return _HINTED.sub(lambda m: HINTED[m[0]], kana)


def strip_hints(kana: Column) -> Column:
    return F.translate(kana, BREAK + PARTICLE, "")


@dataclass(frozen=True)
class Method:
    """A way to romanize: letters of each class, glides that fuse, long vowels."""

    name: str
    letters: dict[str, str] = field(hash=False)
    fused: bool
    long: tuple[tuple[str, str], ...] = ()
    labial_m: bool = False
    hyphen: bool = False


def _letters(**other: str) -> dict[str, str]:
    base = {name: name for name in t.MORAE} | {"dji": "ji", "dzu": "zu", "n": "n'"}
    return base | {small: small[1:] for small in t.SMALL} | other


# The letters of kunrei-siki that differ, and the long vowels of each method.
_KUNREI = {"shi": "si", "chi": "ti", "tsu": "tu", "fu": "hu", "ji": "zi", "dji": "zi", "wi": "i", "we": "e", "wo": "o"}
_MACRON = (("oo", "ō"), ("ou", "ō"), ("uu", "ū"))
METHODS = {
    m.name: m
    for m in (
        Method("hepburn_basic", _letters(), True),
        Method("hepburn_simple", _letters(), True, (("oo", "o"), ("ou", "o"), ("uu", "u"))),
        Method("hepburn_passport", _letters(), True, (("oo", "oh"), ("ou", "oh"), ("uu", "u"))),
        Method("hepburn_traditional", _letters(), True, _MACRON, labial_m=True, hyphen=True),
        Method("hepburn_modified", _letters(wo="o"), True, (*_MACRON, ("aa", "ā"), ("ee", "ē"))),
        Method("kunrei_siki", _letters(**_KUNREI), False, (("oo", "ô"), ("ou", "ô"), ("uu", "û"))),
    )
}
DEFAULT = "hepburn_traditional"
#: Glides that fuse with the consonant before them.
FUSED = {"shi": "sh", "chi": "ch", "ji": "j", "dji": "j"}


def _atoms(text: str) -> list[str]:
    """Kana classes, other characters as they are; iteration marks expanded."""
    out: list[str] = []
    held = None
    for c in text:
        name = t.CLASS_OF.get(c, c)
        if name in (t.REPEAT, t.REPEAT_VOICED):
            if held is not None:
                kana = t.CLASSES.get(held, held)[0]
                out.append(t.CLASS_OF.get(t.VOICED.get(kana, kana), held) if name == t.REPEAT_VOICED else held)
        else:
            out.append(name)
            held = name
    return out


def _unit(method: Method, atom: str, modifiers: list[str]) -> str:
    """The letters of one mora with its small kana and long mark."""
    text = method.letters.get(atom, atom) if atom else ""
    bare = bool(atom)
    for m in modifiers:
        if m == t.LONG:
            bare = False
            continue
        glide = method.letters[m]
        if method.fused and bare and atom in FUSED and m in ("+ya", "+yu", "+yo"):
            text = FUSED[atom] + m[2:]
        elif bare and atom == "u":
            text = "w" + glide
        elif bare and atom in ("a", "i", "e", "o"):
            text += glide
        else:
            text = text[:-1] + glide
        bare = False
    return text


def _spell(method: Method, atoms: list[str]) -> str:
    out, i = [], 0
    while i < len(atoms):
        if atoms[i] == t.SOKUON:
            rest = _spell(method, atoms[i + 1 :])
            following = next((a for a in atoms[i + 1 :] if a != t.SOKUON), "")
            double = "t" if method.fused and following == "chi" else rest[:1] if rest[:1].isascii() else ""
            return "".join(out) + double + rest
        atom, i = (("", i) if atoms[i] in t.MODIFIERS else (atoms[i], i + 1))
        stop = i
        while stop < len(atoms) and atoms[stop] in t.MODIFIERS:
            stop += 1
        out.append(_unit(method, atom, atoms[i:stop]))
        i = stop
    return "".join(out)


def _simplified(method: Method, text: str) -> str:
    text = re.sub("n'([^aiueoy]|$)", r"n\1", text)
    if method.long:
        table = dict(method.long)
        text = re.sub("|".join(table), lambda m: table[m[0]], text)
    if method.hyphen:
        text = re.sub("n'([aiueoy])", r"n-\1", text)
    return re.sub("n([mbp])", r"m\1", text) if method.labial_m else text


def romanize(word: str, method: str = DEFAULT, spelled: str | None = None) -> str:
    """The romaji of a word in normalised kana."""
    special = {"っ": "!", "ー": "~"}.get(spelled or word)
    if special:
        return special
    how = METHODS[method]
    return _simplified(how, _spell(how, _atoms(apply_hints(word))))


def romanize_column(word: Column, method: str = DEFAULT) -> Column:
    @F.pandas_udf("string")
    def romanized(s: pd.Series) -> pd.Series:
        cache: dict[str, str] = {}
        return s.map(lambda x: None if x is None else cache.get(x) or cache.setdefault(x, romanize(x, method)))

    return romanized(word)


def romanize_place(word: Column, method: str = DEFAULT) -> Column:
    return F.initcap(romanize_column(word, method))


def join_parts(parts: Column) -> Column:
    """Parts in a row, a space before those that begin with a letter or digit."""
    def add(out: Column, part: Column) -> Column:
        spaced = (out == "") | out.rlike(r"\s$") | ~part.rlike(r"^[\p{L}\p{Nd}]")
        return F.concat(out, F.when(spaced, "").otherwise(" "), part)

    return F.aggregate(parts, F.lit(""), add)


# --- from romaji -------------------------------------------------------------


# Kana by consonant, in the order a i u e o (・: none), and what has no row.
ROMAJI_ROWS = {
    "": "あ い う え お", "b": "ば び ぶ べ ぼ", "c": "か し く せ こ", "d": "だ ぢ づ で ど", "f": "ふぁ ふぃ ふ ふぇ ふぉ", "g": "が ぎ ぐ げ ご", "h": "は ひ ふ へ ほ",
    "j": "じゃ じ じゅ じぇ じょ", "k": "か き く け こ", "l": "ら り る れ ろ", "m": "ま み む め も", "n": "な に ぬ ね の", "p": "ぱ ぴ ぷ ぺ ぽ", "q": "くぁ くぃ く くぇ くぉ",
    "r": "ら り る れ ろ", "s": "さ し す せ そ", "t": "た ち つ て と", "v": "ゔぁ ゔぃ ゔ ゔぇ ゔぉ", "w": "わ うぃ う うぇ を", "x": "ぁ ぃ ぅ ぇ ぉ", "y": "や ・ ゆ いぇ よ",
    "z": "ざ じ ず ぜ ぞ", "by": "びゃ びぃ びゅ びぇ びょ", "ch": "ちゃ ち ちゅ ちぇ ちょ", "cy": "ちゃ ちぃ ちゅ ちぇ ちょ", "dh": "でゃ でぃ でゅ でぇ でょ", "dw": "どぁ どぃ どぅ どぇ どぉ",
    "dy": "ぢゃ ぢぃ ぢゅ ぢぇ ぢょ", "fy": "ふゃ ・ ふゅ ・ ふょ", "gw": "ぐぁ ぐぃ ぐぅ ぐぇ ぐぉ", "gy": "ぎゃ ぎぃ ぎゅ ぎぇ ぎょ", "hw": "ふぁ ふぃ ・ ふぇ ふぉ", "hy": "ひゃ ひぃ ひゅ ひぇ ひょ",
    "jy": "じゃ じぃ じゅ じぇ じょ", "kw": "くぁ くぃ くぅ くぇ くぉ", "ky": "きゃ きぃ きゅ きぇ きょ", "ly": "りゃ りぃ りゅ りぇ りょ", "my": "みゃ みぃ みゅ みぇ みょ", "ny": "にゃ にぃ にゅ にぇ にょ",
    "py": "ぴゃ ぴぃ ぴゅ ぴぇ ぴょ", "ry": "りゃ りぃ りゅ りぇ りょ", "sh": "しゃ し しゅ しぇ しょ", "sy": "しゃ しぃ しゅ しぇ しょ", "th": "てゃ てぃ てゅ てぇ てょ", "ts": "つぁ つぃ つ つぇ つぉ",
    "tw": "とぁ とぃ とぅ とぇ とぉ", "ty": "ちゃ ちぃ ちゅ ちぇ ちょ", "vy": "ゔゃ ゔぃ ゔゅ ゔぇ ゔょ", "wh": "うぁ うぃ う うぇ うぉ", "xy": "ゃ ぃ ゅ ぇ ょ", "zy": "じゃ じぃ じゅ じぇ じょ",
}
ROMAJI_SINGLE = {
    "-": "ー", "n": "ん", "n'": "ん", "n-": "ん", "xn": "ん", "d'i": "でぃ", "d'u": "どぅ", "t'i": "てぃ", "t'u": "とぅ", "wye": "ゑ", "wyi": "ゐ", "xka": "ヵ",
    "xke": "ヶ", "xtu": "っ", "xwa": "ゎ", "d'yu": "でゅ", "hwyu": "ふゅ", "t'yu": "てゅ", "xtsu": "っ",
}
#: Consonants that are written twice for a small tsu (two l as before an r), and before which an m is ん.
DOUBLED, DOUBLED_AS, LABIALS = "bcdfghjkpqrstvwxyz", {"l": "r"}, "mbp"


@functools.cache
def romaji_table() -> dict[str, tuple[str, str]]:
    """romaji -> (kana, letters that stay)."""
    out = {c + v: (kana, "") for c, row in ROMAJI_ROWS.items() for v, kana in zip(VOWELS, row.split(), strict=True) if kana != "・"}
    out |= {romaji: (kana, "") for romaji, kana in ROMAJI_SINGLE.items()}
    out |= {c * 2: ("っ", c) for c in DOUBLED} | {c * 2: ("っ", stays) for c, stays in DOUBLED_AS.items()}
    return out | {"m" + c: ("ん", c) for c in LABIALS}


def readings(romaji: str) -> tuple[str, str] | None:
    """(shortest kana, pattern of all kana) of a romaji word; None if it is none.

    A vowel that may be long (o, u) may have an う after it.
    """
    table = romaji_table()
    longest = max(map(len, table))

    @functools.cache
    def rest(text: str) -> tuple[tuple[str, str], ...]:
        """All (kana, pattern) of a rest."""
        if not text:
            return (("", ""),)
        found = []
        for n in range(1, min(longest, len(text)) + 1):
            if text[:n] in table:
                kana, stays = table[text[:n]]
                pattern = kana + ("う?" if text[n - 1] in "ou" else "")
                found += [(kana + k, pattern + p) for k, p in rest(stays + text[n:])]
        return tuple(dict.fromkeys(found))

    options = rest(romaji.lower())
    if not options:
        return None
    shortest = min((k for k, _ in options), key=len)
    patterns = list(dict.fromkeys(p for _, p in options))
    return shortest, f"^{patterns[0]}$" if len(patterns) == 1 else f"^({'|'.join(patterns)})$"


def spellings(romaji: str) -> list[str]:
    """All kana of a romaji word, those of optional long vowels too; the shortest first."""
    found = readings(romaji)
    if not found:
        return []
    out: set[str] = set()
    for pattern in found[1].strip("^$").strip("()").split("|"):
        options = [""]
        for piece in re.findall("う\\?|.", pattern):
            options = [o + x for o in options for x in (("", "う") if piece == "う?" else (piece,))]
        out.update(options)
    return sorted(out, key=lambda k: (len(k), k))


@F.pandas_udf(ArrayType(StringType()))
def romaji_spellings(romaji: pd.Series) -> pd.Series:
    return romaji.map(lambda r: None if r is None else spellings(r))


@F.pandas_udf(StructType([StructField("canonical", StringType()), StructField("pattern", StringType())]))
def romaji_kana(romaji: pd.Series) -> pd.DataFrame:
    found = [None if r is None else readings(r) for r in romaji]
    return pd.DataFrame({"canonical": [f and f[0] for f in found], "pattern": [f and f[1] for f in found]})


def prefixes(words: list[str]) -> set[str]:
    """The proper prefixes of words: the inner nodes of their trie."""
    return set(itertools.chain.from_iterable(itertools.accumulate(w[:-1]) for w in words if len(w) > 1))
