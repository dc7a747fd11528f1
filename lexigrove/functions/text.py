"""String functions on Japanese text, as Column expressions."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from . import tables as t


def normalize(text: Column, kana: bool = False) -> Column:
    """Width and mark folding.  With ``kana`` only kana forms are folded."""
    out = F.translate(text, t.HALF_WIDTH, t.FULL_WIDTH) if kana else F.translate(text, t.ABNORMAL, t.NORMAL)
    for mark, pairs in (("゛", t.VOICED), ("゜", t.HALF_VOICED)):
        # A base letter and its mark; texts without the mark pass untouched.
        joined = out
        for base, voiced in pairs.items():
            joined = F.replace(joined, F.lit(base + mark), F.lit(voiced))
        out = F.when(F.contains(out, F.lit(mark)), joined).otherwise(out)
    if not kana:
        for mark, latin in t.PUNCTUATION:
            out = F.replace(out, F.lit(mark), F.lit(latin))
    return out


_HIRAGANA = "".join(c[0] for c in t.CLASSES.values() if len(c) == 2)
_KATAKANA = "".join(c[1] for c in t.CLASSES.values() if len(c) == 2)


def as_hiragana(text: Column) -> Column:
    return F.translate(F.translate(text, t.ABNORMAL, t.NORMAL), _KATAKANA, _HIRAGANA)


def as_katakana(text: Column) -> Column:
    return F.translate(F.translate(text, t.ABNORMAL, t.NORMAL), _HIRAGANA, _KATAKANA)


def mora_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[っッぁァぃィぅゥぇェぉォゃャゅュょョー]", ""))


def char_class_of(char: Column) -> Column:
    """The kana class of a character, else null."""
    return F.create_map(*[F.lit(x) for pair in t.CLASS_OF.items() for x in pair])[char]


def in_class(text: Column, name: str) -> Column:
    """Whether all of a non-empty text is in a character class."""
    return text.rlike(f"\\A{t.CHARACTER_CLASSES[name]}+\\z")


def count_class(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(t.CHARACTER_CLASSES[name]))


def collect_class(text: Column, name: str) -> Column:
    return F.regexp_extract_all(text, F.lit(t.CHARACTER_CLASSES[name]), F.lit(0))


def destem(text: Column, stem: int, name: str = "kana") -> Column:
    """The text before its stem-th last character of the class; empty if there are fewer."""
    if not stem:
        return text
    own = t.CHARACTER_CLASSES[name]
    return F.regexp_extract(text, f"(?s)\\A(.*?)(?:{own}(?:(?!{own}).)*+){{{stem}}}\\z", 1)


def destem_by(text: Column, stem: Column, most: int = 5) -> Column:
    """destem() by a column of 0 to ``most``."""
    out = text
    for k in range(1, most + 1):
        out = F.when(stem == k, destem(text, k)).otherwise(out)
    return out


def pieces(text: Column, pattern: str) -> Column:
    """The text as array<struct<matched: boolean, text: string, start: int, stop: int>>."""
    whole = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"))
    flat = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit(False).alias("m"), p["gap"].alias("s")), F.struct(F.lit(True).alias("m"), p["hit"].alias("s")))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<matched:boolean,text:string,start:int,stop:int>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        stop = acc["at"] + F.char_length(p["s"])
        row = F.struct(p["m"].alias("matched"), p["s"].alias("text"), acc["at"].alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(F.filter(flat, lambda p: p["s"] != ""), empty, add, lambda acc: acc["out"])


def split_by_regex(text: Column, pattern: str) -> Column:
    """Matches and what stands between them, in order."""
    return F.transform(pieces(text, pattern), lambda p: p["text"])


#: A word: after digits it starts with a letter, it may hold digits and ends with a letter.
RUN = f"(?:(?:(?<![.,]|{t.DIGIT}){t.DIGIT}+|{t.WORD}){t.NUMBER_OR_WORD}*{t.WORD}|{t.WORD})"


def basic_split(text: Column) -> Column:
    """Runs of Japanese (matched) and of other text."""
    return pieces(text, RUN)


def class_runs(text: Column, name: str) -> Column:
    """(start, stop) of the runs of a class."""
    found = F.filter(pieces(text, f"{t.CHARACTER_CLASSES[name]}+"), lambda p: p["matched"])
    return F.transform(found, lambda p: F.struct(p["start"], p["stop"]))


def kanji_boundaries(text: Column, offset: int = 0) -> Column:
    """Positions between two kanji."""
    inner = F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1)))
    return F.transform(F.filter(inner, lambda i: F.substring(text, i, F.lit(2)).rlike("^[々一-龯]{2}$")), lambda i: i + offset)


def kanji_mask(text: Column) -> Column:
    return F.regexp_replace(text, f"{t.CHARACTER_CLASSES['kanji']}+", "%")


def kanji_pattern(text: Column) -> Column:
    """A pattern in which runs of kanji match any reading."""
    quoted = F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&~-])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, f"{t.CHARACTER_CLASSES['kanji']}+", ".+"), F.lit("$"))


def kanji_match(text: Column, reading: Column) -> Column:
    return F.rlike(reading, kanji_pattern(text))


def kanji_cross_match(text: Column, reading: Column, other: Column) -> Column:
    """The reading with its end replaced as ``other`` replaces that of ``text``."""
    longest = F.greatest(F.char_length(text), F.char_length(other))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) != F.substring(other, i, F.lit(1)))
    shared = F.get(differs, F.lit(0)) - 1
    kept = shared + F.char_length(reading) - F.char_length(text)
    fits = (shared > 0) & (kept >= 0) & (kept <= F.char_length(reading))
    return F.when(fits, F.concat(F.substring(reading, F.lit(1), kept), F.substring(other, shared + 1, F.char_length(other))))


def kanji_prefix(text: Column) -> Column:
    return F.regexp_extract(text, f"^.*{t.CHARACTER_CLASSES['kanji']}", 0)


def safe_substring(text: Column, start: Column, stop: Column | None = None) -> Column:
    n = F.char_length(text)
    end = n if stop is None else stop
    return F.when((start <= n) & (end <= n) & (start <= end), F.substring(text, start + 1, end - start))


def _first(text: Column, table: dict[str, str]) -> Column:
    head = F.translate(F.left(text, F.lit(1)), "".join(table), "".join(table.values()))
    return F.concat(head, F.substring(text, F.lit(2), F.char_length(text)))


def rendaku(text: Column, half: bool = False) -> Column:
    return _first(text, t.HALF_VOICED if half else t.VOICED)


def unrendaku(text: Column) -> Column:
    return _first(text, t.UNVOICED)


def geminate(text: Column) -> Column:
    return F.when(text == "", text).otherwise(F.concat(F.left(text, F.char_length(text) - 1), F.lit("っ")))


def long_vowel_modifier(modifier: Column, before: Column) -> Column:
    """Whether a small vowel (its class) prolongs the character before it."""
    vowel = F.regexp_extract(modifier, "^\\+([aiueo])$", 1)
    return (vowel != "") & F.coalesce(F.endswith(char_class_of(before), vowel), F.lit(False))


def align(a: str, b: str) -> tuple[list[tuple[str, str]], int] | None:
    """Blocks of two strings that are equal or differ, so that most characters are equal.

    None if either is empty or no block of the rest begins alike.  Solved over
    suffixes, from the ends.
    """

    @functools.cache
    def best(i: int, j: int):
        x, y = a[i:], b[j:]
        if not x or not y:
            return None
        same = 0
        while same < min(len(x), len(y)) and x[same] == y[same]:
            same += 1
        if x == y:
            return [(x, y)], len(x)
        if len(x) == 1 or len(y) == 1:
            return [(x, y)], 0
        if same == min(len(x), len(y)):
            keep = same - 1
            return [(x[:keep], y[:keep]), (x[keep:], y[keep:])], keep
        if same:
            rest = best(i + same, j + same)
            return rest and ([(x[:same], y[:same]), *rest[0]], rest[1] + same)
        options = ((best(i + p, j + q), p, q) for p in range(1, len(x)) for q in range(1, len(y)) if x[p] == y[q])
        found = max((o for o in options if o[0]), key=lambda o: o[0][1], default=None)
        return found and ([(x[: found[1]], y[: found[2]]), *found[0][0]], found[0][1])

    return best(0, 0)


_BLOCK = StructType([StructField("left", StringType()), StructField("right", StringType()), StructField("equal", BooleanType())])


@F.pandas_udf(StructType([StructField("blocks", ArrayType(_BLOCK)), StructField("score", IntegerType())]))
def match_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [align(x, y) if x and y else None for x, y in zip(a, b, strict=True)]
    blocks = [None if f is None else [{"left": x, "right": y, "equal": x == y} for x, y in f[0]] for f in found]
    return pd.DataFrame({"blocks": blocks, "score": pd.array([None if f is None else f[1] for f in found], "Int32")})
