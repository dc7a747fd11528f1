"""Readings of numbers with counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import numerals
from .tables import HALF_VOICED, ROWS, VOICED

_STOPS = frozenset(ROWS["k"])
_HARD = _STOPS | frozenset(ROWS["s"] + ROWS["t"])
_H, _P = frozenset(ROWS["h"]), frozenset(ROWS["p"])
# Last digit or power -> first kana before which the number's end is doubled;
# before the h row it is doubled as well for those, and that row becomes the p row.
DOUBLED = {1: _HARD, 6: _STOPS | _P, 8: _HARD | _P, 10: _HARD | _P, 100: _STOPS}
HALF = frozenset(DOUBLED) | {3, 1000, 10_000}
#: The same for counters from other languages: no h row.
DOUBLED_FOREIGN = {6: _STOPS | _P, 8: _HARD | _P, 10: _HARD | _P, 100: _STOPS}

# Readings that some counters (as they are written) have for some numbers, native ones among them.
SPECIAL = {
    "人": {1: "ひとり", 2: "ふたり", 4: "よにん"},
    "つ": {1: "ひとつ", 2: "ふたつ", 3: "みっつ", 4: "よっつ", 5: "いつつ", 6: "むっつ", 7: "ななつ", 8: "やっつ", 9: "ここのつ"},
    "日": {1: "ついたち", 2: "ふつか", 3: "みっか", 4: "よっか", 5: "いつか", 6: "むいか", 7: "なのか", 8: "ようか", 9: "ここのか", 10: "とおか", 14: "じゅうよっか", 20: "はつか", 24: "にじゅうよっか"},
    "月": {4: "しがつ", 7: "しちがつ", 9: "くがつ"},
    "歳": {20: "はたち"},
    "才": {20: "はたち"},
    "時": {4: "よじ", 7: "しちじ", 9: "くじ"},
    "年": {4: "よねん", 9: "くねん"},
}
#: Counters that are voiced after 3 and 1000.
VOICED_AFTER_THREE = frozenset("本匹杯階軒足")


def last_digit(n: int) -> int | None:
    """The last digit, or the power of ten that the number ends with: 1 to 9, 10, 100, 1000, 10000."""
    if n % 10:
        return n % 10
    for power, above in ((10, 100), (100, 1000), (1000, 10_000), (10_000, 10**8)):
        if n % above:
            return power
    return None


def counted(n: int, counter: str, foreign: bool = False, unit: str = "") -> str:
    """The reading of a number and the reading of a counter, joined; ``unit``: the counter as it is written."""
    if n in SPECIAL.get(unit, {}):
        return SPECIAL[unit][n]
    if unit in VOICED_AFTER_THREE and last_digit(n) in (3, 1000):
        return numerals.to_kana(n) + VOICED.get(counter[:1], counter[:1]) + counter[1:]
    number, digit = numerals.to_kana(n), last_digit(n)
    head = counter[:1]
    plain = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヴ" else c for c in head)
    table = DOUBLED_FOREIGN if foreign else DOUBLED
    softens = not foreign and plain in _H and digit in HALF
    if plain in table.get(digit, ()) or (softens and digit in DOUBLED):
        number = number[:-1] + "っ"
    return number + (HALF_VOICED[head] + counter[1:] if softens else counter)


def ordinal(n: int) -> str:
    teen = 11 <= n % 100 <= 19
    return f"{n}{'th' if teen else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


@F.pandas_udf(StringType())
def counter_reading(number: pd.Series, counter: pd.Series, unit: pd.Series) -> pd.Series:
    """Of a numeral and a counter as they are written, and the counter's reading; null if it is no numeral."""

    def read(n, c, u):
        value = numerals.parse(n) if n else None
        return None if value is None or c is None else counted(value, c, unit=u or "")

    return pd.Series([read(n, c, u) for n, c, u in zip(number, counter, unit, strict=True)])


@F.pandas_udf(StringType())
def counter_value(number: pd.Series, unit: pd.Series) -> pd.Series:
    """What a number with a counter is worth: ``Value: 3``, of days of a month ``3rd``."""

    def show(n, u):
        value = numerals.parse(n) if n else None
        return None if value is None else ordinal(value) if u == "日" else f"Value: {value}"

    return pd.Series([show(n, u) for n, u in zip(number, unit, strict=True)])
