"""Japanese numerals, and percentages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

# Fixed values.
DIGITS, LEGAL_DIGITS = "〇一二三四五六七八九", "〇壱弐参四五六七八九拾"
POWERS = {1: "十", 2: "百", 3: "千", 4: "万", 8: "億", 12: "兆", 16: "京"}
DIGIT_KANA = ("れい", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう")
POWER_KANA = {1: "じゅう", 2: "ひゃく", 3: "せん", 4: "まん", 8: "おく", 12: "ちょう", 16: "けい"}
VALUES = {c: i for row in (DIGITS, "零壱弐参", "0123456789", "０１２３４５６７８９") for i, c in enumerate(row)}
EXPONENTS = {c: p for p, c in POWERS.items()} | {"拾": 1}
#: Sound changes (value before, exponent after) -> (end of the first is doubled, start of the second).
#: Digits before a power, then powers before a power.
AFTER_DIGIT = {
    (1, 3): (True, ""), (1, 12): (True, ""), (1, 16): (True, ""), (3, 2): (False, "voiced"), (3, 3): (False, "voiced"),
    (6, 2): (True, "half"), (6, 16): (True, ""), (8, 2): (True, "half"), (8, 3): (True, ""), (8, 12): (True, ""), (8, 16): (True, ""),
}
AFTER_POWER = {(1, 12): (True, ""), (1, 16): (True, ""), (2, 16): (True, "")}


def to_kanji(n: int, digits: str = DIGITS, one_thousand: bool = False) -> str:
    """A number in kanji; ``one_thousand`` writes 一千 for 1000."""
    if n < 10:
        return digits[n]
    power = max(p for p in POWERS if 10**p <= n)
    count, rest = divmod(n, 10**power)
    bare = count == 1 and power <= (2 if one_thousand else 3)
    return ("" if bare else to_kanji(count, digits, True)) + POWERS[power] + (to_kanji(rest, digits, one_thousand) if rest else "")


def parse(text: str) -> int | None:
    """The value of a numeral in kanji, digits or a mixture; None if it is none."""
    if any(c not in VALUES and c not in EXPONENTS for c in text):
        return None
    powers = [(EXPONENTS[c], -i) for i, c in enumerate(text) if c in EXPONENTS]
    if not powers:
        return int("".join(str(VALUES[c]) for c in text) or "0")
    power, at = max(powers)
    before, after = text[:-at], text[1 - at :]
    return (parse(before) if before else 1) * 10**power + (parse(after) if after else 0)


def _joined(first: str, second: str, change: tuple[bool, str]) -> str:
    from .tables import HALF_VOICED, VOICED

    doubled, start = change
    table = {"voiced": VOICED, "half": HALF_VOICED}.get(start, {})
    return (first[:-1] + "っ" if doubled and first else first) + table.get(second[:1], second[:1]) + second[1:]


def kana_groups(numeral: str) -> list[str]:
    """The reading of a numeral in kanji, by groups of a digit and rising powers."""
    groups: list[list[tuple[bool, int]]] = []
    for c in numeral:
        item = (c in EXPONENTS, EXPONENTS.get(c, VALUES.get(c, 0)))
        before = groups[-1][-1] if groups else None
        if before and item[0] and (not before[0] or item[1] > before[1]):
            groups[-1].append(item)
        else:
            groups.append([item])
    out = []
    for group in groups:
        text, before = "", None
        for is_power, value in group:
            reading = POWER_KANA[value] if is_power else DIGIT_KANA[value]
            table = {} if before is None or not is_power else AFTER_POWER if before[0] else AFTER_DIGIT
            text = _joined(text, reading, table.get((before[1], value) if before else None, (False, "")))
            before = (is_power, value)
        out.append(text)
    return out


def to_kana(n: int, separator: str = "") -> str:
    return separator.join(kana_groups(to_kanji(n)))


@F.pandas_udf(StringType())
def number_to_kanji(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) or x < 0 else to_kanji(int(x)))


@F.pandas_udf(StringType())
def number_to_kana(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if pd.isna(x) or x < 0 else to_kana(int(x)))


@F.pandas_udf(DecimalType(38, 0))
def parse_number(text: pd.Series) -> pd.Series:
    from decimal import Decimal

    def value(x):
        found = None if x is None else parse(x)
        return None if found is None or found >= 10**38 else Decimal(found)

    return text.map(value)


def percentage(value: Column) -> Column:
    """A double with two digits after the point and a per cent sign, as by %.2f of C.

    The exact binary value is rounded, ties to the even digit; format_string() rounds the
    shortest decimal form, and its ties up.
    """
    return F.concat(F.call_function("format_number", value, F.lit("0.00")), F.lit("%"))
