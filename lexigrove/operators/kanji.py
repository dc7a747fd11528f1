"""Characters: alignment of readings with writings, and statistics of readings."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import tables as t
from ..functions.numerals import percentage


def variants(reading: str, first: bool) -> dict[str, str]:
    """How a reading may sound in a word: plain, voiced (not at the start), doubled at its end."""
    out = {reading: "plain"}
    if not first:
        for table, name in ((t.VOICED, "voiced"), (t.HALF_VOICED, "half-voiced")):
            if reading[:1] in table:
                out.setdefault(table[reading[0]] + reading[1:], name)
    for form, name in list(out.items()):
        if len(form) > 1 and form[-1] in "つくきち":
            out.setdefault(form[:-1] + "っ", f"{name} doubled")
    return out


def align(text: str, reading: str, known: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str]] | None:
    """Blocks (text, reading, type) of a writing; known: character -> [(reading, type)].

    A character read irregularly costs as many points as its reading is long; the
    cheapest alignment wins, the first of equals.  None if kana do not fit.
    """

    @functools.cache
    def best(i: int, j: int) -> tuple[int, tuple] | None:
        if i == len(text):
            return (0, ()) if j == len(reading) else None
        c = text[i]
        if c in t.CLASS_OF:
            if j < len(reading) and reading[j] == chr(ord(c) - t.KATAKANA if "ァ" <= c <= "ヴ" else ord(c)):
                rest = best(i + 1, j + 1)
                return rest and (rest[0], ((c, reading[j], "kana"), *rest[1]))
            return None
        options = []
        regular = {f: (r, kind, how) for r, kind in known.get(text[i - 1] if c == "々" and i else c, []) for f, how in variants(r, i == 0).items()}
        for form, (_, kind, _how) in regular.items():
            if reading.startswith(form, j) and (rest := best(i + 1, j + len(form))):
                options.append((rest[0], ((c, form, kind), *rest[1])))
        for n in range(1, len(reading) - j + 1):
            if rest := best(i + 1, j + n):
                options.append((rest[0] + n, ((c, reading[j : j + n], "irregular"), *rest[1])))
        return min(options, key=lambda o: o[0]) if options else None

    found = best(0, 0)
    if not found:
        return None
    out: list[list[str]] = []
    for c, r, kind in found[1]:
        if out and kind == out[-1][2] and kind in ("irregular", "kana"):
            out[-1][0] += c
            out[-1][1] += r
        else:
            out.append([c, r, kind])
    return [tuple(b) for b in out]


_BLOCKS = ArrayType(StructType([StructField(c, StringType()) for c in ("text", "reading", "type")]))


def furigana(words: DataFrame, readings: DataFrame) -> DataFrame:
    """words (text, kana) with ``blocks``; readings: (literal, text, type).

    Each distinct word brings the readings of its own characters, so nothing is broadcast.
    """
    chars = words.select("text", "kana").distinct().withColumn("literal", F.explode(F.array_distinct(F.split("text", ""))))
    known = readings.groupBy("literal").agg(F.array_sort(F.collect_set(F.struct("text", "type"))).alias("r"))
    gathered = chars.join(known, "literal").groupBy("text", "kana").agg(F.map_from_entries(F.collect_list(F.struct("literal", "r"))).alias("_known"))

    @F.pandas_udf(_BLOCKS)
    def blocks(text: pd.Series, kana: pd.Series, table: pd.Series) -> pd.Series:
        out = []
        for w, r, k in zip(text, kana, table, strict=True):
            own = {c: [(x["text"], x["type"]) for x in v] for c, v in (dict(k).items() if k is not None else ())}
            found = align(w, r, own) if w and r else None
            out.append(None if found is None else [dict(zip(("text", "reading", "type"), b, strict=True)) for b in found])
        return pd.Series(out)

    return words.join(gathered, ["text", "kana"], "left").withColumn("blocks", blocks("text", "kana", "_known")).drop("_known")


def reading_statistics(aligned: DataFrame) -> DataFrame:
    """(literal, reading, type, n, total, share) over aligned words."""
    rows = aligned.select(F.explode("blocks").alias("b")).where("b.type <> 'kana'").select(F.col("b.text").alias("literal"), "b.reading", "b.type")
    counted = rows.groupBy("literal", "reading", "type").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("literal").agg(F.sum("n").alias("total"))
    return counted.join(totals, "literal").withColumn("share", share(F.col("n"), F.col("total")))


def share(n, total):
    return F.when(total == 0, "--.--%").otherwise(percentage(F.lit(100.0) * n / total))


def original_reading(reading, voiced, last):
    """A reading as it was: the first kana unvoiced where ``voiced``, the last one ``last`` where not null."""
    from ..functions.text import unrendaku

    plain = F.when(voiced, unrendaku(reading)).otherwise(reading)
    return F.when(last.isNull(), plain).otherwise(F.concat(F.left(plain, F.char_length(plain) - 1), F.left(last, F.lit(1))))


def documents(lexicon, keys: DataFrame) -> DataFrame:
    """keys: text.  (text, json): a character with its readings (but for names), their okurigana and shares, and its meanings."""
    kanji = lexicon.kanji.join(keys.select("text").distinct(), "text").select(F.col("id").alias("kanji_id"), "text", "grade", "strokes", "freq", "stat_common", "stat_irregular")
    okurigana = lexicon.okurigana.select("reading_id", "text").distinct().groupBy("reading_id").agg(F.array_sort(F.collect_list("text")).alias("okurigana"))
    readings = lexicon.reading.where("type <> 'ja_na'").select("kanji_id", F.col("id").alias("reading_id"), F.col("text").alias("reading"), "type", F.col("stat_common").alias("sample"), "prefixp", "suffixp")
    joined = readings.join(okurigana, "reading_id", "left").join(kanji.select("kanji_id", "stat_common"), "kanji_id")
    row = F.struct((-F.col("sample")).alias("_o"), "reading_id", "reading", "type", F.coalesce("okurigana", F.array().cast("array<string>")).alias("okurigana"), "sample", share(F.col("sample"), F.col("stat_common")).alias("perc"), "prefixp", "suffixp")
    listed = joined.groupBy("kanji_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("_o", "reading_id")).alias("readings"))
    meanings = lexicon.meaning.groupBy("kanji_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda m: m["text"]).alias("meanings"))
    whole = kanji.join(listed, "kanji_id", "left").join(meanings, "kanji_id", "left")
    return whole.select("text", F.to_json(F.struct("text", "grade", "strokes", "freq", F.col("stat_common").alias("total"), F.col("stat_irregular").alias("irregular"), "readings", "meanings")).alias("json"))
