"""Splits and hints: tables of rules, given as rows, that take words apart or mark their readings.

The tables belong to a dictionary and are parameters here.  A split is (seq, score, place, test,
argument, parts, length, finder, modify): for each entry its steps in order.  A hint is
(seq, form): the writing of the word with spaces and marks where a reader needs them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from ..functions.romaji import BREAK, PARTICLE
from ..functions.tables import UNVOICED
from ..sources.lexicon import Lexicon

SPLITS = "seq int, score int, place int, parts array<int>, length string, finder string, modify string"


def optional_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), text).otherwise(F.concat(prefix, text))


def part_length(length: Column, text: Column) -> Column:
    """``n``: so many characters; ``-n``: all but so many; ``=c``: up to the character; ``+c``: with it; null: the rest."""
    n = F.char_length(text)
    number = length.try_cast("int")
    at = F.instr(text, F.substring(length, 2, 1))
    return (
        F.when(F.startswith(length, F.lit("=")), F.when(at > 0, at - 1))
        .when(F.startswith(length, F.lit("+")), F.when(at > 0, at))
        .when(number < 0, F.greatest(n + number, F.lit(0)))
        .otherwise(number)
    )


def split_words(words: DataFrame, rules: DataFrame, lexicon: Lexicon) -> DataFrame:
    """words: seq, text, conj_of (array of entries).  (seq, text, score, parts): the words that a rule makes of it.

    The rule is that of the entry itself, else of the first of conj_of that has one.  Parts are
    (place, seq, text); a word has a row only where every part is found.
    """
    keys = words.select("seq", "text", F.posexplode(F.concat(F.array("seq"), F.coalesce("conj_of", F.array().cast("array<int>")))).alias("_rank", "rule"))
    known = keys.join(rules.select(F.col("seq").alias("rule")).distinct(), "rule", "left_semi")
    chosen = known.groupBy("seq", "text").agg(F.min_by("rule", "_rank").alias("rule"))
    steps = chosen.join(rules.withColumnRenamed("seq", "rule"), "rule").withColumn("_n", part_length(F.col("length"), F.col("text")))
    listed = steps.groupBy("seq", "text", "rule", "score").agg(F.sort_array(F.collect_list(F.struct("place", "_n", "parts", "finder", "modify"))).alias("_steps"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<place:int,start:int,stop:int,parts:array<int>,finder:string,modify:string>>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        stop = F.coalesce(acc["at"] + s["_n"], F.char_length("text"))
        row = F.struct(s["place"].alias("place"), acc["at"].alias("start"), stop.alias("stop"), s["parts"].alias("parts"), s["finder"].alias("finder"), s["modify"].alias("modify"))
        return F.struct((acc["at"] + F.coalesce(s["_n"], F.lit(0))).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    placed = listed.select("seq", "text", "rule", "score", F.explode(F.aggregate("_steps", zero, add, lambda acc: acc["out"])).alias("p")).select("seq", "text", "rule", "score", "p.*")
    own = F.expr("substring(text, start + 1, stop - start)")
    unvoiced = F.concat(F.translate(F.left(own, F.lit(1)), "".join(UNVOICED), "".join(UNVOICED.values())), F.expr("substring(substring(text, start + 1, stop - start), 2)"))
    part = F.when(F.col("modify") == "unvoiced", unvoiced).when(F.col("modify").isNotNull(), optional_prefix(own, F.col("modify"))).otherwise(own)
    asked = placed.where("NOT array_contains(parts, rule)").withColumn("_part", part)
    texts = lexicon.kanji_text.select("seq", "text", "ordinal").unionByName(lexicon.kana_text.select("seq", "text", "ordinal"))
    derived = texts.join(lexicon.conjugation.select("seq", "from"), "seq").select(F.col("seq").alias("part_seq"), F.col("from").alias("_of"), F.col("text").alias("_part"), "ordinal", F.lit(True).alias("_derived"))
    direct = texts.select(F.col("seq").alias("part_seq"), F.col("seq").alias("_of"), F.col("text").alias("_part"), "ordinal", F.lit(False).alias("_derived"))
    every = direct.unionByName(derived)
    met = asked.join(every, "_part").where(F.array_contains("parts", F.col("_of")) & (~F.col("_derived") | (F.col("finder") == "derived")))
    found = met.groupBy("seq", "text", "score", "place").agg(F.min_by(F.struct("part_seq", "_part"), F.struct("_derived", "ordinal")).alias("w"))
    whole = found.groupBy("seq", "text", "score").agg(F.sort_array(F.collect_list(F.struct("place", F.col("w.part_seq").alias("seq"), F.col("w._part").alias("text")))).alias("parts"))
    wanted = listed.select("seq", "text", F.size("_steps").alias("_all"))
    return whole.join(wanted, ["seq", "text"]).where(F.size("parts") == F.col("_all")).drop("_all")


def insert_marks(text: str, marks: list[tuple[str, int]]) -> str:
    """Marks (a character and where it goes, 0 to the length), in order of their places."""
    out = [""] * (len(text) + 1)
    for mark, at in marks:
        if 0 <= at <= len(text):
            out[at] += mark
    return "".join(m + c for m, c in zip(out, [*text, ""], strict=True))


def moved(blocks: list[tuple[str, str]], at: int) -> int | None:
    """A place in the left texts of the blocks as a place in the right ones; inside an unequal
    block it is after the first character."""
    left = right = 0
    for a, b in blocks:
        if at - left <= len(a) and (a == b or at - left == len(a)):
            return right + (at - left if a == b else len(b))
        if a != b and at - left < len(a):
            return right + min(1, max(at - left, len(b)))
        left, right = left + len(a), right + len(b)
    return None


def parsed_form(form: str) -> tuple[str, list[tuple[str, int]]]:
    """A hint's form: the writing, and its marks; a space is a break, は and へ that stand alone are particles."""
    plain, marks = "", []
    for k, piece in enumerate(form.split(" ")):
        if k:
            marks.append((BREAK, len(plain)))
        if piece in ("は", "へ") and k:
            marks.append((PARTICLE, len(plain)))
        plain += piece
    return plain, marks


def hinted(form: str, text: str, kana: str, blocks: list[tuple[str, str]]) -> str | None:
    """The kana of a word with the marks of a hint; blocks: the alignment of its text and kana."""
    plain, marks = parsed_form(form)
    found = tx.align(plain, text)
    if found is None:
        return None
    there = [(m, moved(found[0], at)) for m, at in marks]
    here = [(m, moved(blocks, at)) for m, at in there if at is not None]
    return insert_marks(kana, [(m, at) for m, at in here if at is not None])


@F.pandas_udf(StringType())
def hinted_kana(form: pd.Series, text: pd.Series, kana: pd.Series, blocks: pd.Series) -> pd.Series:
    out = []
    for f, w, k, b in zip(form, text, kana, blocks, strict=True):
        out.append(hinted(f, w, k, [(x["text"], x["reading"]) for x in b]) if f and w and k and b is not None else k)
    return pd.Series(out)


def with_hints(words: DataFrame, hints: DataFrame) -> DataFrame:
    """words: seq, text, kana, blocks (operators.kanji.furigana()); hints: seq, form.  The kana with marks."""
    return words.join(hints.dropDuplicates(["seq"]), "seq", "left").withColumn("kana", hinted_kana("form", "text", "kana", "blocks")).drop("form")
