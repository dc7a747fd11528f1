"""Single words: their analyses, suggestions for romaji, katakana words as hiragana."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.romaji import romaji_spellings
from ..sources.lexicon import Lexicon
from .lookups import common_rank
from .segment import analysed


def word_info(words: DataFrame, features: DataFrame, root_only: bool = False) -> DataFrame:
    """words: text, and reading (null: any).  (text, reading, seq, kana, kind, score, place): analyses of
    whole words, best first."""
    wanted = words.select("text", "reading").distinct()
    found = wanted.join(features, "text").where(F.col("reading").isNull() | (F.col("kana") == F.col("reading")))
    found = found.where("root_p") if root_only else found
    scored = analysed(found, F.lit(True)).withColumn("score", F.col("_a.score"))
    order = Window.partitionBy("text", "reading").orderBy(F.desc("score"), "ordinal", "kind")
    return scored.select("text", "reading", "seq", "kana", "kind", "score", F.row_number().over(order).alias("place"))


def with_glosses(infos: DataFrame, glosses: DataFrame, words: Column) -> DataFrame:
    """Of the analyses of each word, the first of which the glosses hold all of ``words`` (an array), else the first.

    glosses: (seq, glosses), as Lookups.sense_glosses() gives them, joined by entry.
    """
    joined = infos.join(glosses, "seq", "left").withColumn("_hit", F.forall(words, lambda w: F.contains(F.lower(F.coalesce("glosses", F.lit(""))), F.lower(w))))
    best = Window.partitionBy("text", "reading").orderBy(F.desc("_hit"), "place")
    return joined.withColumn("_at", F.row_number().over(best)).where("_at = 1").drop("_at", "_hit")


def suggestions(romaji: DataFrame, lexicon: Lexicon) -> DataFrame:
    """romaji: romaji.  (romaji, hiragana, katakana, kanji): arrays, commonest first; none for what is no romaji.

    All spellings are made and joined by equality, so no pattern is matched with every word.
    """
    spelled = romaji.select("romaji").distinct().withColumn("_all", romaji_spellings("romaji")).where(F.size("_all") > 0)
    each = spelled.select("romaji", F.col("_all")[0].alias("_first"), F.explode("_all").alias("text"))
    found = each.join(lexicon.kana_text.select("text", "common", "best_kanji", "ordinal"), "text")
    place = F.row_number().over(Window.partitionBy("romaji").orderBy(*common_rank(), "ordinal"))
    rows = found.withColumn("_p", place).groupBy("romaji").agg(F.sort_array(F.collect_list(F.struct("_p", "text", "best_kanji"))).alias("_rows"))
    listed = spelled.select("romaji", F.col("_all")[0].alias("_first")).join(rows, "romaji", "left")
    texts = F.coalesce(F.transform("_rows", lambda r: r["text"]), F.array().cast("array<string>"))
    kanji = F.filter(F.transform("_rows", lambda r: r["best_kanji"]), lambda k: k.isNotNull())
    hiragana = F.array_distinct(F.concat(F.array("_first"), texts))
    return listed.select(
        "romaji", hiragana.alias("hiragana"), F.transform(hiragana, tx.as_katakana).alias("katakana"),
        F.array_distinct(F.coalesce(kanji, F.array().cast("array<string>"))).alias("kanji"),
    )


def as_hiragana(words: DataFrame, features: DataFrame) -> DataFrame:
    """words: text.  Features of katakana words that the lexicon has as hiragana only, under the
    text as it is written."""
    folded = words.select(F.col("text").alias("_written"), tx.as_hiragana(F.col("text")).alias("text")).distinct().where("text <> _written")
    known = features.select(F.col("text").alias("_written"), F.col("seq").alias("_seq"))
    found = folded.join(features, "text")
    kept = found.join(known, (found["_written"] == known["_written"]) & (found["seq"] == known["_seq"]), "left_anti")
    return kept.withColumn("text", F.col("_written")).select(*features.columns)


def by_pattern(lexicon: Lexicon, pattern: str) -> DataFrame:
    """(kana, kanji, common, place): readings that match, commonest first, with the kanji that goes with each."""
    found = lexicon.kana_text.where(F.col("text").rlike(pattern)).select(F.col("text").alias("kana"), F.col("best_kanji").alias("kanji"), "common", "ordinal")
    best = found.groupBy("kana", "kanji").agg(F.min(F.struct(F.when(F.col("common").isNull(), 2).when(F.col("common") == 0, 1).otherwise(0), "common", "ordinal")).alias("_at"))
    return best.select("kana", "kanji", "_at.common", F.row_number().over(Window.partitionBy(F.left("kana", F.lit(1))).orderBy("_at", "kana", "kanji")).alias("place"))
