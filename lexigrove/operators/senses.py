"""Senses of entries and the documents that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lexicon import Lexicon
from .lookups import Lookups

TAGS = ["pos", "misc", "field", "dial", "s_inf", "stagk", "stagr"]


def senses(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """(seq, ord, pos, gloss, props): senses with their tags; an empty pos is that of the sense before."""
    look = Lookups(lexicon)
    props = look.sense_props(keys, TAGS)
    bags = props.groupBy("seq", "ord", "tag").agg(F.sort_array(F.collect_list(F.struct("prop_ord", "ordinal", "text"))).alias("v"))
    bags = bags.select("seq", "ord", "tag", F.transform("v", lambda x: x["text"]).alias("values"))
    by_sense = bags.groupBy("seq", "ord").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("props"))
    rows = look.sense_glosses(keys).join(by_sense, ["seq", "ord"], "left")
    own = F.concat(F.lit("["), F.array_join(F.col("props")["pos"], ","), F.lit("]"))
    carried = F.last(own, ignorenulls=True).over(Window.partitionBy("seq").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("seq", "ord", F.coalesce(carried, F.lit("[]")).alias("pos"), F.coalesce("glosses", F.lit("")).alias("gloss"), "props")


def sense_text(rows: DataFrame) -> DataFrame:
    """(seq, text): numbered senses, a line each."""
    bag = lambda tag, sep, left, right: F.when(F.col("props")[tag].isNotNull(), F.concat(F.lit(left), F.array_join(F.col("props")[tag], sep), F.lit(right))).otherwise("")
    place = F.row_number().over(Window.partitionBy("seq").orderBy("ord"))
    line = F.concat(place.cast("string"), F.lit(". "), "pos", F.lit(" "), bag("field", ",", "{", "} "), bag("s_inf", "; ", "《", "》 "), "gloss")
    return rows.select("seq", "ord", line.alias("line")).groupBy("seq").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY ord)").alias("text"))


def sense_array(rows: DataFrame) -> DataFrame:
    """(seq, senses): an array of structs, ready for to_json."""
    entry = F.struct("ord", "pos", "gloss", F.array_join(F.col("props")["s_inf"], "; ").alias("info"), F.array_join(F.col("props")["field"], ",").alias("field"))
    listed = rows.groupBy("seq").agg(F.sort_array(F.collect_list(entry)).alias("_s"))
    return listed.select("seq", F.transform("_s", lambda s: s.dropFields("ord")).alias("senses"))


def split_pos(pos: Column) -> Column:
    return F.split(F.regexp_replace(pos, r"^\[|\]$", ""), ",")


def reading_text(kanji: Column, kana: Column) -> Column:
    return F.when(kanji.isNull(), kana).otherwise(F.concat(kanji, F.lit(" 【"), kana, F.lit("】")))


def entry_text(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """(seq, reading, text): the headword and all senses."""
    look = Lookups(lexicon)
    kanji = look.headword_text(keys, "kanji").withColumnRenamed("text", "_kanji")
    kana = look.headword_text(keys, "kana").withColumnRenamed("text", "_kana")
    rows = keys.select("seq").distinct().join(kanji, "seq", "left").join(kana, "seq", "left").join(sense_text(senses(lexicon, keys)), "seq", "left")
    return rows.select("seq", reading_text(F.col("_kanji"), F.col("_kana")).alias("reading"), "text")
