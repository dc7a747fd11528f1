"""Output documents of segmented texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lexicon import Lexicon
from .segment import romanized
from .senses import entry_text, sense_array, senses

FORMATS = ("romanize", "romanize-info", "json-v1", "json-v2")


def render(tokens: DataFrame, lexicon: Lexicon, key: str, form: str = "romanize") -> DataFrame:
    """(key, output) of tokens from segment.tokens(), in one of FORMATS.

    romanize: a line of romaji.  romanize-info: with the entries of its words after
    it.  json-v1: a nested array, words as [romaji, {...}].  json-v2: a document with
    tokens, their places, and the entries they refer to.
    """
    if form == "romanize":
        return romanized(tokens, key).withColumnRenamed("romaji", "output")
    words = tokens.where("seq IS NOT NULL").select("seq").distinct()
    if form == "romanize-info":
        trailers = entry_text(lexicon, words).select("seq", F.concat(F.lit("  "), "reading", F.lit("\n"), "text").alias("_trailer"))
        entries = tokens.join(trailers, "seq").withColumn("_info", F.concat("romaji", "_trailer"))
        listed = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run_no", "token_no", "_info"))).alias("_all"))
        trailer = F.array_join(F.transform("_all", lambda x: x["_info"]), "\n\n")
        return romanized(tokens, key).join(listed, key, "left").select(key, F.concat_ws("\n\n", "romaji", F.when(F.size("_all") > 0, trailer)).alias("output"))
    found = sense_array(senses(lexicon, words))
    place = F.struct("run_no", "token_no")
    if form == "json-v1":
        detail = tokens.join(found, "seq", "left")
        word = F.to_json(F.struct(F.col("kana").alias("reading"), F.col("token").alias("text"), "kana", "score", "seq", F.col("senses").alias("gloss")))
        one = F.when(F.col("is_word"), F.concat(F.lit("["), F.to_json(F.array("romaji")).substr(F.lit(2), F.char_length(F.to_json(F.array("romaji"))) - 2), F.lit(","), word, F.lit(",[]]"))).otherwise(
            F.to_json(F.array("token")).substr(F.lit(2), F.char_length(F.to_json(F.array("token"))) - 2)
        )
        listed = detail.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), one.alias("json")))).alias("_all"))
        return listed.select(key, F.concat(F.lit("["), F.array_join(F.transform("_all", lambda x: x["json"]), ","), F.lit("]")).alias("output"))
    if form != "json-v2":
        raise ValueError(f"no format {form!r}; there are {', '.join(FORMATS)}")
    token = F.struct("token", "is_word", F.col("seq").alias("entry"), "kana", "romaji", "score")
    by_text = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), token.alias("token")))).alias("_all"))
    used = tokens.where("seq IS NOT NULL").select(key, "seq").distinct().join(found, "seq")
    entries = used.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("string"), "senses")))).alias("entries"))
    document = F.struct(F.transform("_all", lambda x: x["token"]).alias("tokens"), "entries")
    return by_text.join(entries, key, "left").select(key, F.to_json(document).alias("output"))
