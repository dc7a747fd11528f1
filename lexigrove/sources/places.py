"""Names of places: municipalities and wards from delimited files, as entries of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.romaji import romanize_place

# Kinds of municipality by their last character: readings, and what they are called.
KINDS = {
    "都": (("ﾄ", "と"), "Metropolis"), "道": (("ﾄﾞｳ", "どう"), None), "府": (("ﾌ", "ふ"), "Prefecture"), "県": (("ｹﾝ", "けん"), "Prefecture"),
    "市": (("ｼ", "し"), "(city)"), "町": (("ﾁｮｳ", "ﾏﾁ", "ちょう", "まち"), "(town)"), "村": (("ｿﾝ", "ﾑﾗ", "そん", "むら"), "(village)"), "区": (("ｸ", "く"), "Ward"),
}


def short_name(text: Column, reading: Column) -> Column:
    """A struct of text and reading without the kind of municipality; 道 stays."""
    kind = F.right(text, F.lit(1))
    bare = F.lit(None).cast("string")
    for name, (endings, _) in KINDS.items():
        for ending in reversed(endings):
            cut = F.substring(reading, F.lit(1), F.char_length(reading) - len(ending))
            bare = F.when((kind == name) & F.endswith(reading, F.lit(ending)), cut).otherwise(bare)
    stays = kind == "道"
    return F.struct(
        F.when(stays, text).otherwise(F.substring(text, F.lit(1), F.char_length(text) - 1)).alias("text"), F.when(stays, reading).otherwise(bare).alias("reading")
    )


def romanized_place(text: Column, reading: Column, with_kind: bool = True) -> Column:
    kind = F.right(text, F.lit(1))
    called = F.create_map(*[F.lit(x) for name, (_, word) in KINDS.items() for x in (name, word or "")])[kind]
    kana = tx.as_hiragana(tx.normalize(F.coalesce(short_name(text, reading)["reading"], F.lit(""))))
    name = romanize_place(kana, "hepburn_simple")
    return F.concat_ws(" ", name, F.when(F.lit(with_kind) & (called != ""), called))


def normalize_geo(word: Column) -> Column:
    return F.translate(F.lower(word), "ūō", "uo")


def municipalities(rows: DataFrame) -> DataFrame:
    """rows: id, pref, muni, pref_reading, muni_reading.  (text, reading, definition): the name, and without its kind."""
    whole = F.coalesce("muni", F.lit("")) == ""
    text, reading = F.when(whole, F.col("pref")).otherwise(F.col("muni")), F.when(whole, F.col("pref_reading")).otherwise(F.col("muni_reading"))
    named = rows.select(text.alias("text"), reading.alias("reading"), F.when(~whole, romanized_place(F.col("pref"), F.col("pref_reading"))).alias("_in"))
    named = named.withColumns({"definition": F.concat_ws(", ", romanized_place(F.col("text"), F.col("reading")), "_in"), "_short": short_name(F.col("text"), F.col("reading"))})
    long = F.struct("text", "reading")
    every = F.when(F.right("text", F.lit(1)) == "道", F.array(long)).otherwise(F.array(long, F.col("_short")))
    each = named.select("definition", F.explode(every).alias("e"))
    return each.select("e.text", tx.as_hiragana(tx.normalize(F.col("e.reading"))).alias("reading"), "definition")


def wards(rows: DataFrame) -> DataFrame:
    """rows: id (in file order), text, reading.  (text, reading, definition): wards, each under the city before it."""
    city = ~F.endswith("text", F.lit("区"))
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)  # a file of some hundred rows
    held = lambda c: F.last(F.when(city, F.col(c)), ignorenulls=True).over(before)
    placed = rows.withColumns({"_city": held("text"), "_city_reading": held("reading")}).where(~city)
    cut = lambda c, of: F.substring(F.col(c), F.char_length(of) + 1, F.char_length(c))
    named = placed.select(cut("text", "_city").alias("text"), cut("reading", "_city_reading").alias("reading"), romanized_place(F.col("_city"), F.col("_city_reading"), False).alias("_in"))
    return named.select("text", "reading", F.concat_ws(", ", romanized_place(F.col("text"), F.col("reading")), "_in").alias("definition"))


def read_delimited(spark: SparkSession, path: str, columns: str, separator: str = ",") -> DataFrame:
    return spark.read.schema(columns).option("sep", separator).csv(path)


def entry_xml(text: Column, reading: Column, definition: Column) -> Column:
    """An entry in the XML of the dictionary."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    writing = F.when(tx.in_class(text, "kana"), F.concat(F.lit("<r_ele><reb>"), escaped(text), F.lit("</reb></r_ele>"))).otherwise(
        F.concat(F.lit("<k_ele><keb>"), escaped(text), F.lit("</keb></k_ele><r_ele><reb>"), escaped(reading), F.lit("</reb></r_ele>"))
    )
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<entry><ent_seq></ent_seq>'), writing, F.lit("<sense><pos>n</pos><gloss>"), escaped(definition), F.lit("</gloss></sense></entry>"))
