"""Dictionary and character files in XML to lexicon tables, and delimited rule files.

Elements of entries: ent_seq, k_ele (keb, ke_pri, ke_inf), r_ele (reb, re_nokanji, re_restr,
re_pri, re_inf), sense (pos, misc, field, dial, s_inf, stagk, stagr, gloss).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lexicon import SCHEMAS, Lexicon

_MANY = "array<string>"
ENTRY = (
    "ent_seq int, "
    f"k_ele array<struct<keb:string,ke_pri:{_MANY},ke_inf:{_MANY}>>, "
    f"r_ele array<struct<reb:string,re_nokanji:string,re_restr:{_MANY},re_pri:{_MANY},re_inf:{_MANY}>>, "
    f"sense array<struct<pos:{_MANY},misc:{_MANY},field:{_MANY},dial:{_MANY},s_inf:{_MANY},stagk:{_MANY},stagr:{_MANY},gloss:{_MANY}>>"
)
CHARACTER = (
    "literal string, radical struct<rad_value:array<struct<_VALUE:int,_rad_type:string>>>, misc struct<grade:int,stroke_count:array<int>,freq:int>, "
    "reading_meaning struct<rmgroup:struct<reading:array<struct<_VALUE:string,_r_type:string>>,meaning:array<struct<_VALUE:string,_m_lang:string>>>>"
)
#: Tags of senses that are kept.
TAGS = ("pos", "misc", "field", "dial", "s_inf", "stagk", "stagr")
#: First numbers of rows that the lexicon makes itself.
OWN_SEQ = 10_000_000


def read_entries(spark: SparkSession, path: str, tag: str = "entry") -> DataFrame:
    return spark.read.schema(ENTRY).option("rowTag", tag).format("xml").load(path)


def plain_entities(text: Column) -> Column:
    """Entity declarations rewritten so that &n; reads as n, and uses likewise."""
    declared = F.regexp_replace(text, r'<!ENTITY\s+(\S+)\s+"[^"]*">', '<!ENTITY $1 "$1">')
    return F.regexp_replace(declared, r"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z0-9-]+);", "$1")


def commonness(priorities: Column) -> Column:
    """Null without a priority; its nf number, else 0."""
    ranks = F.filter(F.transform(priorities, lambda p: F.regexp_extract(p, "^nf([0-9]+)$", 1)), lambda r: r != "")
    return F.when(F.size(priorities) > 0, F.coalesce(F.get(ranks, F.lit(0)).cast("int"), F.lit(0)))


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Ids and ordinals in the order of the source.  Entries are ranked by number in
    partitions, and ids are sums of earlier partitions plus a place inside, so no task sees all rows."""
    columns = [c.split()[0].strip("`") for c in SCHEMAS[name].split(", ")]
    parts = F.floor(F.col("seq") / 4096).alias("_part")
    sized = df.withColumn("_part", parts)
    counts = sized.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each 4096 numbers
    place = F.row_number().over(Window.partitionBy("_part").orderBy("seq", *order))
    numbered = sized.join(offsets, "_part").withColumn("ordinal", F.col("_before") + place - 1)
    if "id" in columns:
        numbered = numbered.withColumn("id", (F.col("ordinal") + 1).cast("int"))
    return numbered


def _texts(entries: DataFrame, element: str, name: str) -> DataFrame:
    text, pri = {"k_ele": ("keb", "ke_pri"), "r_ele": ("reb", "re_pri")}[element]
    rows = entries.select(F.col("ent_seq").alias("seq"), F.posexplode(element).alias("ord", "e"))
    skipped = F.coalesce(F.exists(F.col("e")["ke_inf" if element == "k_ele" else "re_inf"], lambda x: x == "ok"), F.lit(False))
    rows = rows.where(~skipped).withColumn("ord", F.row_number().over(Window.partitionBy("seq").orderBy("ord")) - 1)
    pris = F.coalesce(f"e.{pri}", F.array().cast(_MANY))
    nokanji = F.col("e.re_nokanji").isNotNull() if element == "r_ele" else F.lit(False)
    return rows.select(
        "seq", F.col(f"e.{text}").alias("text"), "ord", commonness(pris).alias("common"),
        F.when(F.size(pris) > 0, F.concat(F.lit("["), F.array_join(pris, "]["), F.lit("]"))).otherwise("").alias("common_tags"),
        F.lit(True).alias("conjugate_p"), nokanji.alias("nokanji"),
    )


def lexicon_of(entries: DataFrame) -> Lexicon:
    """The tables of entries as read_entries() gives them."""
    spark = entries.sparkSession
    kanji, kana = _texts(entries, "k_ele", "kanji_text"), _texts(entries, "r_ele", "kana_text")
    first = lambda df, as_: df.groupBy("seq").agg(F.min_by("text", "ord").alias(as_))
    kanji_rows = kanji.join(first(kana.where("NOT nokanji"), "best_kana"), "seq", "left")
    kana_rows = kana.join(first(kanji, "_k"), "seq", "left").withColumn("best_kanji", F.when(~F.col("nokanji"), F.col("_k"))).drop("_k")
    counts = entries.select(
        F.col("ent_seq").alias("seq"), F.lit(True).alias("root_p"),
        F.coalesce(F.size("k_ele"), F.lit(0)).alias("n_kanji"), F.coalesce(F.size("r_ele"), F.lit(0)).alias("n_kana"),
        F.coalesce(F.col("r_ele")[0]["re_nokanji"].isNotNull(), F.lit(False)).alias("primary_nokanji"),
    )
    senses = _numbered(entries.select(F.col("ent_seq").alias("seq"), F.posexplode("sense").alias("ord", "s")), "sense", "ord")
    gloss = senses.select("seq", F.col("id").alias("sense_id"), F.posexplode("s.gloss").alias("ord", "text"))
    bags = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"s.{t}").alias("values")) for t in TAGS])
    props = senses.select("seq", F.col("id").alias("sense_id"), F.explode(bags).alias("b")).select("seq", "sense_id", "b.tag", F.posexplode("b.values").alias("ord", "text"))
    limits = entries.select(F.col("ent_seq").alias("seq"), F.explode("r_ele").alias("e")).select("seq", F.col("e.reb").alias("reading"), F.explode("e.re_restr").alias("text"))
    built = {
        "entry": _numbered(counts, "entry"),
        "kanji_text": _numbered(kanji_rows, "kanji_text", "ord"),
        "kana_text": _numbered(kana_rows, "kana_text", "ord"),
        "sense": senses,
        "gloss": _numbered(gloss, "gloss", "sense_id", "ord"),
        "sense_prop": _numbered(props, "sense_prop", "sense_id", "tag", "ord"),
        "restricted_readings": _numbered(limits, "restricted_readings", "reading", "text"),
    }
    tables = {}
    for name in SCHEMAS:
        empty = spark.createDataFrame([], SCHEMAS[name] + ", ordinal long")
        if name in built:
            tables[name] = built[name].select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])
        else:
            tables[name] = empty
    return Lexicon(tables)


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHARACTER).option("rowTag", "character").format("xml").load(path)


def readings_of(characters: DataFrame) -> DataFrame:
    """(literal, type, text, okurigana, prefixp, suffixp): た.べる has okurigana べる, -ば is a suffix."""
    group = F.col("reading_meaning.rmgroup.reading")
    wanted = F.filter(group, lambda r: r["_r_type"].isin("ja_on", "ja_kun"))
    rows = characters.select("literal", F.explode(wanted).alias("r")).select("literal", F.col("r._r_type").alias("type"), F.col("r._VALUE").alias("raw"))
    bare = F.regexp_replace("raw", "-", "")
    return rows.select(
        "literal", "type", F.substring_index(bare, ".", 1).alias("text"), F.when(F.contains(bare, F.lit(".")), F.substring_index(bare, ".", -1)).alias("okurigana"),
        F.col("raw").endswith("-").alias("prefixp"), F.col("raw").startswith("-").alias("suffixp"),
    ).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Conjugation rules: tab-separated with a header; t and f are booleans."""
    schema = "pos int, conj int, neg string, fml string, onum int, stem int, okuri string, euphr string, euphk string, pos2 string"
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    flag = lambda c: (F.col(c) == "t").alias(c)
    return rows.select("pos", "conj", flag("neg"), flag("fml"), "onum", "stem", blank("okuri"), blank("euphr"), blank("euphk"))


def read_wards(spark: SparkSession, path: str) -> DataFrame:
    """(id, city, text, reading) of a comma-separated file in which a ward's row follows its city's."""
    rows = spark.read.schema("id int, text string, reading string").csv(path)
    is_city = F.col("text").rlike("市$")
    city = F.last(F.when(is_city, F.col("text")), ignorenulls=True).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("city", city).select("id", F.when(~is_city, F.col("city")).alias("city"), "text", "reading")
