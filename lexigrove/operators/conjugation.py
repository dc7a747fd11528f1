"""Conjugation: rules times readings, identity of derived entries, and their description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_class
from ..sources.lexicon import Lexicon
from ..sources.tables import settled

#: Types that are conjugated again.  Fixed values.
SECONDARY_FROM = (5, 6, 7, 8, 53)
SECONDARY_TO = (2, 3, 4, 9, 10, 11, 12, 13)
CAUSATIVE_SU, NOT_SECONDARY = 53, ("vs-i", "vs-s")
DERIVED_SEQ = 10_000_000


def conjugated(word: Column, stem: Column, okuri: Column, euphr: Column, euphk: Column) -> Column:
    """A word with its ending replaced; a sound change before it costs one more character."""
    kana = in_class(F.right(word, F.lit(2)), "kana")
    change = F.when(kana, euphr).otherwise(euphk)
    keep = F.char_length(word) - stem - F.when(change != "", 1).otherwise(0)
    return F.concat(F.substring(word, F.lit(1), F.greatest(keep, F.lit(0))), change, okuri)


def forms(lexicon: Lexicon, rules: DataFrame, pos_index: DataFrame, types: list[int] | None = None) -> DataFrame:
    """(seq, pos, conj, neg, fml, text, kanji, source, ord, onum): every form of every reading.

    rules: as sources.dictionary_xml.read_rules(); pos_index: (pos int, kw string).
    One join for the whole lexicon.  neg and fml are null where no cell of the type has them.
    """
    texts = lexicon.kanji_text.where("conjugate_p").select("seq", "text", "ord", F.lit(True).alias("kanji")).unionByName(
        lexicon.kana_text.where("conjugate_p").select("seq", "text", "ord", F.lit(False).alias("kanji"))
    )
    pos = lexicon.sense_prop.where("tag = 'pos'").select("seq", F.col("text").alias("kw")).distinct()
    return forms_of(texts, pos, rules, pos_index, types)


def forms_of(texts: DataFrame, pos: DataFrame, rules: DataFrame, pos_index: DataFrame, types=None, key: tuple[str, ...] = ("seq",)) -> DataFrame:
    """forms() of texts (key, text, ord, kanji) with parts of speech (key, kw)."""
    own = rules if types is None else rules.where(F.col("conj").isin(*types))
    made = pos.join(F.broadcast(pos_index), "kw").join(F.broadcast(own), "pos").join(texts, list(key))  # rules: a few thousand
    made = made.withColumn("form", conjugated(F.col("text"), F.col("stem"), F.col("okuri"), F.col("euphr"), F.col("euphk")))
    cell = Window.partitionBy(*key, "pos", "conj")
    made = made.withColumn("_neg", F.bool_or("neg").over(cell)).withColumn("_fml", F.bool_or("fml").over(cell))
    # A form equal to a reading of the word itself is no derived form.
    own_texts = texts.select(*key, F.col("text").alias("form")).distinct()
    made = made.join(own_texts, [*key, "form"], "left_anti")
    return made.select(
        *key, F.col("kw").alias("pos"), "conj", F.when(F.col("_neg"), F.col("neg")).alias("neg"), F.when(F.col("_fml"), F.col("fml")).alias("fml"),
        F.col("form").alias("text"), "kanji", F.col("text").alias("source"), "ord", "onum",
    )


def secondary_forms(primary: DataFrame, rules: DataFrame, pos_index: DataFrame) -> DataFrame:
    """forms() of derived words, with ``via``: their entry.  primary: derived_entries().

    Potentials, passives and causatives are conjugated again as the verbs that they are.
    """
    plain = ~F.coalesce("neg", F.lit(False)) & ~F.coalesce("fml", F.lit(False))
    cells = primary.where(F.col("conj").isin(*SECONDARY_FROM) & ~F.col("pos").isin(*NOT_SECONDARY) & plain)
    kind = cells.groupBy("seq", F.col("derived").alias("via")).agg(F.min("conj").alias("_conj"))
    pos = kind.select("seq", "via", F.when(F.col("_conj") == CAUSATIVE_SU, "v5s").otherwise("v1").alias("kw"))
    texts = cells.select("seq", F.col("derived").alias("via"), "text", "ord", "kanji").distinct()
    return forms_of(texts, pos, rules, pos_index, SECONDARY_TO, ("seq", "via"))


def numbered(rows: DataFrame, by: str, order: list[str], first: int, name: str) -> DataFrame:
    """``name``: numbers after ``first``, in blocks of 4096 values of ``by``, so no task orders all rows."""
    parts = rows.withColumn("_part", F.floor(F.col(by) / 4096))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    made = parts.join(counts.select("_part", before.alias("_before")), "_part")
    return made.withColumn(name, (F.lit(first) + F.col("_before") + inside).cast("int")).drop("_part", "_before")


def with_conjugations(lexicon: Lexicon, rules: DataFrame, pos_index: DataFrame) -> Lexicon:
    """The lexicon with the entries, links, properties and source readings of all derived forms, direct
    and secondary; each set of forms is one entry, whoever it is derived from."""
    primary = settled(derived_entries(forms(lexicon, rules, pos_index)).withColumn("via", F.lit(None).cast("int")))
    top = primary.agg(F.max("derived")).first()[0] or DERIVED_SEQ
    again = settled(derived_entries(secondary_forms(primary, rules, pos_index), top, ("seq", "via"), primary))
    made = primary.unionByName(again.select(*primary.columns))
    link = made.select(F.col("derived").alias("seq"), F.col("seq").alias("from"), "via").distinct()
    last = lambda name, column: lexicon.tables[name].agg(F.max(column)).first()[0] or 0
    links = settled(numbered(link, "seq", ["seq", "from", "via"], last("conjugation", "id"), "id"))
    keyed = made.select(F.col("derived").alias("_d"), F.col("seq").alias("_f"), F.col("via").alias("_v"), "pos", "conj", "neg", "fml", "text", "kanji", "source", "ord", "onum")
    of = keyed.join(links, (F.col("_d") == F.col("seq")) & (F.col("_f") == F.col("from")) & F.col("_v").eqNullSafe(F.col("via"))).withColumnRenamed("id", "conj_id")
    props = numbered(of.select("conj_id", F.col("conj").alias("conj_type"), "pos", "neg", "fml").distinct(), "conj_id", ["conj_id", "conj_type", "pos", "neg", "fml"], last("conj_prop", "id"), "id")
    source = numbered(of.select("conj_id", "text", F.col("source").alias("source_text")).distinct(), "conj_id", ["conj_id", "text", "source_text"], last("conj_source_reading", "id"), "id")
    texts = made.groupBy(F.col("derived").alias("seq"), "text", "kanji").agg(F.min(F.struct("onum", "ord")).alias("_at"))
    place = Window.partitionBy("seq", "kanji").orderBy("_at", "text")
    listed = texts.withColumn("ord", (F.row_number().over(place) - 1).cast("int"))
    entries = listed.groupBy("seq").agg(F.count_if("kanji").cast("int").alias("n_kanji"), F.count_if(~F.col("kanji")).cast("int").alias("n_kana"))

    def added(name: str, rows: DataFrame) -> DataFrame:
        table = lexicon.tables[name]
        begun = table.agg(F.max("ordinal")).first()[0]
        key = "id" if "id" in rows.columns else "seq"
        return table.unionByName(numbered(rows, key, [key], -1 if begun is None else begun, "ordinal").withColumn("ordinal", F.col("ordinal").cast("long")), allowMissingColumns=True)

    def form_rows(kind: bool) -> DataFrame:
        name = "kanji_text" if kind else "kana_text"
        own = listed.where(F.col("kanji") == F.lit(kind)).select("seq", "text", "ord", F.lit("").alias("common_tags"), F.lit(False).alias("conjugate_p"), F.lit(False).alias("nokanji"))
        return numbered(own, "seq", ["seq", "ord"], last(name, "id"), "id")

    return Lexicon(
        lexicon.tables
        | {
            "entry": added("entry", entries.withColumns({"root_p": F.lit(False), "primary_nokanji": F.lit(False)})),
            "kanji_text": added("kanji_text", form_rows(True)),
            "kana_text": added("kana_text", form_rows(False)),
            "conjugation": added("conjugation", links),
            "conj_prop": added("conj_prop", props),
            "conj_source_reading": added("conj_source_reading", source),
        }
    )


def derived_entries(made: DataFrame, first: int = DERIVED_SEQ, key: tuple[str, ...] = ("seq",), known: DataFrame | None = None) -> DataFrame:
    """Forms with ``derived``, the number of the entry that holds them.

    Cells (word, pos, type, neg, fml) with the same set of kanji and the same set of
    kana forms are one entry, also with those of ``known`` (forms with ``derived``): sets are
    compared as sorted arrays.  Cells without kana are dropped.
    """
    cell = [*key, "pos", "conj", "neg", "fml"]
    both = [
        F.array_sort(F.collect_set(F.when(F.col("kanji"), F.col("text")))).alias("_kanji"),
        F.array_sort(F.collect_set(F.when(~F.col("kanji"), F.col("text")))).alias("_kana"),
    ]
    sets = made.groupBy(*cell).agg(*both).where(F.size("_kana") > 0)
    identity = sets.groupBy("_kanji", "_kana").agg(F.min(F.struct("seq", "pos", "conj")).alias("_first"))
    fresh = identity
    if known is not None:
        old = known.groupBy("derived", "seq", "pos", "conj", "neg", "fml").agg(*both).groupBy("_kanji", "_kana").agg(F.min("derived").alias("derived"))
        fresh = identity.join(old, ["_kanji", "_kana"], "left_anti")
    given = numbered(fresh.withColumn("_by", F.col("_first.seq")), "_by", ["_first", "_kanji", "_kana"], first, "derived").select("_kanji", "_kana", "derived")
    if known is not None:
        given = given.unionByName(old.join(identity, ["_kanji", "_kana"], "left_semi").select("_kanji", "_kana", "derived"))
    keyed = sets.join(given, ["_kanji", "_kana"]).select(*[F.col(c).alias(f"_{c}") for c in cell], "derived")
    condition = F.lit(True)
    for c in cell:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return made.join(keyed, condition).select(*made.columns, "derived")


def descriptions(lexicon: Lexicon, names: DataFrame) -> DataFrame:
    """(seq, chain): one line for each link of a derived entry, by id.  names: (conj_type, name)."""
    label = F.concat_ws(
        " ", F.concat(F.lit("["), "pos", F.lit("]")), "name",
        F.when(F.col("neg"), F.lit("Negative")).when(~F.col("neg"), F.lit("Affirmative")),
        F.when(F.col("fml"), F.lit("Formal")).when(~F.col("fml"), F.lit("Plain")),
    )
    links = lexicon.conjugation.select(F.col("id").alias("conj_id"), "seq", "from", "via")
    props = lexicon.conj_prop.select("conj_id", "conj_type", "pos", "neg", "fml").join(F.broadcast(names), "conj_type", "left")  # at most a few dozen names
    rows = links.join(props, "conj_id").withColumn("label", label)
    return rows.groupBy("seq").agg(F.expr("listagg(label, '\n') WITHIN GROUP (ORDER BY conj_id)").alias("chain"))
