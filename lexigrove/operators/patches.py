"""Corrections of a lexicon: each is a function from tables to tables, applied in order.

Patches are sets: one call corrects any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.lexicon import Lexicon
from .analyses import best_readings
from .conjugation import numbered

Patch = Callable[[Lexicon], Lexicon]


def apply(lexicon: Lexicon, patches: Iterable[Patch]) -> Lexicon:
    for patch in patches:
        lexicon = patch(lexicon)
    return lexicon


def _with(lexicon: Lexicon, **tables: DataFrame) -> Lexicon:
    return Lexicon(lexicon.tables | tables)


def _appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with new ids and ordinals after those of the table, numbered in blocks of entries."""
    top = table.agg(F.max("id").alias("id"), F.max("ordinal").alias("ordinal")).first()
    last, begun = top["id"] or 0, -1 if top["ordinal"] is None else top["ordinal"]
    by = next(c for c in ("seq", "sense_id", "conj_id", "kanji_id") if c in rows.columns)
    given = numbered(rows, by, list(rows.columns), last, "id")
    return table.unionByName(given.withColumn("ordinal", (F.col("id") - last + begun).cast("long")), allowMissingColumns=True)


def set_column(name: str, keys: DataFrame, column: str) -> Patch:
    """keys: key columns and ``new``; rows that match get ``new`` in ``column``."""

    def patch(lexicon: Lexicon) -> Lexicon:
        table = lexicon.tables[name]
        on = [c for c in keys.columns if c != "new"]
        changed = keys.withColumn("_hit", F.lit(True))
        value = F.when(F.col("_hit"), F.col("new")).otherwise(F.col(column))
        return _with(lexicon, **{name: table.join(changed, on, "left").withColumn(column, value).select(*table.columns)})

    return patch


def delete_rows(name: str, keys: DataFrame) -> Patch:
    return lambda lexicon: _with(lexicon, **{name: lexicon.tables[name].join(keys, keys.columns, "left_anti").select(*lexicon.tables[name].columns)})


def add_readings(kind: str, rows: DataFrame) -> Patch:
    """rows: seq, text, common, conjugate_p; they come after the readings that an entry has."""

    def patch(lexicon: Lexicon) -> Lexicon:
        name = f"{kind}_text"
        table = lexicon.tables[name]
        top = table.groupBy("seq").agg(F.max("ord").alias("_top"))
        fresh = rows.join(table, ["seq", "text"], "left_anti").join(top, "seq", "left")
        place = F.row_number().over(Window.partitionBy("seq").orderBy("text"))
        new = fresh.select("seq", "text", (F.coalesce("_top", F.lit(-1)) + place).cast("int").alias("ord"), "common", F.lit("").alias("common_tags"), "conjugate_p", F.lit(False).alias("nokanji"))
        return recount(_with(lexicon, **{name: _appended(table, new)}))

    return patch


def delete_readings(kind: str, keys: DataFrame) -> Patch:
    """keys: seq, text.  Later readings move up."""
    return lambda lexicon: recount(reordered(delete_rows(f"{kind}_text", keys)(lexicon), kind))


def reordered(lexicon: Lexicon, kind: str, first: Column | None = None) -> Lexicon:
    """Numbers the readings of each entry again, those with ``first`` before others."""
    name = f"{kind}_text"
    order = Window.partitionBy("seq").orderBy(F.when(first, 0).otherwise(1) if first is not None else F.lit(0), "ord", "ordinal")
    table = lexicon.tables[name]
    return _with(lexicon, **{name: table.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).select(*table.columns)})


def add_sense_props(rows: DataFrame) -> Patch:
    """rows: seq, sense_ord, tag, text; what exists is not added again."""

    def patch(lexicon: Lexicon) -> Lexicon:
        senses = lexicon.sense.select(F.col("id").alias("sense_id"), "seq", F.col("ord").alias("sense_ord"))
        new = rows.join(senses, ["seq", "sense_ord"]).join(lexicon.sense_prop, ["sense_id", "tag", "text"], "left_anti")
        top = lexicon.sense_prop.groupBy("sense_id", "tag").agg(F.max("ord").alias("_top"))
        place = F.row_number().over(Window.partitionBy("sense_id", "tag").orderBy("text"))
        placed = new.join(top, ["sense_id", "tag"], "left").select("tag", "sense_id", "text", (F.coalesce("_top", F.lit(-1)) + place).cast("int").alias("ord"), "seq")
        return _with(lexicon, sense_prop=_appended(lexicon.sense_prop, placed))

    return patch


def delete_senses(keys: DataFrame) -> Patch:
    """keys: id of senses; their glosses and properties go with them."""

    def patch(lexicon: Lexicon) -> Lexicon:
        gone = keys.select(F.col("id").alias("sense_id"))
        kept = {name: lexicon.tables[name].join(gone, "sense_id", "left_anti").select(*lexicon.tables[name].columns) for name in ("gloss", "sense_prop")}
        return _with(lexicon, sense=lexicon.sense.join(keys, "id", "left_anti").select(*lexicon.sense.columns), **kept)

    return patch


def delete_conjugations(keys: DataFrame) -> Patch:
    """keys: id of links; derived entries that no link is left for go too."""

    def patch(lexicon: Lexicon) -> Lexicon:
        links = lexicon.conjugation.join(keys, "id", "left_anti").select(*lexicon.conjugation.columns)
        gone = keys.select(F.col("id").alias("conj_id"))
        parts = {name: lexicon.tables[name].join(gone, "conj_id", "left_anti").select(*lexicon.tables[name].columns) for name in ("conj_prop", "conj_source_reading")}
        orphans = lexicon.entry.where("NOT root_p").join(links, "seq", "left_anti").select("seq")
        rest = {name: lexicon.tables[name].join(orphans, "seq", "left_anti").select(*lexicon.tables[name].columns) for name in ("entry", "kanji_text", "kana_text")}
        return _with(lexicon, conjugation=links, **parts, **rest)

    return patch


def recount(lexicon: Lexicon) -> Lexicon:
    """n_kanji and n_kana of every entry."""
    count = lambda name, out: lexicon.tables[name].groupBy("seq").agg(F.count(F.lit(1)).cast("int").alias(out))
    entry = lexicon.entry.drop("n_kanji", "n_kana").join(count("kanji_text", "n_kanji"), "seq", "left").join(count("kana_text", "n_kana"), "seq", "left")
    return _with(lexicon, entry=entry.na.fill(0, ["n_kanji", "n_kana"]).select(*lexicon.entry.columns))


def all_readings(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: seq.  (seq, text): its kanji and kana."""
    both = lexicon.kanji_text.select("seq", "text").unionByName(lexicon.kana_text.select("seq", "text"))
    return both.join(keys.select("seq").distinct(), "seq").distinct()


def find_links(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: from, conj_type, pos, neg, fml (null: none said).  The links (id) of derived forms like that."""
    links = lexicon.conjugation.select(F.col("id").alias("conj_id"), "from").join(lexicon.conj_prop.drop("id", "ordinal"), "conj_id")
    wanted = keys.select(*[F.col(c).alias(f"_{c}") for c in ("from", "conj_type", "pos", "neg", "fml")])
    same = (F.col("from") == F.col("_from")) & (F.col("conj_type") == F.col("_conj_type")) & (F.col("pos") == F.col("_pos"))
    return links.join(wanted, same & F.col("neg").eqNullSafe(F.col("_neg")) & F.col("fml").eqNullSafe(F.col("_fml"))).select(F.col("conj_id").alias("id")).distinct()


def add_links(rows: DataFrame) -> Patch:
    """rows: seq, from, via, conj_type, pos, neg, fml, readings (array of text, source_text)."""

    def patch(lexicon: Lexicon) -> Lexicon:
        links = _appended(lexicon.conjugation, rows.select("seq", "from", "via").distinct())
        fresh = links.join(lexicon.conjugation.select("id"), "id", "left_anti").select(F.col("id").alias("conj_id"), F.col("seq").alias("_s"), F.col("from").alias("_f"), F.col("via").alias("_v"))
        of = rows.join(fresh, (F.col("seq") == F.col("_s")) & (F.col("from") == F.col("_f")) & F.col("via").eqNullSafe(F.col("_v")))
        props = _appended(lexicon.conj_prop, of.select("conj_id", "conj_type", "pos", "neg", "fml").distinct())
        source = of.select("conj_id", F.inline("readings")).toDF("conj_id", "text", "source_text").distinct()
        return _with(lexicon, conjugation=links, conj_prop=props, conj_source_reading=_appended(lexicon.conj_source_reading, source))

    return patch


def replace_prefix(kind: str, keys: DataFrame) -> Patch:
    """keys: from, prefix, new.  Texts of entries derived from ``from`` that begin so begin anew, in the
    source readings of their links too."""

    def patch(lexicon: Lexicon) -> Lexicon:
        name = f"{kind}_text"
        of = lexicon.conjugation.select("id", "seq", "from").join(keys, "from")
        begun = lambda c: F.when(F.startswith(c, F.col("prefix")), F.concat("new", F.expr(f"substring({c}, char_length(prefix) + 1)"))).otherwise(F.col(c))
        table, by_seq = lexicon.tables[name], of.select("seq", "prefix", "new").dropDuplicates(["seq", "prefix"])
        texts = table.join(by_seq, "seq", "left").withColumn("text", F.when(F.col("prefix").isNotNull(), begun("text")).otherwise(F.col("text"))).select(*table.columns)
        source, by_link = lexicon.conj_source_reading, of.select(F.col("id").alias("conj_id"), "prefix", "new").dropDuplicates(["conj_id", "prefix"])
        changed = source.join(by_link, "conj_id", "left").withColumn("text", F.when(F.col("prefix").isNotNull(), begun("text")).otherwise(F.col("text"))).select(*source.columns)
        return _with(lexicon, **{name: texts, "conj_source_reading": changed})

    return patch


def reset_best(lexicon: Lexicon) -> Lexicon:
    """Best kana and best kanji of all forms, from their entries and the forms that they come from."""
    out = {}
    for kind, column in (("kanji", "best_kana"), ("kana", "best_kanji")):
        other = lexicon.kana_text if kind == "kanji" else lexicon.kanji_text
        table = lexicon.tables[f"{kind}_text"]
        first = other.groupBy("seq").agg(F.min_by("text", F.struct("ord", "ordinal")).alias("_first"))
        rules = lexicon.restricted_readings.select("seq", F.col("reading"), F.col("text").alias("_kanji"))
        own, there = ("_kanji", "reading") if kind == "kanji" else ("reading", "_kanji")
        bound = rules.join(other.select("seq", F.col("text").alias(there), "ord"), ["seq", there]).groupBy("seq", F.col(own).alias("text")).agg(F.min_by(there, "ord").alias("_bound"))
        roots = table.join(lexicon.entry.where("root_p").select("seq"), "seq", "left_semi").join(first, "seq", "left").join(bound, ["seq", "text"], "left")
        fresh = roots.withColumn(column, F.coalesce("_bound", "_first")).select(*table.columns)
        rest = table.join(lexicon.entry.where("root_p").select("seq"), "seq", "left_anti").withColumn(column, F.lit(None).cast("string"))
        out[f"{kind}_text"] = fresh.unionByName(rest.select(*table.columns))
    made = _with(lexicon, **out)
    for kind, column in (("kanji", "best_kana"), ("kana", "best_kanji")):
        table = made.tables[f"{kind}_text"]
        out[f"{kind}_text"] = table.join(best_readings(made, kind), "id", "left").withColumn(column, F.coalesce("best", column)).select(*table.columns)
    return _with(lexicon, **out)


def add_senses(rows: DataFrame) -> Patch:
    """rows: seq, pos (array), glosses (array).  Senses after those of the entry; one that an entry has
    already, with the same parts of speech and glosses, is not added."""

    def patch(lexicon: Lexicon) -> Lexicon:
        glosses = lexicon.gloss.groupBy("sense_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_g"))
        pos = lexicon.sense_prop.where("tag = 'pos'").groupBy("sense_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_p"))
        texts = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<ord:int,text:string>>")), lambda x: x["text"])
        held = lexicon.sense.select("seq", F.col("id").alias("sense_id")).join(glosses, "sense_id", "left").join(pos, "sense_id", "left").select("seq", texts("_p").alias("pos"), texts("_g").alias("glosses"))
        fresh = rows.select("seq", "pos", "glosses").distinct().join(held, ["seq", "pos", "glosses"], "left_anti")
        top = lexicon.sense.groupBy("seq").agg(F.max("ord").alias("_top"))
        place = F.row_number().over(Window.partitionBy("seq").orderBy("pos", "glosses"))
        placed = fresh.join(top, "seq", "left").withColumn("ord", (F.coalesce("_top", F.lit(-1)) + place).cast("int"))
        senses = _appended(lexicon.sense, placed.select("seq", "ord"))
        given = senses.join(lexicon.sense.select("id"), "id", "left_anti").select(F.col("id").alias("sense_id"), "seq", "ord")
        of = placed.join(given, ["seq", "ord"]).drop("ord", "_top")
        each = lambda c: of.select("sense_id", "seq", F.posexplode(c).alias("ord", "text"))
        return _with(
            lexicon, sense=senses, gloss=_appended(lexicon.gloss, each("glosses").drop("seq")),
            sense_prop=_appended(lexicon.sense_prop, each("pos").withColumn("tag", F.lit("pos"))),
        )

    return patch


def add_glosses(rows: DataFrame) -> Patch:
    """rows: seq, sense_ord, text; after the glosses that the sense has."""

    def patch(lexicon: Lexicon) -> Lexicon:
        senses = lexicon.sense.select(F.col("id").alias("sense_id"), "seq", F.col("ord").alias("sense_ord"))
        top = lexicon.gloss.groupBy("sense_id").agg(F.max("ord").alias("_top"))
        place = F.row_number().over(Window.partitionBy("sense_id").orderBy("text"))
        placed = rows.join(senses, ["seq", "sense_ord"]).join(top, "sense_id", "left")
        return _with(lexicon, gloss=_appended(lexicon.gloss, placed.select("sense_id", "text", (F.coalesce("_top", F.lit(-1)) + place).cast("int").alias("ord"))))

    return patch


def add_spoken_forms(before: str = "では", after: str = "じゃ") -> Patch:
    """Readings of derived entries that begin with ``before`` are there with ``after`` too."""

    def patch(lexicon: Lexicon) -> Lexicon:
        derived = lexicon.kana_text.join(lexicon.conjugation.select("seq").distinct(), "seq", "left_semi").where(F.startswith("text", F.lit(before)))
        spoken = lambda c: F.concat(F.lit(after), F.expr(f"substring({c}, {len(before) + 1})"))
        rows = derived.select("seq", spoken("text").alias("text"), "common", "conjugate_p").distinct()
        made = add_readings("kana", rows)(lexicon)
        source = lexicon.conj_source_reading.where(F.startswith("text", F.lit(before))).select("conj_id", spoken("text").alias("text"), "source_text").distinct()
        fresh = source.join(lexicon.conj_source_reading, ["conj_id", "text", "source_text"], "left_anti")
        return _with(made, conj_source_reading=_appended(lexicon.conj_source_reading, fresh))

    return patch


def hiragana_has_kanji(lexicon: Lexicon) -> Lexicon:
    """Readings in hiragana are not marked as without kanji."""
    own = F.col("nokanji") & ~tx.in_class(F.col("text"), "hiragana")
    return _with(lexicon, kana_text=lexicon.kana_text.withColumn("nokanji", own))


def distinct_order(lexicon: Lexicon) -> Lexicon:
    """Properties of a sense that share tag and ord are numbered again, so that every order of them is one."""
    order = Window.partitionBy("sense_id", "tag").orderBy("ord", "ordinal")
    table = lexicon.sense_prop
    return _with(lexicon, sense_prop=table.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).select(*table.columns))
