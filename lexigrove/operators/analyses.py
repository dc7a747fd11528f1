"""How derived words are explained: their links, chains of steps, senses that apply, best readings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import tables as t
from ..functions import text as tx
from ..sources.lexicon import Lexicon

# Fixed values.
PASSIVE, POTENTIAL_POS = 6, ("v1", "v1s", "vk")
RARERU = ("られる", "られます", "られない", "られません")
#: Forms that are no words of their own (type, negative, formal; null: any), and of verbs of a part of speech.
SKIPPED_FORMS = ((None, 10, True, None), (None, 3, True, True), ("vs-s", 5, None, None))
WEAK_FORMS = ((None, 51, None, None), (None, 52, None, None), (None, 53, None, None), (None, 54, None, None), (None, 9, True, None))


def type_order(kind: Column) -> Column:
    """For sorting: 13 where 10 stands and the other way round."""
    return F.when(kind == 10, 13).when(kind == 13, 10).otherwise(kind)


def is_rareru(text: Column) -> Column:
    out = F.lit(False)
    for ending in RARERU:
        out = out | F.endswith(text, F.lit(ending))
    return out


def is_form(pos: Column, kind: Column, neg: Column, fml: Column, forms: tuple) -> Column:
    """Whether a property is one of the forms; null in a form stands for anything."""
    out = F.lit(False)
    for p, k, n, f in forms:
        own = kind == k
        own = own & (pos == p) if p is not None else own
        own = own & neg.eqNullSafe(F.lit(n)) if n is not None else own
        out = out | (own & fml.eqNullSafe(F.lit(f)) if f is not None else own)
    return out


def skipped(links: Column) -> Column:
    """Whether all links (structs with pos, conj_type, neg, fml) of a word are skipped forms."""
    return (F.size(links) > 0) & F.forall(links, lambda c: is_form(c["pos"], c["conj_type"], c["neg"], c["fml"], SKIPPED_FORMS))


def conjugation_data(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: seq.  (seq, conj_id, from, via, conj_type, pos, neg, fml, sources): a row for each property
    of each link, with its source readings as an array of (text, source_text)."""
    links = lexicon.conjugation.join(keys.select("seq").distinct(), "seq").select("seq", F.col("id").alias("conj_id"), "from", "via")
    source = lexicon.conj_source_reading.groupBy("conj_id").agg(F.array_sort(F.collect_set(F.struct("text", "source_text"))).alias("sources"))
    props = lexicon.conj_prop.select("conj_id", "conj_type", "pos", "neg", "fml")
    return links.join(props, "conj_id").join(source, "conj_id", "left")


def selected(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: seq, text (may be null).  The direct links of each entry, or all where none is direct, without
    passives that the text does not show; ``place`` orders them: direct ones, then by type."""
    data = conjugation_data(lexicon, keys).withColumn("_direct", F.col("via").isNull())
    any_direct = F.max("_direct").over(Window.partitionBy("seq"))
    rows = data.withColumn("_any", any_direct).where("_direct OR NOT _any").drop("_any").join(keys.select("seq", "text").distinct(), "seq")
    least = F.min(type_order(F.col("conj_type"))).over(Window.partitionBy("seq", "text", "conj_id"))
    passive = (F.col("conj_type") == PASSIVE) & F.col("pos").isin(*POTENTIAL_POS) & F.col("text").isNotNull() & ~is_rareru(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("seq", "text").orderBy(F.col("via").isNotNull(), "_least", "conj_id", "conj_type", "pos", "neg", "fml")
    return rows.withColumn("_least", least).where(~passive).withColumn("place", F.row_number().over(order)).drop("_least", "_direct")


def chains(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: seq, text.  (seq, text, conj_id, step, conj_type, pos, neg, fml, source, source_text): the
    steps from the dictionary form to a derived one, in order; a link by way of another derived form
    has that one's steps first."""
    own = selected(lexicon, keys).withColumn("_source", F.filter("sources", lambda s: s["text"] == F.col("text")))
    rows = own.select("seq", "text", "conj_id", "conj_type", "pos", "neg", "fml", "from", "via", F.get("_source", F.lit(0))["source_text"].alias("source_text"))
    direct = rows.where("via IS NULL").select("seq", "text", "conj_id", F.lit(1).alias("step"), "conj_type", "pos", "neg", "fml", F.col("from").alias("source"), "source_text")
    by_way = rows.where("via IS NOT NULL")
    last = by_way.select("seq", "text", "conj_id", F.lit(2).alias("step"), "conj_type", "pos", "neg", "fml", F.col("via").alias("source"), "source_text")
    before = selected(lexicon, by_way.select(F.col("via").alias("seq"), F.col("source_text").alias("text")).distinct()).where("via IS NULL")
    before = before.select(
        F.col("seq").alias("via"), F.col("text").alias("source_text"), F.col("conj_type").alias("_t"), F.col("pos").alias("_p"), F.col("neg").alias("_n"), F.col("fml").alias("_f"),
        F.col("from").alias("_from"), F.get(F.filter("sources", lambda s: s["text"] == F.col("text")), F.lit(0))["source_text"].alias("_first"),
    )
    first = by_way.join(before, ["via", "source_text"]).where(F.col("_from") == F.col("from"))
    first = first.select("seq", "text", "conj_id", F.lit(1).alias("step"), F.col("_t").alias("conj_type"), F.col("_p").alias("pos"), F.col("_n").alias("neg"), F.col("_f").alias("fml"), F.col("from").alias("source"), F.col("_first").alias("source_text"))
    return direct.unionByName(first).unionByName(last)


def original_texts(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: seq, text.  (seq, text, source, source_text): the dictionary forms that a derived form comes from."""
    return chains(lexicon, keys).where("step = 1").select("seq", "text", "source", "source_text").distinct()


def pairs_by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two lists of derived words (text, conj: links) aligned by the word they come from: (source, left_text, right_text)."""
    of = lambda df, name: df.select(F.col("text").alias(name), F.explode(F.array_distinct(F.transform("conj", lambda c: c["from"]))).alias("source"))
    return of(left, "left_text").join(of(right, "right_text"), "source", "full")


def simplified_readings(readings: list[str]) -> list[str]:
    """One text for each reading without its spaces: a space where all of its spellings have one, else a middle dot."""
    found: dict[str, list[set[int]]] = {}
    for reading in readings:
        marks, plain = set(), []
        for c in reading:
            if c == " ":
                marks.add(len(plain))
            else:
                plain.append(c)
        found.setdefault("".join(plain), []).append(marks)
    out = []
    for plain, spellings in found.items():
        mark = lambda i, s=spellings: "" if not any(i in m for m in s) else " " if all(i in m for m in s) else "·"
        out.append("".join(mark(i) + c for i, c in enumerate(plain)))
    return out


@F.pandas_udf(ArrayType(StringType()))
def simplify_reading_list(readings: pd.Series) -> pd.Series:
    return readings.map(lambda r: None if r is None else simplified_readings(list(r)))


def kana_kanji_allowed(lexicon: Lexicon, keys: DataFrame) -> DataFrame:
    """keys: seq, reading, kanji.  Those pairs that no restriction forbids."""
    rules = lexicon.restricted_readings.select("seq", "reading", F.col("text").alias("_kanji"))
    found = keys.join(rules.groupBy("seq", "reading").agg(F.collect_set("_kanji").alias("_only")), ["seq", "reading"], "left")
    return found.where(F.col("_only").isNull() | F.array_contains("_only", F.col("kanji"))).drop("_only")


def applicable_senses(lexicon: Lexicon, senses: DataFrame, keys: DataFrame) -> DataFrame:
    """senses: rows of senses.senses(); keys: seq, text, kind (kanji, kana).  The senses (and the key)
    whose restrictions to kanji (stagk) or readings (stagr) let the text have them."""
    tag = lambda name: F.coalesce(F.col("props")[name], F.array().cast("array<string>"))
    rows = senses.join(keys.select("seq", F.col("text").alias("key_text"), F.col("kind").alias("key_kind")).distinct(), "seq").withColumns({"_k": tag("stagk"), "_r": tag("stagr")})
    free = (F.size("_k") == 0) & (F.size("_r") == 0)
    named = F.array_contains("_k", F.col("key_text")) | F.array_contains("_r", F.col("key_text"))
    here = rows.withColumn("_ok", free | named)
    other = here.where(~F.col("_ok")).withColumn("_with", F.explode(F.when(F.col("key_kind") == "kanji", F.col("_r")).otherwise(F.col("_k"))))
    kanji = F.when(F.col("key_kind") == "kanji", F.col("key_text")).otherwise(F.col("_with"))
    reading = F.when(F.col("key_kind") == "kanji", F.col("_with")).otherwise(F.col("key_text"))
    tried = other.select("seq", "ord", "key_text", "key_kind", reading.alias("reading"), kanji.alias("kanji"))
    forms = lexicon.kana_text.select("seq", F.col("text").alias("reading")).distinct()
    writings = lexicon.kanji_text.select("seq", F.col("text").alias("kanji")).distinct()
    met = kana_kanji_allowed(lexicon, tried.join(forms, ["seq", "reading"], "left_semi").join(writings, ["seq", "kanji"], "left_semi"))
    by_pair = met.select("seq", "ord", "key_text", "key_kind").distinct().withColumn("_met", F.lit(True))
    return here.join(by_pair, ["seq", "ord", "key_text", "key_kind"], "left").where(F.col("_ok") | F.coalesce("_met", F.lit(False))).drop("_ok", "_met", "_k", "_r")


def best_readings(lexicon: Lexicon, kind: str = "kanji") -> DataFrame:
    """(id, best): of kanji forms the kana (or of kana forms the kanji) that goes with them.

    Dictionary forms have theirs; derived ones take it from the form they come from, by the
    source readings of the link: of several the one that is changed as the form itself is, else the
    one that fits the writing, the nearest in length, else the first.  Two rounds: forms by way
    of another come second.
    """
    table, column = (lexicon.kanji_text, "best_kana") if kind == "kanji" else (lexicon.kana_text, "best_kanji")
    roots = table.join(lexicon.entry.where("root_p").select("seq"), "seq", "left_semi").where(F.col(column).isNotNull()).select("id", "seq", "text", F.col(column).alias("best"))
    links = lexicon.conjugation.select("seq", F.col("id").alias("conj_id"), F.coalesce("via", "from").alias("parent"))
    readings = lexicon.conj_source_reading.select("conj_id", "text", "source_text")
    known = roots
    for _ in range(2):
        parents = known.select(F.col("seq").alias("parent"), F.col("text").alias("_parent_text"), F.col("best").alias("_parent_best"))
        open_ones = table.join(known.select("id"), "id", "left_anti").select("id", "seq", "text")
        found = (
            open_ones.join(links, "seq").join(readings, ["conj_id", "text"]).join(parents, "parent").where(F.col("source_text") == F.col("_parent_text")).drop("source_text")
            .join(readings.select("conj_id", F.col("text").alias("reading"), F.col("source_text").alias("_of")), "conj_id").where("_of = _parent_best")
        )
        crossed = tx.kanji_cross_match(F.col("_parent_text"), F.col("_parent_best"), F.col("text")) if kind == "kanji" else F.lit(None).cast("string")
        fits = tx.kanji_match(F.col("text"), F.col("reading")) if kind == "kanji" else tx.kanji_match(F.col("reading"), F.col("text"))
        ranked = found.withColumn("_cross", crossed)
        near = F.abs(F.char_length("reading") - F.coalesce(F.char_length("_cross"), F.lit(0)))
        order = F.struct((F.col("reading") != F.coalesce("_cross", F.lit(""))).alias("a"), (~fits).alias("b"), near.alias("c"), "conj_id", "reading")
        made = ranked.groupBy("id", "seq", "text").agg(F.min_by("reading", order).alias("best"))
        known = known.unionByName(made)
    return known.select("id", "best")


#: Kana classes before which 何 is read なん.
NAN = tuple(t.CLASS_OF[c] for row in ("b", "p", "d", "z", "t", "n", "r") for c in t.ROWS[row])


def reading_of_what(tokens: DataFrame, *key: str) -> DataFrame:
    """Tokens of 何 read as what follows asks: なん before certain rows, else なに; as it was where nothing with a reading follows."""
    order = Window.partitionBy(*key).orderBy("run_no", "token_no")
    head = tx.char_class_of(F.left(F.lead("kana").over(order), F.lit(1)))
    rows = tokens.withColumn("_next", F.lead("kana").over(order)).withColumn("_head", head)
    kana = F.when((F.col("token") == "何") & (F.coalesce("_next", F.lit("")) != ""), F.when(F.col("_head").isin(*NAN), "なん").otherwise("なに")).otherwise(F.col("kana"))
    return rows.withColumn("kana", kana).drop("_next", "_head")


def alternatives(solved: DataFrame) -> DataFrame:
    """solved: segment.solve().  (run, start, stop, words): of each list on the best path the words
    worth two thirds of its first or more, each kana once."""
    picked = F.transform(F.col("paths")[0]["path"], lambda p: F.struct(F.get("segments", p["segment"]).alias("s"), p["word"].alias("w")))
    rows = solved.select("run", F.explode(picked).alias("p")).select("run", "p.s.start", "p.s.stop", F.slice("p.s.words", F.col("p.w") + 1, F.size("p.s.words")).alias("_w"))
    kept = F.filter("_w", lambda w: w["score"] * 3 >= F.get("_w", F.lit(0))["score"] * 2)
    words = F.transform(kept, lambda w: F.struct(w["seq"].alias("seq"), w["kana"].alias("kana"), w["text"].alias("text"), w["score"].alias("score")))
    return rows.select("run", "start", "stop", words.alias("words"))


def ranked_paths(solved: DataFrame) -> DataFrame:
    """(run, rank, score, words): every path that was kept, best first, as texts."""
    path = F.posexplode("paths").alias("rank", "p")
    text = lambda p: F.get(F.get("segments", p["segment"])["words"], p["word"])["text"]
    return solved.select("run", "segments", path).select("run", "rank", "p.score", F.transform("p.path", text).alias("words"))
