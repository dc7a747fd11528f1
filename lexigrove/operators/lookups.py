"""Lookups in a lexicon, for many keys at once.

``keys`` is a DataFrame with the columns that a lookup asks for; the result has
them beside the rows found, so one plan answers all keys.  A list of keys is a
semi-join: a repeated key finds a row once, except where a lookup follows links
and keeps duplicates, which is said.  Results are unordered; ``place`` numbers the
rows of a key where order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lexicon import Lexicon

DESU = 2755350
NOT_USED = ("arch", "obsc", "rare")


def placed(df: DataFrame, key: list[str], *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def found(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of a table for distinct keys."""
    return table.join(keys.select(*on).distinct(), list(on))


def common_rank(common: str = "common") -> list[Column]:
    """1, 2, 3 ... then 0, then none."""
    c = F.col(common)
    return [F.when(c.isNull(), 2).when(c == 0, 1).otherwise(0).asc(), c.asc_nulls_last()]


class Lookups:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lex = lexicon

    def _texts(self, kind: str) -> DataFrame:
        return {"kanji": self.lex.kanji_text, "kana": self.lex.kana_text}[kind]

    # --- entries -------------------------------------------------------------

    def entry_by_seq(self, keys):
        return found(self.lex.entry, keys, "seq")

    def root_seqs(self, keys):
        return found(self.lex.entry.where("root_p"), keys, "seq").select("seq")

    def candidate_seqs_kana(self, keys):
        """(text, seq) of entries written in kana only, by their first reading."""
        first = self.lex.kana_text.where("ord = 0").select("text", "seq")
        roots = self.lex.entry.where("root_p").select("seq")
        return found(first.join(roots, "seq", "left_semi").join(self.lex.kanji_text, "seq", "left_anti"), keys, "text")

    def candidate_seqs_kanji(self, keys):
        """(text, reading, seq) where both first forms match; no reading finds nothing."""
        kanji = self.lex.kanji_text.where("ord = 0").select("seq", "text")
        kana = self.lex.kana_text.where("ord = 0").select("seq", F.col("text").alias("reading"))
        roots = self.lex.entry.where("root_p").select("seq")
        return found(kanji.join(kana, "seq").join(roots, "seq", "left_semi"), keys, "text", "reading")

    # --- texts ---------------------------------------------------------------

    def headword_text(self, keys, kind: str):
        return found(self._texts(kind).where("ord = 0"), keys, "seq").select("seq", "text")

    def texts_by_seq_and_text(self, keys, kind: str):
        """One or many texts of an entry: both are keys (seq, text)."""
        return found(self._texts(kind), keys, "seq", "text")

    def texts_by_seq(self, keys, kind: str):
        return placed(found(self._texts(kind), keys, "seq"), ["seq"], "ord", "ordinal")

    def texts_by_id(self, keys, kind: str):
        """Every id must exist."""
        rows = keys.select("id").distinct().join(self._texts(kind), "id", "left")
        return rows.withColumn("seq", F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("no text of id "), "id")).cast("int")).otherwise(F.col("seq")))

    def texts_by_text(self, keys, kind: str, root_only: bool = False):
        rows = found(self._texts(kind), keys, "text")
        return rows.join(self.lex.entry.where("root_p"), "seq", "left_semi") if root_only else rows

    def texts_by_text_and_seqs(self, texts, seqs, kind: str):
        return found(self._texts(kind), texts, "text").join(seqs.select("seq"), "seq", "left_semi")

    def texts_conjugated_from(self, keys, kind: str):
        """keys: text, from.  Rows of entries derived from ``from``, one for each link (duplicates stay)."""
        links = self.lex.conjugation.select("seq", "from")
        return self._texts(kind).join(links, "seq").join(keys.select("text", "from").distinct(), ["text", "from"])

    def texts_with_pos(self, keys, kind: str):
        """keys: text, pos."""
        tagged = self.lex.sense_prop.where("tag = 'pos'").select("seq", F.col("text").alias("pos"))
        wanted = keys.select("text", "pos").distinct()
        return self._texts(kind).join(wanted, "text").join(tagged, ["seq", "pos"], "left_semi").drop("pos").distinct()

    def kana_forms(self, keys):
        """An entry's readings and those of all derived from it, as a set; ``of`` is the key."""
        own = found(self.lex.kana_text, keys, "seq").withColumn("of", F.col("seq"))
        links = self.lex.conjugation.select("seq", F.col("from").alias("of"))
        derived = self.lex.kana_text.join(links.join(keys.select(F.col("seq").alias("of")).distinct(), "of"), "seq")
        return own.unionByName(derived).distinct()

    def seqs_by_text(self, keys, kind: str):
        return found(self._texts(kind), keys, "text").select("text", "seq")

    def reading_texts(self, keys):
        return placed(found(self.lex.kana_text, keys, "seq"), ["seq"], "id").select("seq", "text", "place")

    def texts_by_regex(self, pattern: str):
        return self.lex.kana_text.where(F.col("text").rlike(pattern))

    def kanji_words_containing(self, keys):
        """keys: char.  Common root words with the character; characters are exploded, so it is an equi-join."""
        words = self.lex.kanji_text.where("common IS NOT NULL").withColumn("char", F.explode(F.array_distinct(F.split("text", ""))))
        kana = self.lex.kana_text.select("seq", F.col("text").alias("best_kana"))
        found_words = words.join(keys.select("char").distinct(), "char").join(kana, ["seq", "best_kana"])
        return found_words.join(self.lex.entry.where("root_p"), "seq", "left_semi").select("char", "seq", "text", "best_kana", "common")

    # --- conjugation ---------------------------------------------------------

    def conjugations(self, keys, *on: str):
        """Links by seq, by (seq, id) or by (seq, from)."""
        return found(self.lex.conjugation, keys, *(on or ("seq",)))

    def direct_conjugations(self, keys):
        return found(self.lex.conjugation.where("via IS NULL"), keys, "seq")

    def desu_seqs(self, keys):
        return found(self.lex.conjugation.where(F.col("from") == DESU), keys, "seq").select("seq").distinct()

    def derived_seqs(self, keys):
        return self.lex.conjugation.join(keys.select(F.col("seq").alias("from")).distinct(), "from").select("seq").distinct()

    def underived(self):
        return self.lex.entry.join(self.lex.conjugation, "seq", "left_anti").select("seq")

    def conj_props(self, keys):
        return found(self.lex.conj_prop, keys, "conj_id")

    def source_readings(self, keys, *on: str):
        """By conj_id, (conj_id, text) or (conj_id, source_text)."""
        return found(self.lex.conj_source_reading, keys, *(on or ("conj_id",)))

    def parents(self, keys, kind: str):
        """keys: seq, text.  (seq, text, text_id, conj_id): the form that a derived form comes from."""
        links = self.lex.conjugation.select("seq", F.col("id").alias("conj_id"), F.coalesce("via", "from").alias("parent"))
        source = self.lex.conj_source_reading.select("conj_id", "text", "source_text")
        texts = self._texts(kind).select(F.col("id").alias("text_id"), F.col("seq").alias("parent"), F.col("text").alias("source_text"))
        wanted = keys.select("seq", "text").distinct()
        return wanted.join(links, "seq").join(source, ["conj_id", "text"]).join(texts, ["parent", "source_text"]).select("seq", "text", "text_id", "conj_id")

    # --- senses --------------------------------------------------------------

    def sense_glosses(self, keys):
        """(seq, sense_id, ord, glosses), null where a sense has none."""
        senses = found(self.lex.sense, keys, "seq").select("seq", F.col("id").alias("sense_id"), "ord")
        glosses = self.lex.gloss.groupBy("sense_id").agg(F.expr("listagg(text, '; ') WITHIN GROUP (ORDER BY ord)").alias("glosses"))
        return senses.join(glosses, "sense_id", "left")

    def sense_props(self, keys, tags: list[str]):
        props = self.lex.sense_prop.where(F.col("tag").isin(tags)).select("sense_id", "tag", "text", F.col("ord").alias("prop_ord"), "ordinal")
        senses = found(self.lex.sense, keys, "seq").select("seq", F.col("id").alias("sense_id"), "ord")
        return placed(senses.join(props, "sense_id"), ["seq"], "ord", "tag", "prop_ord", "ordinal")

    def first_glosses(self, keys, pos: str | None = None):
        rows = self.sense_glosses(keys)
        if pos:
            tagged = self.lex.sense_prop.where((F.col("tag") == "pos") & (F.col("text") == pos))
            rows = rows.join(tagged, "sense_id", "left_semi")
        return rows.groupBy("seq").agg(F.min_by("glosses", "ord").alias("glosses"))

    def glosses(self, keys):
        senses = found(self.lex.sense, keys, "seq").select("seq", F.col("id").alias("sense_id"), F.col("ord").alias("sense_ord"))
        return placed(senses.join(self.lex.gloss, "sense_id"), ["seq"], "sense_ord", "ord").select("seq", "text", "place")

    def usually_kana_senses(self, keys):
        tagged = self.lex.sense_prop.where("tag = 'misc' AND text = 'uk'")
        return found(tagged, keys, "seq").select("seq", "sense_id")

    def first_senses(self, keys):
        """Of sense ids, those that come first in their entry."""
        return found(self.lex.sense.where("ord = 0"), keys, "id").select("id")

    def used_pos(self, keys):
        """(seq, pos) of senses that are not archaic, obscure or rare."""
        old = self.lex.sense_prop.where((F.col("tag") == "misc") & F.col("text").isin(*NOT_USED))
        pos = found(self.lex.sense_prop.where("tag = 'pos'"), keys, "seq").join(old, "sense_id", "left_anti")
        return pos.select("seq", F.col("text").alias("pos")).distinct()

    def archaic_seqs(self):
        """Entries of which every sense is archaic, obscure or rare, and those derived from them."""
        old = self.lex.sense_prop.where((F.col("tag") == "misc") & F.col("text").isin(*NOT_USED)).select(F.col("sense_id").alias("id")).distinct()
        senses = self.lex.sense.join(old.withColumn("old", F.lit(True)), "id", "left")
        only = senses.groupBy("seq").agg(F.bool_and(F.coalesce("old", F.lit(False))).alias("all_old")).where("all_old").select("seq")
        return only.unionByName(self.derived_seqs(only)).distinct()

    def counter_seqs(self):
        return self.lex.sense_prop.where("tag = 'pos' AND text = 'ctr'").select("seq").distinct()

    def counter_restrictions(self, keys, tag: str):
        counters = self.lex.sense_prop.where("tag = 'pos' AND text = 'ctr'").select("seq", "sense_id")
        return found(self.lex.sense_prop.where(F.col("tag") == tag), keys, "seq").join(counters, ["seq", "sense_id"]).select("seq", "text")

    def restrictions(self, keys):
        return found(self.lex.restricted_readings, keys, "seq").select("seq", "reading", "text")

    # --- characters ----------------------------------------------------------

    def kanji_by_text(self, keys):
        return found(self.lex.kanji, keys, "text")

    def kanji_readings(self, keys):
        """keys: kanji_id.  Readings but for names, most used first."""
        rows = found(self.lex.reading.where("type <> 'ja_na'"), keys, "kanji_id")
        return placed(rows, ["kanji_id"], F.desc("type"), F.desc("stat_common"), "ordinal")

    def kanji_meanings(self, keys):
        return placed(found(self.lex.meaning, keys, "kanji_id"), ["kanji_id"], "id")

    def okurigana(self, keys):
        return found(self.lex.okurigana, keys, "reading_id").select("reading_id", "text").distinct()

    def reading_statistics(self, keys):
        """keys: text, reading, type."""
        readings = self.lex.reading.select("kanji_id", F.col("text").alias("reading"), "type", F.col("stat_common").alias("reading_common"), F.col("id").alias("reading_id"))
        kanji = self.lex.kanji.select(F.col("id").alias("kanji_id"), "text", "stat_common", "grade")
        return found(kanji.join(readings, "kanji_id"), keys, "text", "reading", "type")

    def kanji_reading_pairs(self, keys, without: list[str]):
        kanji = found(self.lex.kanji, keys, "text").select(F.col("id").alias("kanji_id"), "text")
        readings = self.lex.reading.where(~F.col("type").isin(without)).select("kanji_id", F.col("text").alias("reading"), "type", "id")
        return placed(kanji.join(readings, "kanji_id"), ["text"], "id").select("text", "reading", "type", "place")
