"""The tables of a lexicon: schemas, reading, writing, and assembly from plain entries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Every table carries ``ordinal``, its row order, as the last tie-break of ordered results.
SCHEMAS = {
    "entry": "seq int, root_p boolean, n_kanji int, n_kana int, primary_nokanji boolean",
    "kanji_text": "id int, seq int, text string, ord int, common int, common_tags string, conjugate_p boolean, nokanji boolean, best_kana string",
    "kana_text": "id int, seq int, text string, ord int, common int, common_tags string, conjugate_p boolean, nokanji boolean, best_kanji string",
    "sense": "id int, seq int, ord int",
    "gloss": "id int, sense_id int, text string, ord int",
    "sense_prop": "id int, tag string, sense_id int, text string, ord int, seq int",
    "restricted_readings": "id int, seq int, reading string, text string",
    "conjugation": "id int, seq int, `from` int, via int",
    "conj_prop": "id int, conj_id int, conj_type int, pos string, neg boolean, fml boolean",
    "conj_source_reading": "id int, conj_id int, text string, source_text string",
    "kanji": "id int, text string, radical_c int, radical_n int, grade int, strokes int, freq int, stat_common int, stat_irregular int",
    "reading": "id int, kanji_id int, type string, text string, suffixp boolean, prefixp boolean, stat_common int",
    "okurigana": "id int, reading_id int, text string",
    "meaning": "id int, kanji_id int, text string",
}


def schema(name: str) -> str:
    return SCHEMAS[name] + ", ordinal long"


@dataclass(frozen=True)
class Lexicon:
    """The tables as DataFrames."""

    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError as missing:
            raise AttributeError(name) from missing

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Lexicon:
        return cls({name: spark.read.schema(schema(name)).parquet(f"{path}/{name}") for name in SCHEMAS})

    def write(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def of(cls, spark: SparkSession, rows: dict[str, Iterable[tuple]]) -> Lexicon:
        numbered = {name: [(*row, i) for i, row in enumerate(rows.get(name, ()))] for name in SCHEMAS}
        return cls({name: spark.createDataFrame(numbered[name], schema(name)) for name in SCHEMAS})


def assemble(entries: Iterable[dict]) -> dict[str, list[tuple]]:
    """Rows of the tables from entries with seq, kanji and kana ([(text, common)]), senses
    ([(pos, [misc], [gloss])]) and conjugations ([(from, via, type, pos, neg, fml, [(text, source)])])."""
    rows: dict[str, list[tuple]] = {name: [] for name in SCHEMAS}

    def add(name: str, *values) -> int:
        rows[name].append((len(rows[name]) + 1, *values))
        return len(rows[name])

    for e in entries:
        seq, kanji, kana = e["seq"], e.get("kanji", []), e.get("kana", [])
        derived = e.get("conjugations", [])
        rows["entry"].append((seq, not derived or e.get("root", False), len(kanji), len(kana), e.get("nokanji", False)))
        for name, texts, best in (("kanji_text", kanji, kana), ("kana_text", kana, kanji)):
            for k, (text, common) in enumerate(texts):
                add(name, seq, text, k, common, "", not derived, False, best[0][0] if best else None)
        for k, (pos, misc, glosses) in enumerate(e.get("senses", [])):
            sense = add("sense", seq, k)
            for j, gloss in enumerate(glosses):
                add("gloss", sense, gloss, j)
            for tag, values in (("pos", pos), ("misc", misc)):
                for j, value in enumerate(values):
                    add("sense_prop", tag, sense, value, j, seq)
        for source, via, kind, pos, neg, fml, readings in derived:
            link = add("conjugation", seq, source, via)
            add("conj_prop", link, kind, pos, neg, fml)
            for text, source_text in readings:
                add("conj_source_reading", link, text, source_text)
    return rows
