"""Lexicons in relational stores, and sinks of output documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import SCHEMAS, Lexicon

#: Rows that one task reads, about.
PART_ROWS = 500_000


def read_store(spark: SparkSession, url: str, schema: str | None = None, order: dict[str, str] | None = None, **properties: str) -> Lexicon:
    """The tables of a lexicon over JDBC, each in ranges of its key, so that tasks read side by side.

    ``order``: a column of each table that has its row order (the key where none is named).
    """
    prefix = f"{schema}." if schema else ""
    tables = {}
    for name, fields in SCHEMAS.items():
        key = "id" if fields.startswith("id ") else "seq"
        names = [f.strip().split(" ")[0].strip("`") for f in fields.split(",")]
        bounds = spark.read.jdbc(url, f"(SELECT min({key}) AS lo, max({key}) AS hi, count(*) AS n FROM {prefix}{name}) q", properties=properties).first()
        lo, hi, n = bounds[0] or 0, bounds[1] or 0, bounds[2]
        parts = max(1, min(-(-n // PART_ROWS), hi - lo + 1))
        rows = spark.read.jdbc(url, f"{prefix}{name}", column=key, lowerBound=lo, upperBound=hi + 1, numPartitions=parts, properties=properties)
        tables[name] = rows.select(*names, F.col((order or {}).get(name, key)).cast("long").alias("ordinal"))
    return Lexicon(tables)


def write_documents(documents: DataFrame, path: str, form: str) -> None:
    """documents: a key and ``output``, as operators.documents.render() gives them.  Lines of text for
    the romanized forms, else one JSON document a line with its key."""
    key = next(c for c in documents.columns if c != "output")
    if form.startswith("romanize"):
        documents.select(F.col("output").alias("value")).where("output IS NOT NULL").write.mode("overwrite").text(path)
    else:
        kept = F.to_json(F.struct(F.col(key).alias("key")))
        line = F.concat(F.substring(kept, F.lit(1), F.char_length(kept) - 1), F.lit(',"document":'), "output", F.lit("}"))
        documents.select(line.alias("value")).write.mode("overwrite").text(path)
