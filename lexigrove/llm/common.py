"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space everywhere in this subpackage.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_MAX = (1 << 63) - 1

_written: list[tuple[SparkSession, str]] = []
_own = threading.local()  # the tables that this thread wrote, so queries built at once leave each other's alone


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def order_id(column: str = "doc_id") -> Column:
    """The id as it is ordered: a null id comes after every other."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LONG_MAX))


def id_of(order: Column) -> Column:
    """Back from order_id()."""
    return F.when(order != F.lit(LONG_MAX), order)


def lower_ascii(column: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(column, UPPER, LOWER)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker holds of its input: session settings for Arrow batches, lowered
    where they are above BATCH_ROWS and BATCH_BYTES."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        try:
            held = int(re.sub("[^0-9-]", "", spark.conf.get(name)))
        except Exception:  # a version without this setting
            continue
        if held <= 0 or held > most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir.

    Only where the session names none, as in tests on one machine, a temporary
    one is made.
    """
    try:
        named = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # a static setting that this session does not expose
        named = None
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lexigrove-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts the lineage, and what is lost with an executor is read again from
    the shared folder.  The tables go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrove/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    _tables().append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def in_written_order(df: DataFrame, name: str) -> DataFrame:
    """The rows in the order in which Spark wrote them, with a column ``name`` that rises along it, with gaps.

    A reader deals files and parts of files to its tasks by their size.  What is left of the order
    is the number of the task in the name of a file, the number of the file where a task wrote
    several, and the place of the row in it.  ``df`` is a Parquet table as it is read; rows that
    are read from no file stay as they stand.  Files that Spark did not write come first, each in its own order.
    """
    try:
        file = df.metadataColumn("_metadata")
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    number = lambda pattern: F.regexp_extract(file["file_name"], pattern, 1).try_cast("long")
    place = [number("^part-([0-9]+)").alias("_task"), number("-c([0-9]+)[.]").alias("_file"), file["file_name"].alias("_name"), file["row_index"].alias("_row")]
    order = ["_task", "_file", "_name", "_row"]
    dealt = df.select(F.struct("*").alias("row"), *place).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("row.*").withColumn(name, F.monotonically_increasing_id())


def _tables() -> list[tuple[SparkSession, str]]:
    if not hasattr(_own, "tables"):
        _own.tables = []
    return _own.tables


def written() -> int:
    """How many tables this thread has written: a mark for discard()."""
    return len(_tables())


def discard(since: int, *keep: DataFrame) -> None:
    """Delete the tables that this thread wrote after a mark, but for those that are still to be read."""
    held, tables = {df.table_path for df in keep}, _tables()
    for table in [t for t in tables[since:] if t[1] not in held]:
        _delete(*table)
        tables.remove(table)
        _written.remove(table)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone already
            return
