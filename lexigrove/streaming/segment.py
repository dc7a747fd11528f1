"""Segmentation of a stream of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import tokens


def segment_stream(
    texts: DataFrame, features: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, text_col: str = "text", **how
) -> StreamingQuery:
    """Each micro-batch is segmented like a table and handed to ``sink(tokens, batch_id)``.

    The plan ranks candidates inside runs, which streams allow only within a batch; a
    text never spans batches.  A sink that overwrites what a batch id wrote before
    makes the whole exactly-once.
    """

    def batch(df: DataFrame, number: int) -> None:
        sink(tokens(df, features, text_col, **how), number)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
