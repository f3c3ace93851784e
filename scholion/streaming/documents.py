"""New documents as they come: each micro-batch is analysed whole, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scholion.plans.engine import analyse


def follow(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, engine: str = "modern", available_now: bool = True) -> StreamingQuery:
    """Hands the items of each batch of ``docs`` (doc_id, text) and its number to ``sink``, which should write a number once."""

    def batch(df: DataFrame, number: int) -> None:
        sink(analyse(df, engine).items, number)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (doc_id, text) as they appear under ``path``."""
    return spark.readStream.schema("doc_id long, text string").json(path)
