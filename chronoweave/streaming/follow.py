"""Documents and facts that keep arriving, chunked or kept at their latest as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chronoweave.operators.chunk import chunks


def follow_documents(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks Parquet documents (source_id, title, text, ...) as they arrive at source, and appends them to out.

    Each batch writes a folder of its own, so that a batch that is run again
    after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
