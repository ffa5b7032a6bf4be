"""Token counts over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.tokens import tokenise


def record_stream(spark: SparkSession, path: str, schema: str = "read_id bigint, sequence string, category_id int", files_per_batch: int | None = None) -> DataFrame:
    """Records from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def running_counts(records: DataFrame, k: int) -> DataFrame:
    """(token, category_id, cnt) so far; for update or complete mode.  The state has a row per token and category."""
    return tokenise(records, k, ("category_id",), positions=False).groupBy("token", "category_id").agg(F.count("*").alias("cnt"))


def counted_into(records: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of each batch, written as they come; their sums are the counts of all, with no state between batches."""

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
