"""Documents and edits as streams. Parsing and packing need no state, so they run per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import trim
from ..operators.parts import split


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files that arrive in a folder, whole: path, text."""
    stream = spark.readStream.format("text").option("wholetext", True).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_stream(docs: DataFrame, out: str, checkpoint: str, size: int = 8000) -> StreamingQuery:
    """Splits each new document and appends its parts to a Parquet table, whose batch folder is replaced
    if a batch is repeated; stops when all that is there has been read."""

    def store(batch: DataFrame, number: int) -> None:
        split(batch, size, ["path"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(edits: DataFrame, key: str = "job_id") -> DataFrame:
    """Running number of edited parts per job, exact, from a stream of (job_id, part, text); for update mode.

    The state has a row for each job and part.
    """
    done = edits.where(trim(F.col("text")) != "").select(key, "part").dropDuplicates([key, "part"])
    return done.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
