"""Log replay as a stream: each micro-batch becomes a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from versionlog.operators.merge import latest
from versionlog.schema import RECORD


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New files of a log directory; the checkpoint is the watermark of a restart."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def flush(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Writes the latest records of each micro-batch as run ``run=<batch>``, sorted by key.

    A batch that is tried again overwrites its own run, so replay is idempotent.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{root}/run={number:08d}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
