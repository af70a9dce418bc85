"""Resumable processing as file streams with checkpoints.

A file that was processed is not read again, so a run that broke off goes on
where it stopped; the batch function gets what is new and writes it idempotently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new_files(spark: SparkSession, source: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], kind: str = "parquet", max_files: int = 100, max_seconds: int | None = None) -> bool:
    """Feeds unseen files of a folder to ``each`` in bounded batches; true if it came to the end.

    ``max_seconds`` stops a run after a time; the next one continues.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ended = query.awaitTermination(max_seconds) if max_seconds is not None else (query.awaitTermination() or True)
    if not ended:
        query.stop()
    return bool(ended)


def append_new(target: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that appends rows whose keys are not in the target table yet.

    The target is partitioned by a hash of the keys, and a batch reads only the key
    columns of the partitions that its own keys fall into.  What a batch writes
    carries its number and replaces what a failed try of the same batch left, so a
    repeated batch adds nothing twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(target)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = batch.dropDuplicates(keys).withColumn("bucket", bucket).withColumn("batch", F.lit(batch_id))
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            hit = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
            known = spark.read.schema(fresh.schema).parquet(target).where(F.col("bucket").isin(hit) & (F.col("batch") != batch_id))
            fresh = fresh.join(known.select(*keys), keys, "left_anti")
        fresh.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(target)

    return run
