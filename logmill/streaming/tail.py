"""Tailing a table of events: a file stream read to its end, offsets assigned to each micro-batch as it is appended."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.operators.append import append_behind
from logmill.operators.scan import PARTITION, log_ends


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the cluster shares; where it is unset, a local session, as in tests, gets one of
    its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="logmill-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def append_stream(stream: DataFrame, order: str, table: str, checkpoint: str) -> None:
    """Appends what ``stream`` (topic, partition, ...) brings to the log at ``table`` until nothing is left, each micro-batch
    behind what is there, by ``order``.

    A micro-batch has a folder of its own, overwritten if it is run again, and behind it the ends of all partitions in a folder beside
    the table: the next one reads these few rows and none of the log.  A restart from the checkpoint neither loses nor
    repeats records.
    """
    spark, ends = stream.sparkSession, f"{table.rstrip('/')}.ends"

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        earlier = [k for k in _numbers(s, ends) if k < number]
        known = s.read.parquet(f"{ends}/batch={max(earlier)}") if earlier else s.createDataFrame([], "topic string, partition int, log_end_offset bigint")
        place = f"{table}/batch={number}"
        append_behind(known, batch, order).write.mode("overwrite").parquet(place)
        written = s.read.schema(f"topic string, partition {dict(batch.dtypes)['partition']}, offset bigint").parquet(place)
        both = known.unionByName(log_ends(written))
        both.groupBy(*PARTITION).agg(F.max("log_end_offset").alias("log_end_offset")).coalesce(1).write.mode("overwrite").parquet(f"{ends}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if spark and query.exception():
        raise query.exception()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The micro-batches of which ``path`` has whole folders."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return [int(n.partition("=")[2]) for n in names if n.startswith("batch=") and files.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]


def tail_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The log of ``events`` as a stream appends it."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path if os.path.isdir(path) else sf_dir
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob == sf_dir:
        events = events.option("pathGlobFilter", "events.parquet")
    rows = events.parquet(glob).select(F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("arrival"), "props")
    place = work_dir(spark)
    append_stream(rows, "arrival", f"{place}/log", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/log").select(*PARTITION, "offset", "arrival", "props")
