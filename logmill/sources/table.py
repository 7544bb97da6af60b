"""A stored log: Parquet by topic and partition, sorted by offset within its files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = ("topic", "partition")


def write_log(log: DataFrame, path: str, mode: str = "append", files_per_partition: int = 1) -> None:
    """Rows of a partition go to ``files_per_partition`` files by ranges of offsets, each sorted; so a range of offsets is
    a few row groups of a few files."""
    if files_per_partition > 1:
        laid = log.repartitionByRange(files_per_partition * max(1, log.select(*PARTITION).distinct().count()), *PARTITION, "offset")
    else:
        laid = log.repartition(*PARTITION)
    laid.sortWithinPartitions(*PARTITION, "offset").write.mode(mode).partitionBy(*PARTITION).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def truncate_stored(spark: SparkSession, path: str, topic: str, partition: int, next_offset: int) -> None:
    """Cuts one partition to the offsets below ``next_offset``; no other folder is touched.  One of which nothing is left loses its
    folder."""
    path = path.rstrip("/")
    kept = read_log(spark, path).where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") < next_offset))
    # written beside and read back, as a table can't be overwritten while it is read
    beside = f"{path}.truncating-{uuid.uuid4().hex}"
    try:
        kept.write.mode("overwrite").parquet(beside)
        stays = spark.read.schema(kept.schema).parquet(beside)
        if stays.isEmpty():
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(topic)
            _delete(spark, f"{path}/topic={name}/partition={partition}")
        else:
            stays.sortWithinPartitions("offset").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    finally:
        _delete(spark, beside)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON, CSV or a Markdown table, a row a scenario."""
    if kind not in ("json", "csv", "md"):
        raise ValueError(f"no such report: {kind}")
    if kind == "md":
        cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("value")
        head = rows.sparkSession.createDataFrame([("| " + " | ".join(rows.columns) + " |",), ("|" + "---|" * len(rows.columns),)], "value string")
        head.coalesce(1).union(rows.select(line)).coalesce(1).write.mode("overwrite").text(path)
        return
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
