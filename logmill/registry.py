"""Queries of the log operators and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.operators import scan
from logmill.plans import fold_queries, store_queries  # noqa: F401 - they register their queries
from logmill.plans.log_queries import ORACLES, QUERIES
from logmill.sources.logview import events_log

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one partition from an offset on, below the high watermark, decoded."""
    log = events_log(spark, sf_dir).where("topic = 'purchase' and partition = 1")
    marks = scan.log_ends(log).select("topic", "partition", (F.col("log_end_offset") - 1).alias("high_watermark"), F.lit(True).alias("has_progress"))
    rows = scan.visible(log.where("offset >= 10"), marks)
    return rows.select("topic", "partition", "offset", "timestamp_ms", F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"))
