"""Summaries and benchmark figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.sources.logview import dense_rank_in

BLOCKS = 64


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys..., share, value): the element at ``round((n-1) * share)`` of the sorted values; nulls don't count.

    Equal values are counted first, so what is ranked is one row a distinct value.  A key's values are cut into ``BLOCKS`` blocks at
    approximate quantiles, whatever their scale; how good these are bears on the size of the blocks, not on the result.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    # total and cuts are a row a key
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.percentile_approx("value", [k / BLOCKS for k in range(1, BLOCKS)], 20 * BLOCKS).alias("cuts"))
    block = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    ranked = dense_rank_in(counts.join(totals.select(*keys, "cuts"), [*keys]), keys, "value", "before", F.col("n"), block)
    totals = totals.drop("cuts")
    wanted = totals.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", F.round((F.col("total") - 1) * F.col("share")).cast("bigint"))
    hit = ranked.join(wanted, [*keys]).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
    return hit.select(*keys, "share", "value")


def throughput(df: DataFrame, keys: Sequence[str], time_ms: str) -> DataFrame:
    """Records and records a second of each key, over at least a millisecond."""
    elapsed = F.greatest((F.max(time_ms) - F.min(time_ms)) / 1000.0, F.lit(0.001))
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.round(F.count("*") / elapsed, 6).alias("per_second"))


def round_robin(df: DataFrame, index: Column, partitions: int) -> DataFrame:
    return df.groupBy(F.pmod(index, F.lit(partitions)).cast("bigint").alias("partition")).agg(F.count("*").alias("records"))


def total_of_nodes(df: DataFrame, scenario: str, metrics: Sequence[str]) -> DataFrame:
    """Each scenario's metrics summed over the nodes that report them."""
    return df.groupBy(scenario).agg(*[F.sum(m).alias(m) for m in metrics])


def efficiency(stored: Column, records: Column, payload: Column) -> tuple[Column, Column]:
    """Stored bytes a record and a byte of payload; nothing is divided by less than one."""
    one = F.lit(1)
    return stored / F.greatest(records, one), stored / F.greatest(payload, one)


def bench_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both figures of each scenario, and a note where one report lacks it."""
    j = before.withColumnRenamed("figure", "before").join(after.withColumnRenamed("figure", "after"), "scenario", "full")
    return j.select("scenario", "before", "after", F.when(F.col("before").isNull() | F.col("after").isNull(), "missing in one report").otherwise("").alias("note"))


def storage_summary(files: DataFrame) -> DataFrame:
    """Bytes by kind of a segment directory's files (path, length), e.g. of ``spark.read.format("binaryFile")`` without the content;
    the total has files of any kind."""
    kind = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1)
    of = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("length"))), F.lit(0)).alias(f"{k}_bytes")
    return files.agg(of("log"), of("index"), of("timeindex"), of("journal"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
