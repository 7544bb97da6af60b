"""Any table as a partitioned log with dense offsets.

Numbering the rows of a topic-partition by one window would sort all of it in one task.  ``dense_rank_in`` cuts the order
column into blocks of fixed width instead: rows are numbered within a block, and the number of rows in the blocks
before it - an aggregate with one row a block - is added.  No task then holds more than a block of a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20
BATCH = 16


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _block_of(order: str, block: int | Column) -> Column:
    number = block if isinstance(block, Column) else F.floor(F.col(order) / F.lit(block))
    return F.coalesce(number.cast("bigint"), F.lit(-(1 << 62)))


def _join_blocks(df: DataFrame, blocks: DataFrame, keys: Sequence[str], at: str, theirs: Sequence[str]) -> DataFrame:
    """``df`` with the row of ``blocks``, whose keys and block have the names ``theirs``."""
    match = F.col(at) == F.col(theirs[-1])
    for k, name in zip(keys, theirs):
        match &= F.col(k).eqNullSafe(F.col(name))
    return df.join(blocks, match, "left")


def dense_rank_in(df: DataFrame, keys: Sequence[str], order: str, name: str, weight: Column | None = None, block: int | Column = BLOCK) -> DataFrame:
    """``df`` with a column ``name``: how many rows (or how much ``weight``) of the same ``keys`` come before, by the
    column ``order``, which is unique within the keys (rows of equal order are numbered in any order).  A null order
    comes first.  ``block`` is the width of a block of an integer order, or an expression for its number that grows with it."""
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    at, load, size, base, *theirs = fresh(df, "block_no", "row_weight", "block_weight", "block_base", *[f"{k}_of_block" for k in keys], "of_block")
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    df = df.withColumn(at, _block_of(order, block)).withColumn(load, weight)
    sizes = df.groupBy(*keys, at).agg(F.sum(load).alias(size))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*[F.col(k).alias(t) for k, t in zip([*keys, at], theirs)], F.coalesce(F.sum(size).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*keys, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum(load).over(inside), F.lit(0)) + F.col(base)
    return _join_blocks(df, bases, keys, at, theirs).select(*columns, rank.cast("bigint").alias(name))


def lag_in(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, block: int | Column = BLOCK) -> DataFrame:
    """``df`` with a column ``name``: ``value`` of the row before, of the same ``keys``, by ``order``; null for the first.

    As in ``dense_rank_in`` no task sorts more than a block of a key: the first row of a block has the last value of the block
    before, of which there is a row a block."""
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    at, last, prior, *theirs = fresh(df, "block_no", "last_value", "block_prior", *[f"{k}_of_block" for k in keys], "of_block")
    df = df.withColumn(at, _block_of(order, block))
    # in a struct, so that a null value is told from no row
    held = F.struct(F.col(value).alias("v"))
    lasts = df.groupBy(*keys, at).agg(F.max_by(held, order).alias(last))
    lasts = lasts.select(*[F.col(k).alias(t) for k, t in zip([*keys, at], theirs)], F.lag(last).over(Window.partitionBy(*keys).orderBy(at)).alias(prior))
    inside = F.lag(held).over(Window.partitionBy(*keys, at).orderBy(order))
    return _join_blocks(df, lasts, keys, at, theirs).select(*columns, F.coalesce(inside, F.col(prior))["v"].alias(name))


def as_log(df: DataFrame, topic: Column, partition: Column, order: Column, timestamp_ms: Column, producer: Column, key: Column, value: Column, *extra: Column, sequences: bool = True) -> DataFrame:
    """``df`` as a log: offsets by ``order`` within (topic, partition) and, where asked for, sequences within a producer's rows
    there, which take a shuffle more.  ``order`` becomes ``arrival``."""
    rows = df.select(
        topic.cast("string").alias("topic"), partition.cast("int").alias("partition"), order.cast("bigint").alias("arrival"), timestamp_ms.cast("bigint").alias("timestamp_ms"),
        producer.cast("bigint").alias("producer_id"), F.lit(0).alias("producer_epoch"), key.cast("string").cast("binary").alias("key"), value.cast("string").cast("binary").alias("value"), *extra,
    )
    rows = dense_rank_in(rows, ("topic", "partition"), "arrival", "offset")
    return dense_rank_in(rows, ("topic", "partition", "producer_id"), "arrival", "sequence") if sequences else rows


def events_log(spark: SparkSession, sf_dir: str, sequences: bool = False) -> DataFrame:
    """The log view of ``events``: topic is the type, partition the user modulo 3; every 50th event is a tombstone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 50 != 0, F.col("props"))
    return as_log(
        e, F.col("event_type"), F.col("user_id") % 3, F.col("event_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000),
        F.col("user_id"), F.col("user_id"), value, F.col("value").alias("metric"), sequences=sequences,
    )


def orders_log(spark: SparkSession, sf_dir: str, sequences: bool = False) -> DataFrame:
    """The log view of ``orders``: topic is the status, partition the customer modulo 3, arrival the order key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return as_log(
        o, F.col("o_orderstatus"), F.col("o_custkey") % 3, F.col("o_orderkey"), F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000),
        F.col("o_custkey"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_totalprice").alias("metric"), sequences=sequences,
    )


#: The same views in SQL, as the head of a WITH clause.
EVENTS_SQL = """
WITH L AS (
  SELECT event_type AS topic, CAST(user_id % 3 AS INTEGER) AS partition, event_id AS arrival,
         row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1 AS "offset",
         epoch_us(ts) // 1000 AS timestamp_ms, user_id AS producer_id, 0 AS producer_epoch,
         row_number() OVER (PARTITION BY event_type, user_id % 3, user_id ORDER BY event_id) - 1 AS sequence,
         CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 50 <> 0 THEN props END AS value, value AS metric
  FROM events)
"""
ORDERS_SQL = """
WITH L AS (
  SELECT o_orderstatus AS topic, CAST(o_custkey % 3 AS INTEGER) AS partition, o_orderkey AS arrival,
         row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 3 ORDER BY o_orderkey) - 1 AS "offset",
         epoch_us(o_orderdate) // 1000 AS timestamp_ms, o_custkey AS producer_id,
         CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value, o_totalprice AS metric
  FROM orders)
"""
