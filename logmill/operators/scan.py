"""Reads of a log: ranges, batches, lookups, visibility.  All are plain expressions; filters on topic, partition and offset
reach the scan of a stored log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.sources.logview import BATCH, fresh, lag_in

PARTITION = ("topic", "partition")


def fetch_range(log: DataFrame, topic: str, partition: int, start: int, limit: int) -> DataFrame:
    """The first ``limit`` records of a partition from ``start`` on, by offset; none for a limit of 0."""
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= start)).orderBy("offset").limit(max(0, limit))


def log_ends(log: DataFrame) -> DataFrame:
    """(topic, partition, log_end_offset): the offset that the next record gets."""
    return log.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("log_end_offset"))


def fetch_with_high_watermark(log: DataFrame, topic: str, partition: int, start: int, limit: int) -> DataFrame:
    ends = log_ends(log.where((F.col("topic") == topic) & (F.col("partition") == partition))).withColumnRenamed("log_end_offset", "high_watermark")
    return fetch_range(log, topic, partition, start, limit).join(ends, [*PARTITION])


def fetch_multi(log: DataFrame, requests: DataFrame, limit: int = 1000) -> DataFrame:
    """For each request (topic, partition, fetch_offset) the first ``limit`` records from fetch_offset on; past the end: none."""
    hits = log.join(requests, [*PARTITION]).where("offset >= fetch_offset")
    (rank,) = fresh(hits, "rank")
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*PARTITION, "fetch_offset").orderBy("offset"))).where(F.col(rank) <= limit).drop(rank)


def with_batches(log: DataFrame, size: int = BATCH) -> DataFrame:
    return log.withColumn("batch_id", F.floor(F.col("offset") / size).cast("bigint"))


def batch_headers(log: DataFrame, *aggregates: Column) -> DataFrame:
    """(topic, partition, batch_id, base_offset, last_offset, max_timestamp_ms, records) of a log with batch_id."""
    return log.groupBy(*PARTITION, "batch_id").agg(
        F.min("offset").alias("base_offset"), F.max("offset").alias("last_offset"), F.max("timestamp_ms").alias("max_timestamp_ms"), F.count("*").alias("records"), *aggregates
    )


def fetch_batch_aligned(log: DataFrame, start: int, limit: int, size: int = BATCH) -> DataFrame:
    """Whole batches of each partition, from the first that reaches ``start`` to the one in which ``limit`` records from
    ``start`` on are reached; so records before ``start`` may be among them."""
    reached = with_batches(log.where(F.col("offset") >= start // size * size), size)
    batches = batch_headers(reached, F.sum((F.col("offset") >= start).cast("bigint")).alias("visible")).where(F.col("last_offset") >= start)
    before = F.sum("visible").over(Window.partitionBy(*PARTITION).orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    kept = batches.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit).select(*PARTITION, "batch_id")
    return reached.join(kept, [*PARTITION, "batch_id"], "left_semi")


def list_offsets(log: DataFrame) -> DataFrame:
    """Earliest and latest offset of each partition, with the earliest's timestamp; the latest's timestamp is 0."""
    return log.groupBy(*PARTITION).agg(
        F.min("offset").alias("earliest_offset"), F.min_by("timestamp_ms", "offset").alias("earliest_timestamp_ms"),
        (F.max("offset") + 1).alias("latest_offset"), F.lit(0).cast("bigint").alias("latest_timestamp_ms"),
    )


def list_offsets_spec(log: DataFrame, specs: DataFrame) -> DataFrame:
    """The offset that each timestamp spec asks for: -1 the latest, anything else the earliest."""
    offsets = list_offsets(log)
    latest = F.col("spec") == -1
    return offsets.crossJoin(F.broadcast(specs)).select(
        *PARTITION, "spec", F.when(latest, F.col("latest_offset")).otherwise(F.col("earliest_offset")).alias("found_offset"),
        F.when(latest, F.col("latest_timestamp_ms")).otherwise(F.col("earliest_timestamp_ms")).alias("found_timestamp_ms"),
    )


def sparse_index(headers: DataFrame, stride: int = 16) -> DataFrame:
    """The batches that an append indexes: base offset 0 or a multiple of the stride."""
    return headers.where(F.col("base_offset") % stride == 0)


def index_lookup(index: DataFrame, start: int) -> DataFrame:
    """The last indexed batch at or before ``start``, of each partition."""
    return index.where(F.col("base_offset") <= start).groupBy(*PARTITION).agg(F.max("base_offset").alias("base_offset"), F.max_by("position", "base_offset").alias("position"))


#: Bytes of a batch without its records, and of a record without key, value and headers.
BATCH_BYTES, RECORD_BYTES = 4 + 8 + 8 + 8 + 4, 8 + 8 + 8 + 2 + 4 + 4 + 4 + 4


def rebuild_index(log: DataFrame) -> DataFrame:
    """An index entry for each batch with its byte position in the segment: the sizes, each with 4 bytes of length, of the
    batches before it.  Keys, values and headers are stored behind their length; a null takes no bytes."""
    size = RECORD_BYTES + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + F.lit(2)
    headers = batch_headers(log, (F.sum(size) + BATCH_BYTES).alias("bytes"))
    before = Window.partitionBy(*PARTITION).orderBy("base_offset").rowsBetween(Window.unboundedPreceding, -1)
    return headers.withColumn("position", F.coalesce(F.sum(F.col("bytes") + 4).over(before), F.lit(0)).cast("bigint"))


def visible(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Records below the high watermark of ``marks`` (topic, partition, high_watermark, has_progress); all of a partition whose
    watermark is 0 while no replica has reported."""
    open_ = (F.col("high_watermark") == 0) & ~F.col("has_progress")
    return log.join(marks, [*PARTITION]).where(open_ | (F.col("offset") < F.col("high_watermark")))


def led_here(log: DataFrame, leaders: DataFrame, broker: int, voters: int) -> DataFrame:
    """Records of the partitions that ``broker`` leads by ``leaders`` (topic, partition, leader_id); an unknown partition is led
    here only where there are no voters."""
    return log.join(leaders, [*PARTITION], "left").where(F.coalesce(F.col("leader_id") == broker, F.lit(voters == 0)))


def topic_metadata(log: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    """The known topics, or those of ``topics`` that are known, with their partitions."""
    found = log.select(*PARTITION).distinct()
    return found if topics is None else found.where(F.col("topic").isin(list(topics)))


def metadata_lookup(requested: DataFrame, catalog: DataFrame, create_partitions: int | None = None) -> DataFrame:
    """Each requested topic with its number of partitions; error 3 and none where it is unknown.  With ``create_partitions``, for a
    request that allows it at a broker that may (``cluster.may_auto_create``), unknown topics are made with so many."""
    if create_partitions is not None:
        catalog = with_topics(catalog, requested.select("topic"), create_partitions)
    known = catalog.groupBy("topic").agg(F.count("*").alias("partitions"))
    return requested.join(known, "topic", "left").select("topic", F.when(F.col("partitions").isNull(), 3).otherwise(0).cast("bigint").alias("error_code"), F.coalesce("partitions", F.lit(0)).alias("partitions"))


def with_topics(catalog: DataFrame, topics: DataFrame, partitions: int) -> DataFrame:
    """The catalog (topic, partition) and, of each of ``topics`` (topic) that it lacks, partitions 0 up to ``partitions``."""
    new = topics.where("topic is not null").distinct().join(catalog.select("topic"), "topic", "left_anti")
    made = new.select("topic", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition")) if partitions > 0 else new.withColumn("partition", F.lit(0)).limit(0)
    return catalog.select(*PARTITION).distinct().unionByName(made)


def auto_created(catalog: DataFrame, requests: DataFrame, partitions: int) -> DataFrame:
    """The catalog after produce requests (topic, partition): an unknown topic is made, with ``partitions`` partitions, if some
    request asks for one of these; a partition that a known topic lacks isn't added."""
    asked = requests.where((F.col("partition") >= 0) & (F.col("partition") < partitions))
    return with_topics(catalog, asked.select("topic"), partitions)


def encode_records(rows: DataFrame) -> DataFrame:
    """Fetched records as a consumer gets them: without producer, and no offset below the record's place in the answer.  ``rows`` are
    one fetch of each partition, so the window is as small as its limit."""
    place = F.row_number().over(Window.partitionBy(*PARTITION).orderBy("offset")) - 1
    return rows.select(*PARTITION, F.greatest("offset", place.cast("bigint")).alias("offset"), "timestamp_ms", F.lit(-1).alias("producer_id"), F.lit(-1).alias("producer_epoch"), "key", "value")


def topic_summary(log: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return log_ends(log).select(*PARTITION, F.col("log_end_offset").alias("next_offset"), zero.alias("log_start_offset"), zero.alias("active_segment_base_offset"))


def tail(log: DataFrame, count: int) -> DataFrame:
    """The last ``count`` records of each partition: a range, since offsets are dense and the end is an aggregate."""
    return log.join(log_ends(log), [*PARTITION]).where(F.col("offset") >= F.col("log_end_offset") - count)


def last_k(log: DataFrame, k: int) -> DataFrame:
    """The last ``k`` records of each partition of a log that may have gaps."""
    (rank,) = fresh(log, "rank")
    by = Window.partitionBy(*PARTITION).orderBy(F.col("offset").desc())
    return log.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k).drop(rank)


def tombstones(log: DataFrame) -> DataFrame:
    """Null values and null keys of each partition; null is not empty."""
    n = lambda c: F.sum(c.cast("bigint"))
    return log.groupBy(*PARTITION).agg(n(F.col("value").isNull()).alias("null_values"), n(F.col("key").isNull()).alias("null_keys"), F.count("*").alias("records"))


def offset_gaps(log: DataFrame) -> DataFrame:
    """Records whose offset doesn't follow the one before; compared block by block, so no task sorts a whole partition."""
    return lag_in(log, PARTITION, "offset", "offset", "previous_offset").where(F.col("offset") != F.col("previous_offset") + 1)


def sequence_gaps(log: DataFrame, order: str = "arrival") -> DataFrame:
    """Records whose sequence doesn't follow the one before of the same producer in the partition."""
    before = F.lag("sequence").over(Window.partitionBy(*PARTITION, "producer_id").orderBy(order))
    return log.withColumn("previous_sequence", before).where(F.col("sequence") != F.col("previous_sequence") + 1)


def valid_prefix(rows: DataFrame, bad: Column) -> DataFrame:
    """The rows of each partition before its first bad one: the least bad offset is an aggregate, not a window."""
    (bound,) = fresh(rows, "first_bad")
    first = rows.where(bad).groupBy(*PARTITION).agg(F.min("offset").alias(bound))
    return rows.join(first, [*PARTITION], "left").where(F.col(bound).isNull() | (F.col("offset") < F.col(bound))).drop(bound)


def truncate(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """The log below ``next_offset`` of its partition in ``bounds``; partitions without a bound stay whole."""
    (bound,) = fresh(log, "next_offset")
    bounds = bounds.select(*PARTITION, F.col("next_offset").alias(bound))
    return log.join(bounds, [*PARTITION], "left").where(F.col(bound).isNull() | (F.col("offset") < F.col(bound))).drop(bound)
