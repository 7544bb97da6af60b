"""Appends: offset assignment, producer validation, replica writes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill import schema
from logmill.operators.scan import PARTITION, log_ends
from logmill.sources.logview import dense_rank_in, fresh


def append_offsets(log: DataFrame, arrivals: DataFrame, order: str = "arrival") -> DataFrame:
    """``arrivals`` with their offsets: the end of the log, and one more for each by ``order``.  A partition that the log lacks
    begins at 0."""
    return append_behind(log_ends(log), arrivals, order)


def append_behind(ends: DataFrame, arrivals: DataFrame, order: str = "arrival") -> DataFrame:
    """``append_offsets`` to a log of which the ends (topic, partition, log_end_offset) are known."""
    rank, end = fresh(arrivals, "rank", "log_end_offset")
    ends = ends.select(*PARTITION, F.col("log_end_offset").alias(end))
    ranked = dense_rank_in(arrivals, PARTITION, order, rank)
    return ranked.join(ends, [*PARTITION], "left").withColumn("offset", F.coalesce(end, F.lit(0)) + F.col(rank)).drop(rank, end)


def producer_state(log: DataFrame) -> DataFrame:
    """The last record of each producer in each partition; producers below 0 aren't tracked."""
    last = F.max_by(F.struct("producer_epoch", "sequence", "offset"), "offset").alias("last")
    return log.where("producer_id >= 0").groupBy(*PARTITION, "producer_id").agg(last).select(*PARTITION, "producer_id", "last.producer_epoch", F.col("last.sequence").alias("last_sequence"), F.col("last.offset").alias("last_offset"))


def producer_ids(requests: DataFrame, order: str = "arrival") -> DataFrame:
    """Ids from 1 for the names in ``client``, by first request."""
    first = requests.groupBy("client").agg(F.min(order).alias("first_seen"))
    ranked = dense_rank_in(first.withColumn("all", F.lit(0)), ("all",), "first_seen", "before")
    return ranked.select("client", (F.col("before") + 1).alias("producer_id"), F.lit(0).cast("bigint").alias("producer_epoch"))


def drop_retries(batches: DataFrame, order: str = "arrival") -> DataFrame:
    """Rows that don't repeat the last one of their producer in the partition: only that one is remembered."""
    by = Window.partitionBy(*PARTITION, "producer_id").orderBy(order)
    again = (F.col("producer_id") >= 0) & F.col("producer_epoch").eqNullSafe(F.lag("producer_epoch").over(by)) & F.col("sequence").eqNullSafe(F.lag("sequence").over(by))
    (mark,) = fresh(batches, "again")
    return batches.withColumn(mark, F.coalesce(again, F.lit(False))).where(~F.col(mark)).drop(mark)


@dataclass
class ProducerSession:
    """What is remembered of one producer in one partition: its last accepted batch."""

    epoch: int = -1
    first: int = -1
    last: int = -1
    batch: int = -1

    def offer(self, producer_id: int, next_producer_id: int, epoch: int, first: int, last: int, batch: int) -> tuple[int, int | None]:
        """(error code, the batch that it repeats or None); an accepted batch becomes the last one.

        A producer id that was never handed out is unknown.  An epoch below the known one is fenced.  In the known epoch the batch
        must repeat the last one or follow it; a higher epoch, or a producer's first batch, may begin anywhere.
        """
        if producer_id < 0:
            return schema.OK, None
        if producer_id >= next_producer_id:
            return schema.UNKNOWN_PRODUCER, None
        if self.batch >= 0:
            if epoch < self.epoch:
                return schema.STALE_EPOCH, None
            if epoch == self.epoch:
                if (first, last) == (self.first, self.last):
                    return schema.OK, self.batch
                if first != self.last + 1:
                    return schema.OUT_OF_ORDER, None
        self.epoch, self.first, self.last, self.batch = epoch, first, last, batch
        return schema.OK, None


_SESSION = ["producer_epoch", "first_sequence", "last_sequence", "batch"]


def fold_sessions(frames: Iterable[pd.DataFrame], next_producer_id: int) -> Iterator[pd.DataFrame]:
    """Adds error_code and repeated to batches that come sorted by producer and arrival; a producer may span frames.

    While each batch of a producer follows or repeats the one before it, whole columns are compared; only from the first that does
    neither on are its batches offered one by one.
    """
    key, before, session = None, None, None  # of the last row: its producer, its numbers, and the session where it has left them
    for frame in frames:
        n = len(frame)
        if not n:
            continue
        keys = frame[["topic", "partition", "producer_id"]]
        numbers = frame[_SESSION].to_numpy()
        epoch, first, last, _ = numbers.T
        new = (keys != keys.shift()).any(axis=1).to_numpy()
        new[0] = tuple(keys.iloc[0]) != key
        held = np.empty_like(numbers)
        held[1:] = numbers[:-1]
        held[0] = numbers[0] if before is None else before
        known = ~new & (epoch == held[:, 0])
        again = known & (first == held[:, 1]) & (last == held[:, 2])
        breaks = ~new & ~again & ~(known & (first == held[:, 2] + 1))
        error, producers = np.zeros(n, np.int64), keys["producer_id"].to_numpy()
        error[producers >= next_producer_id] = schema.UNKNOWN_PRODUCER
        again[producers >= next_producer_id] = False
        starts = np.flatnonzero(new | (np.arange(n) == 0))
        ends = np.append(starts[1:], n)
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(breaks), "right") - 1)
        if not new[0] and session is not None and (not len(odd) or odd[0]):
            odd = np.concatenate(([0], odd))
        kept = None
        for s in odd.tolist():
            a, b = int(starts[s]), int(ends[s])
            if a or new[0] or session is None:
                a += int(np.argmax(breaks[a:b]))
                kept = ProducerSession(*held[a])
            else:
                kept = session
            for i in range(a, b):
                code, repeats = kept.offer(producers[i], next_producer_id, *numbers[i])
                error[i], again[i] = code, repeats is not None
            if b < n:
                kept = None
        key, before, session = tuple(keys.iloc[-1]), numbers[-1], kept
        yield frame.assign(error_code=error, repeated=again)


def produce_outcomes(batches: DataFrame, next_producer_id: int, leaders: DataFrame | None = None, broker: int = 1) -> DataFrame:
    """(topic, partition, batch, producer_id, error_code, base_offset, last_offset) of produce batches
    (topic, partition, batch, producer_id, producer_epoch, first_sequence, last_sequence, records), taken in the order of ``batch``.

    A batch's fate hangs on earlier ones of the same producer only, so the fold runs per producer, not per partition; offsets
    are then the running sum of the accepted batches' records.  A repeated batch has the offsets of the one that it
    repeats, which is the producer's last accepted one.  Empty batches are ignored; null producer ids count as -1.
    With ``leaders`` (topic, partition, leader_id): error 3 for a partition without a row, 6 for another leader.
    """
    columns = [*PARTITION, "batch", "producer_id", "producer_epoch", "first_sequence", "last_sequence", "records"]
    batches = batches.where("records > 0").withColumn("producer_id", F.coalesce("producer_id", F.lit(-1)))
    kinds = "topic string, partition int, batch bigint, producer_id bigint, producer_epoch int, first_sequence bigint, last_sequence bigint, records bigint"
    batches = batches.select([F.col(k.split()[0]).cast(k.split()[1]) for k in kinds.split(", ")] + [c for c in batches.columns if c not in columns])
    if leaders is not None:
        at_leader = batches.join(leaders, [*PARTITION], "left")
        routed = F.when(F.col("leader_id").isNull(), schema.UNKNOWN_PARTITION).when(F.col("leader_id") != broker, schema.NOT_LEADER).otherwise(schema.OK)
        batches = at_leader.withColumn("routed", routed)
    else:
        batches = batches.withColumn("routed", F.lit(schema.OK))
    batches = batches.select(*columns, "routed")
    here = batches.where(F.col("routed") == schema.OK).drop("routed")
    tracked = here.where("producer_id >= 0").repartition(*PARTITION, "producer_id").sortWithinPartitions(*PARTITION, "producer_id", "batch")
    judged = tracked.mapInPandas(lambda frames: fold_sessions(frames, next_producer_id), f"{kinds}, error_code int, repeated boolean")
    free = here.where("producer_id < 0").withColumn("error_code", F.lit(schema.OK)).withColumn("repeated", F.lit(False))
    judged = judged.unionByName(free).withColumn("accepted", (F.col("error_code") == schema.OK) & ~F.col("repeated"))
    placed = dense_rank_in(judged, PARTITION, "batch", "base", F.when(F.col("accepted"), F.col("records")).otherwise(0))
    own = F.when(F.col("accepted"), F.struct(F.col("base").alias("base_offset"), (F.col("base") + F.col("records") - 1).alias("last_offset")))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy(*PARTITION, "producer_id").orderBy("batch"))
    none = F.lit(-1).cast("bigint")
    fine = F.col("error_code") == schema.OK
    placed = placed.withColumn("at", F.when(F.col("producer_id") < 0, own).otherwise(last))
    out = placed.select(*PARTITION, "batch", "producer_id", "error_code", F.when(fine, F.col("at.base_offset")).otherwise(none).alias("base_offset"), F.when(fine, F.col("at.last_offset")).otherwise(none).alias("last_offset"))
    astray = batches.where(F.col("routed") != schema.OK).select(*PARTITION, "batch", "producer_id", F.col("routed").alias("error_code"), none.alias("base_offset"), none.alias("last_offset"))
    return out.unionByName(astray)


def replica_append(ends: DataFrame, rows: DataFrame) -> DataFrame:
    """What becomes of rows that a follower is sent: (topic, partition, appended, first_offset, log_end_offset, error).

    Rows below the end are skipped.  The rest must begin at the end and have no gap, else nothing is appended.
    """
    fresh = rows.join(ends, [*PARTITION]).where("offset >= log_end_offset")
    sums = fresh.groupBy(*PARTITION).agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.countDistinct("offset").alias("distinct"))
    joined = ends.join(sums, [*PARTITION], "left")
    gap = F.col("first_offset") != F.col("log_end_offset")
    hole = (F.col("last_offset") - F.col("first_offset") + 1 != F.col("n")) | (F.col("distinct") != F.col("n"))
    error = F.when(F.col("n").isNull(), "").when(gap, "expected offset").when(hole, "not contiguous").otherwise("")
    fine = (error == "") & F.col("n").isNotNull()
    return joined.select(
        *PARTITION, F.when(fine, F.col("n")).otherwise(0).cast("bigint").alias("appended"), F.coalesce("first_offset", F.lit(-1)).alias("first_offset"),
        F.when(fine, F.col("last_offset") + 1).otherwise(F.col("log_end_offset")).alias("log_end_offset"), error.alias("error"),
    )


def replica_apply(ends: DataFrame, rows: DataFrame, leader_marks: DataFrame) -> DataFrame:
    """Strict form: no row may lie below the end.  (topic, partition, log_end_offset, high_watermark, mismatch); the watermark is
    the lesser of the leader's and the new end."""
    sums = rows.groupBy(*PARTITION).agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    j = ends.join(sums, [*PARTITION], "left").join(leader_marks, [*PARTITION])
    bad = F.col("n").isNotNull() & ((F.col("first") != F.col("log_end_offset")) | (F.col("last") - F.col("first") + 1 != F.col("n")))
    end = F.when(F.col("n").isNull() | bad, F.col("log_end_offset")).otherwise(F.col("last") + 1)
    return j.select(*PARTITION, end.alias("log_end_offset"), F.least(F.col("leader_high_watermark"), end).alias("high_watermark"), bad.alias("mismatch"))
