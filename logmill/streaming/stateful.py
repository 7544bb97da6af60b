"""The folds of producers and consumer groups as stateful streams.

State is kept per producer and partition, or per group; within a micro-batch a key's events are taken in the order of their
number.  Events that arrive in a later micro-batch than greater numbers are taken as they come.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logmill.operators import groups
from logmill.operators.append import ProducerSession
from logmill.operators.scan import PARTITION

PRODUCED = "topic string, partition int, batch bigint, producer_id bigint, records bigint, error_code int, repeats bigint"


class Producers(StatefulProcessor):
    def __init__(self, next_producer_id: int) -> None:
        self.next_producer_id = next_producer_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch int, first bigint, last bigint, batch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("batch")
        session = ProducerSession(*map(int, self.last.get())) if self.last.exists() else ProducerSession()
        offers = frame[["producer_id", "producer_epoch", "first_sequence", "last_sequence", "batch"]].itertuples(index=False, name=None)
        said = [session.offer(p, self.next_producer_id, e, f, n, b) for p, e, f, n, b in offers]
        if session.batch >= 0:
            self.last.update((session.epoch, session.first, session.last, session.batch))
        yield frame.assign(error_code=[c for c, _ in said], repeats=pd.array([r for _, r in said], dtype="Int64"))[[c.split()[0] for c in PRODUCED.split(", ")]]

    def close(self) -> None:
        pass


def produce_stream(batches: DataFrame, next_producer_id: int) -> DataFrame:
    """The outcome of each produce batch of a stream (the columns that ``append.produce_outcomes`` takes): its error code and
    the batch that it repeats.  The accepted ones get their offsets where they are appended."""
    batches = batches.where("records > 0").withColumn("producer_id", F.coalesce("producer_id", F.lit(-1)))
    # batches without a producer need no state; under one key they would be a hot one
    free = batches.where("producer_id < 0").select(*PARTITION, "batch", "producer_id", "records", F.lit(0).cast("int").alias("error_code"), F.lit(None).cast("bigint").alias("repeats"))
    batches = batches.where("producer_id >= 0")
    judged = batches.groupBy(*PARTITION, "producer_id").transformWithStateInPandas(statefulProcessor=Producers(next_producer_id), outputStructType=PRODUCED, outputMode="Append", timeMode="None")
    return judged.unionByName(free)


class Groups(StatefulProcessor):
    def __init__(self, partitions: dict[str, list[int]]) -> None:
        self.partitions = partitions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", "pickled binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # our own bytes, from the checkpoint that only this query writes
        group = pickle.loads(self.state.get()[0]) if self.state.exists() else groups.Group()
        events = groups.event_rows(pd.concat(list(rows)))
        out = groups.fold(group, events, self.partitions)
        self.state.update((pickle.dumps(group),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in groups.OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def group_stream(events: DataFrame, partitions: dict[str, list[int]]) -> DataFrame:
    """The outcome of each group event of a stream; see ``groups.fold_groups``."""
    return events.groupBy("group_id").transformWithStateInPandas(statefulProcessor=Groups(partitions), outputStructType=groups.OUTCOME, outputMode="Append", timeMode="None")
