"""Replication and cluster metadata: watermarks, in-sync sets, elections, and the fold of the metadata log."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.operators.folds import fold_sorted
from logmill.operators.scan import PARTITION
from logmill.sources.logview import dense_rank_in, lag_in

TOLERANCE = 1  # records that an in-sync replica may lack


def latest_progress(progress: DataFrame, order: str | None = None) -> DataFrame:
    """(topic, partition, broker_id, log_end_offset): of a broker's repeated reports the last by ``order``; without one, the
    greatest end."""
    end = F.max("log_end_offset") if order is None else F.max_by("log_end_offset", order)
    return progress.groupBy(*PARTITION, "broker_id").agg(end.alias("log_end_offset"))


def high_watermark(isr: DataFrame, progress: DataFrame, previous: DataFrame, order: str | None = None) -> DataFrame:
    """The least end among the in-sync replicas (topic, partition, broker_id) that have reported; without one the
    ``previous`` watermark stays.  Repeated reports: see ``latest_progress``."""
    progress = latest_progress(progress, order)
    least = isr.join(progress, [*PARTITION, "broker_id"]).groupBy(*PARTITION).agg(F.min("log_end_offset").alias("least"))
    return previous.join(least, [*PARTITION], "left").select(*PARTITION, F.coalesce("least", "high_watermark").alias("high_watermark"))


def isr_reconcile(partitions: DataFrame, progress: DataFrame, tolerance: int = TOLERANCE, order: str | None = None) -> DataFrame:
    """(topic, partition, isr) of ``partitions`` (topic, partition, leader_id, replicas): the leader, and the replicas that lack
    at most ``tolerance`` of its records, in the order of ``replicas``.  While the leader hasn't reported, the leader alone.  Repeated
    reports: see ``latest_progress``."""
    ends = latest_progress(progress, order).groupBy(*PARTITION).agg(F.map_from_entries(F.collect_list(F.struct("broker_id", "log_end_offset"))).alias("ends"))
    j = partitions.join(ends, [*PARTITION], "left").withColumn("leader_end", F.try_element_at("ends", "leader_id"))
    near = F.filter("replicas", lambda r: (r == F.col("leader_id")) | (F.col("leader_end") - F.try_element_at(F.col("ends"), r) <= tolerance))
    return j.select(*PARTITION, F.when(F.col("leader_end").isNull(), F.array("leader_id")).otherwise(near).alias("isr"))


def caught_up(targets: DataFrame, progress: DataFrame, marks: DataFrame, order: str | None = None) -> DataFrame:
    """(topic, partition, caught_up): whether every target (topic, partition, broker_id) has reported an end at the watermark.
    Repeated reports: see ``latest_progress``."""
    j = targets.join(latest_progress(progress, order), [*PARTITION, "broker_id"], "left").join(marks, [*PARTITION])
    return j.groupBy(*PARTITION).agg(F.bool_and(F.coalesce(F.col("log_end_offset") >= F.col("high_watermark"), F.lit(False))).alias("caught_up"))


def replica_union(replicas: Column, targets: Column) -> Column:
    """Replicas and then the targets that aren't among them; both are free of repeats."""
    return F.array_union(replicas, targets)


def isr_shrink(isr: Column, targets: Column) -> Column:
    """The in-sync replicas that are targets, in their order."""
    return F.filter(isr, lambda r: F.array_contains(targets, r))


def partition_state(requested: DataFrame, partitions: DataFrame, progress: DataFrame) -> DataFrame:
    """Leader, epoch, watermark and the leader's end (0 before it reports) of each request; -1 where it is unknown."""
    ends = latest_progress(progress).select(*PARTITION, F.col("broker_id").alias("leader_id"), "log_end_offset")
    j = requested.join(partitions.join(ends, [*PARTITION, "leader_id"], "left").withColumn("found", F.lit(True)), [*PARTITION], "left")
    known = F.col("found").isNotNull()
    get = lambda c: F.when(known, F.col(c)).otherwise(-1).cast("bigint").alias(c)
    return j.select(*PARTITION, known.alias("found"), get("leader_id"), get("leader_epoch"), get("high_watermark"), F.when(known, F.coalesce("log_end_offset", F.lit(0))).otherwise(-1).alias("leader_log_end_offset"))


def merge_topic(image: DataFrame, store: DataFrame) -> DataFrame:
    """The image with the partitions that only the store has, of topics that the image knows: leader 0, no replicas."""
    missing = store.select(*PARTITION).distinct().join(image, [*PARTITION], "left_anti").join(image.select("topic").distinct(), "topic", "left_semi")
    return image.select(*PARTITION, "leader_id").unionByName(missing.withColumn("leader_id", F.lit(0).cast("bigint")))


def election(votes: DataFrame, voters: int) -> DataFrame:
    """(term, votes, elected): a candidate, with its own vote, needs more than half of the voters."""
    n = F.sum(F.col("granted").cast("bigint")) + 1
    return votes.groupBy("term").agg(n.alias("votes"), (n > voters // 2).alias("elected"))


def broker_liveness(registrations: DataFrame, beats: DataFrame, now_ms: Column, timeout_ms: int = 30_000) -> DataFrame:
    """Each broker's last registration, and whether a heartbeat of its epoch is recent enough."""
    last = registrations.groupBy("node_id").agg(F.max("broker_epoch").alias("broker_epoch"), F.max_by("timestamp_ms", "broker_epoch").alias("registered_ms"))
    seen = beats.join(last.select("node_id", "broker_epoch"), ["node_id", "broker_epoch"], "left_semi").groupBy("node_id").agg(F.max("timestamp_ms").alias("beat_ms"))
    heard = F.greatest("registered_ms", "beat_ms")
    return last.join(seen, "node_id", "left").select("node_id", "broker_epoch", heard.alias("last_heartbeat_ms"), (now_ms - heard <= timeout_ms).alias("alive"))


STEPS = ("Planned", "Copying", "ExpandingIsr", "LeaderSwitch", "Shrinking", "Complete")


@dataclass
class PartitionImage:
    """What the metadata log says of one partition."""

    leader_id: int = 0
    leader_epoch: int = 0
    high_watermark: int = 0
    replicas: list[int] = field(default_factory=list)
    isr: list[int] = field(default_factory=list)
    progress: dict[int, tuple[int, int]] = field(default_factory=dict)
    targets: list[int] | None = None
    step: str | None = None

    def _mark(self) -> None:
        ends = [self.progress[b][0] for b in self.isr if b in self.progress]
        self.high_watermark = min(ends, default=self.high_watermark)

    def _reached(self, brokers: Iterable[int]) -> bool:
        return all(b in self.progress and self.progress[b][0] >= self.high_watermark for b in brokers)

    def lead(self, leader: int, epoch: int) -> bool:
        if epoch < self.leader_epoch or (leader, epoch) == (self.leader_id, self.leader_epoch):
            return False
        self.leader_id, self.leader_epoch = leader, epoch
        for known in (self.replicas, self.isr):
            if leader not in known:
                known.insert(0, leader)
        return True

    def replicate(self, replicas: list[int], isr: list[int], epoch: int) -> bool:
        if epoch < self.leader_epoch or (replicas, isr, epoch) == (self.replicas, self.isr, self.leader_epoch):
            return False
        self.replicas, self.isr, self.leader_epoch = list(replicas), list(isr), epoch
        self._mark()
        return True

    def report(self, epoch: int, broker: int, end: int, caught_up_ms: int) -> bool:
        if epoch != self.leader_epoch or self.progress.get(broker) == (end, caught_up_ms):
            return False
        self.progress[broker] = (end, caught_up_ms)
        if self.leader_id in self.progress:
            goal = self.progress[self.leader_id][0]
            self.isr = [b for b in self.replicas if b == self.leader_id or b in self.progress and goal - self.progress[b][0] <= TOLERANCE]
        else:
            self.isr = [self.leader_id]
        self._mark()
        return True

    def begin(self, targets: list[int]) -> bool:
        if not targets or self.targets is not None:
            return False
        self.targets, self.step = list(targets), "Planned"
        return True

    def advance(self, step: str) -> bool:
        """Only the preconditions order the steps; taking the present one again is refused."""
        if self.targets is None or step == self.step:
            return False
        t = self.targets
        if step == "ExpandingIsr":
            if not self._reached(t):
                return False
            for known in (self.replicas, self.isr):
                for b in t:  # targets may repeat
                    if b not in known:
                        known.append(b)
        elif step == "LeaderSwitch":
            if t[0] not in self.isr or not self._reached(t[:1]):
                return False
            self.leader_id, self.leader_epoch = t[0], self.leader_epoch + 1
        elif step in ("Shrinking", "Complete"):
            if self.leader_id != t[0]:
                return False
            self.replicas, self.isr = list(t), [b for b in self.isr if b in t]
            if step == "Complete":
                self.targets = self.step = None
                return True
        self.step = step
        return True


@dataclass
class Image:
    """The cluster's metadata: a fold of the metadata log.  Every record advances ``offset``, also one without effect."""

    offset: int = -1
    controller_id: int = 0
    brokers: dict[int, tuple[str, int]] = field(default_factory=dict)
    partitions: dict[tuple[str, int], PartitionImage] = field(default_factory=dict)

    def apply(self, e: dict) -> bool:
        self.offset += 1
        kind, key = e["kind"], (e["topic_name"], e["partition_index"])
        if kind == "SetController":
            changed, self.controller_id = self.controller_id != e["controller_id"], e["controller_id"]
            return changed
        if kind == "RegisterBroker":
            new = (e["host"], e["port"])
            changed, self.brokers[e["broker_id"]] = self.brokers.get(e["broker_id"]) != new, new
            return changed
        if kind == "UpsertPartition":
            new = PartitionImage(e["leader_id"], e["leader_epoch"], 0, list(e["replicas"]), list(e["isr"]))
            changed, self.partitions[key] = self.partitions.get(key) != new, new
            return changed
        p = self.partitions.get(key)
        if p is None:
            return False
        if kind == "UpdatePartitionLeader":
            return p.lead(e["leader_id"], e["leader_epoch"])
        if kind == "UpdatePartitionReplication":
            return p.replicate(list(e["replicas"]), list(e["isr"]), e["leader_epoch"])
        if kind == "UpdateReplicaProgress":
            return p.report(e["leader_epoch"], e["broker_id"], e["log_end_offset"], e["last_caught_up_ms"])
        if kind == "BeginPartitionReassignment":
            return p.begin(list(e["target_replicas"]))
        if kind == "AdvancePartitionReassignment":
            return p.advance(e["step"])
        if kind == "CompletePartitionReassignment":
            return p.advance("Complete")
        raise ValueError(f"no such metadata record: {kind}")


FOLDED = (
    "seq bigint, metadata_offset bigint, kind string, topic_name string, partition_index int, changed boolean, leader_id bigint, leader_epoch bigint, "
    "high_watermark bigint, replicas string, isr string, step string"
)
_OF_PARTITION = ("UpsertPartition", "UpdatePartitionLeader", "UpdatePartitionReplication", "UpdateReplicaProgress", "BeginPartitionReassignment", "AdvancePartitionReassignment", "CompletePartitionReassignment")
_ABSENT = PartitionImage(-1, -1, -1)


def _clean(e: dict) -> dict:
    """0 for missing numbers, no members for missing lists."""
    for k in ("leader_id", "leader_epoch", "broker_id", "log_end_offset", "last_caught_up_ms", "controller_id", "port"):
        e[k] = e[k] or 0
    for k in ("replicas", "isr", "target_replicas"):
        e[k] = e[k] or []
    return e


def fold_metadata(events: DataFrame) -> DataFrame:
    """What each record of a metadata log does, in the order of ``seq``: ``metadata_offset`` counts all records from 0, those without
    effect too, and ``changed`` tells whether it had one.  Records of a partition show the partition behind them.

    A partition's records are folded by themselves, as no other record bears on them.  A controller or a broker record
    changes something where it differs from the one before it, of the same broker.
    """
    events = dense_rank_in(events, (), "seq", "metadata_offset")

    def step(image: Image, e: dict) -> dict:
        changed = image.apply(_clean(e))
        p = image.partitions.get((e["topic_name"], e["partition_index"]), _ABSENT)
        own = {c: e[c] for c in ("seq", "metadata_offset", "kind", "topic_name", "partition_index")}
        return own | {
            "changed": changed, "leader_id": p.leader_id, "leader_epoch": p.leader_epoch, "high_watermark": p.high_watermark,
            "replicas": ",".join(map(str, p.replicas)), "isr": ",".join(map(str, p.isr)), "step": p.step,
        }

    of_partition = F.col("kind").isin(*_OF_PARTITION)
    folded = fold_sorted(events.where(of_partition), ("topic_name", "partition_index"), "seq", Image, step, FOLDED)
    none = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in FOLDED.split(", ")[6:])]
    whole = ("seq", "metadata_offset", "kind", F.lit(None).cast("string").alias("topic_name"), F.lit(None).cast("int").alias("partition_index"))
    controllers = lag_in(events.where("kind = 'SetController'"), (), "seq", "controller_id", "before")
    controllers = controllers.select(*whole, (F.col("controller_id") != F.coalesce("before", F.lit(0))).alias("changed"), *none)
    by_broker = Window.partitionBy("broker_id").orderBy("seq")
    address = F.struct("host", "port")
    brokers = events.where("kind = 'RegisterBroker'").select(*whole, (~F.lag(address).over(by_broker).eqNullSafe(address)).alias("changed"), *none)
    return folded.unionByName(controllers).unionByName(brokers)


@dataclass
class Quorum:
    """Term, known leader and end of the metadata log at one voter."""

    voters: frozenset[int]
    term: int = 0
    leader: int | None = None
    voted_for: int | None = None
    offset: int = -1

    def append(self, term: int, leader: int, previous: int, records: int) -> bool:
        """Compare and append: refused from no voter, an older term, another leader of this term, or another end."""
        if leader not in self.voters or term < self.term or (term == self.term and self.leader not in (None, leader)):
            return False
        if term > self.term:
            self.term, self.voted_for = term, None
        self.leader = leader
        if previous != self.offset:
            return False
        self.offset += records
        return True

    def vote(self, term: int, candidate: int, offset: int) -> bool:
        """One vote a term, for a voter whose log is no shorter."""
        if candidate not in self.voters or term < self.term:
            return False
        if term > self.term:
            self.term, self.voted_for, self.leader = term, None, None
        if offset < self.offset or self.voted_for not in (None, candidate):
            return False
        self.voted_for = candidate
        return True


def may_write(voters: Iterable[int], me: int, leader: int | None, roles: Iterable[str]) -> bool:
    """Whether a broker may change the metadata: where there are no voters anyone may, else the controller that leads."""
    return not list(voters) or ("controller" in roles and leader == me)


def may_auto_create(voters: Iterable[int], me: int, leader: int | None, roles: Iterable[str]) -> bool:
    """Whether a broker may create the topics that it is asked for: as ``may_write``, but the controller among at most one voter
    needn't lead yet."""
    voters = list(voters)
    if "controller" not in roles:
        return not voters
    return len(voters) <= 1 or leader == me


def find_coordinator(keys: DataFrame, node_id: int, host: str, port: int) -> DataFrame:
    """A row for each of the ``keys`` asked for: there is one broker, and it coordinates every group."""
    return keys.select(F.explode("keys").alias("key")).select("key", F.lit(0).cast("bigint").alias("error_code"), F.lit(node_id).cast("bigint").alias("node_id"), F.lit(host).alias("host"), F.lit(port).cast("bigint").alias("port"))


def compare_and_append(requests: DataFrame, voters: Iterable[int]) -> DataFrame:
    """(log_id, seq, accepted, term, last_metadata_offset) of append requests (log_id, seq, term, leader_id, previous_offset,
    records), in the order of ``seq`` within each log."""
    voters = frozenset(voters)

    def step(q: Quorum, r: dict) -> dict:
        said = q.append(r["term"], r["leader_id"], r["previous_offset"], r["records"])
        return {"log_id": r["log_id"], "seq": r["seq"], "accepted": said, "term": q.term, "last_metadata_offset": q.offset}

    return fold_sorted(requests, ("log_id",), "seq", lambda: Quorum(voters), step, "log_id bigint, seq bigint, accepted boolean, term bigint, last_metadata_offset bigint")


def vote_outcomes(requests: DataFrame, voters: Iterable[int]) -> DataFrame:
    """(voter_id, seq, granted, term, voted_for) of vote requests (voter_id, seq, term, candidate_id, last_metadata_offset) in the
    order of ``seq`` at each voter, whose own log is empty."""
    voters = frozenset(voters)

    def step(q: Quorum, r: dict) -> dict:
        said = q.vote(r["term"], r["candidate_id"], r["last_metadata_offset"])
        return {"voter_id": r["voter_id"], "seq": r["seq"], "granted": said, "term": q.term, "voted_for": q.voted_for}

    return fold_sorted(requests, ("voter_id",), "seq", lambda: Quorum(voters), step, "voter_id bigint, seq bigint, granted boolean, term bigint, voted_for bigint")


def follower_progress(own: DataFrame, leader: DataFrame) -> DataFrame:
    """(topic, partition, broker_id, log_end_offset) that followers report: the lesser of their own end and the leader's."""
    own = own.select(*PARTITION, "broker_id", "log_end_offset")
    ends = leader.select(*PARTITION, F.col("log_end_offset").alias("leader_end"))
    return own.join(ends, [*PARTITION]).select(*PARTITION, "broker_id", F.least("leader_end", "log_end_offset").alias("log_end_offset"))


def authority(voters: Column, me: Column, leader: Column, roles: Column) -> tuple[Column, Column]:
    """``may_write`` and ``may_auto_create`` as expressions; voters and roles are arrays, the leader null where none is known."""
    controls, leads = F.array_contains(roles, "controller"), F.coalesce(leader == me, F.lit(False))
    return (F.size(voters) == 0) | (controls & leads), F.when(controls, (F.size(voters) <= 1) | leads).otherwise(F.size(voters) == 0)


def replica_sync(leader: DataFrame, follower_ends: DataFrame, limit: int = 1000) -> DataFrame:
    """(topic, partition, rounds, copied, log_end_offset): rounds of at most ``limit`` records until a follower has its leader's log.

    The log is dense, so the rounds follow from the ends and need no loop; a follower ahead is truncated first.
    """
    ends = leader.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("end"))
    start = F.least("log_end_offset", "end")
    return ends.join(follower_ends, [*PARTITION]).select(
        *PARTITION, F.ceil((F.col("end") - start) / limit).cast("bigint").alias("rounds"), (F.col("end") - start).alias("copied"), F.col("end").alias("log_end_offset")
    )


def last_entries(entries: DataFrame) -> DataFrame:
    """The last payload of each journal section; each entry replaces its section, and groups aren't kept."""
    return entries.where("section <> 'Groups'").groupBy("section").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def replay_metadata(lines: DataFrame, after: int, schema: str) -> DataFrame:
    """Records of a metadata log (line_no, text) up to its first line that isn't one, beyond offset ``after``."""
    parsed = lines.withColumn("r", F.from_json("text", schema))
    # a line that can't be read gives a record without an offset
    broken = F.col("r").isNull() | F.col("r.metadata_offset").isNull()
    first = parsed.where(broken).agg(F.min("line_no").alias("first"))
    return parsed.crossJoin(F.broadcast(first)).where((F.col("first").isNull() | (F.col("line_no") < F.col("first"))) & (F.col("r.metadata_offset") > after)).select("line_no", "r.*")
