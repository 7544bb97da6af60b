"""Consumer groups and committed offsets."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill import schema
from logmill.operators.folds import fold_sorted
from logmill.operators.scan import PARTITION, log_ends

GROUP_KEY = ("group_id", *PARTITION)


def parse_key(text: Column) -> Column:
    """(group_id, topic, partition) of a stored key "group:topic:partition".  It is cut at its first two colons; a partition that is
    missing or no number is 0, a missing topic empty."""
    part = lambda i: F.regexp_extract(text, r"(?s)^([^:]*)(?::([^:]*))?(?::(.*))?\z", i)
    number = F.when(part(3).rlike(r"^[+-]?[0-9]+\z"), part(3).try_cast("int"))
    return F.struct(part(1).alias("group_id"), part(2).alias("topic"), F.coalesce(number, F.lit(0)).alias("partition"))


def parse_producer_key(text: Column) -> Column:
    """(topic, partition, producer_id) of a stored key "topic:partition:producer"; a topic may have colons.  Null where it is none."""
    form = r"(?s)^(.*):([0-9]{1,9}):(-?[0-9]{1,18})\z"
    part = lambda i: F.regexp_extract(text, form, i)
    return F.when(text.rlike(form), F.struct(part(1).alias("topic"), part(2).cast("int").alias("partition"), part(3).cast("bigint").alias("producer_id")))


def render_key(group_id: Column, topic: Column, partition: Column) -> Column:
    return F.concat_ws(":", group_id, topic, partition.cast("string"))


def committed_offsets(commits: DataFrame, order: str = "commit_seq") -> DataFrame:
    """The last commit of each (group, topic, partition); it may be less than an earlier one."""
    return commits.groupBy(*GROUP_KEY).agg(F.max_by("next_offset", order).alias("next_offset"))


def offset_fetch(committed: DataFrame, requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """The committed offset of each request, -1 without one; error 3 where the partition is unknown."""
    known = catalog.select(*PARTITION).distinct().withColumn("known", F.lit(True))
    j = requested.join(committed, [*GROUP_KEY], "left").join(known, [*PARTITION], "left")
    return j.select(*GROUP_KEY, F.when(F.col("known"), F.coalesce("next_offset", F.lit(-1))).otherwise(-1).alias("next_offset"), F.when(F.col("known"), 0).otherwise(3).cast("bigint").alias("error_code"))


def consumer_lag(committed: DataFrame, log: DataFrame) -> DataFrame:
    return committed.join(log_ends(log), [*PARTITION]).select(*GROUP_KEY, "next_offset", "log_end_offset", (F.col("log_end_offset") - F.col("next_offset")).alias("lag"))


def consumer_resume(committed: DataFrame, log: DataFrame) -> DataFrame:
    """The records that each group has yet to read, of the partitions where it committed."""
    return log.join(committed, [*PARTITION]).where("offset >= next_offset")


def range_assignor(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """(member_id, topic, partition): each topic's partitions, in order, split evenly among the sorted members that
    subscribe to it (``members``: member_id, topic), the first ones taking the remainder."""
    m = members.distinct()
    by = Window.partitionBy("topic")
    m = m.withColumn("i", F.row_number().over(by.orderBy("member_id")) - 1).withColumn("k", F.count("*").over(by))
    p = partitions.select(*PARTITION).distinct().withColumn("place", F.row_number().over(by.orderBy("partition")) - 1).withColumn("n", F.count("*").over(by))
    share, rest = F.floor(F.col("n") / F.col("k")), F.col("n") % F.col("k")
    low = F.col("i") * share + F.least(F.col("i"), rest)
    high = low + share + (F.col("i") < rest).cast("int")
    return p.join(m, "topic").where((F.col("place") >= low) & (F.col("place") < high)).select("member_id", *PARTITION)


def assignment_complete(members: DataFrame, assignments: DataFrame) -> DataFrame:
    """(group_id, member_id, problem): what keeps an assignment (group_id, member_id, assignment) from being accepted."""
    key = ["group_id", "member_id"]
    stray = assignments.join(members, key, "left_anti").select(*key, F.lit("unknown member").alias("problem"))
    empty = assignments.join(members, key, "left_semi").where(F.coalesce(F.octet_length("assignment"), F.lit(0)) == 0).select(*key, F.lit("empty assignment").alias("problem"))
    missing = members.join(assignments, key, "left_anti").select(*key, F.lit("no assignment").alias("problem"))
    return stray.unionByName(empty).unionByName(missing)


def group_leader(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.min("member_id").alias("leader_member_id"))


def session_expiry(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """Beats (group_id, member_id, now_ms) after which the member's next one is later than the timeout allows."""
    after = F.lead("now_ms").over(Window.partitionBy("group_id", "member_id").orderBy("now_ms"))
    return beats.withColumn("gap_ms", after - F.col("now_ms")).where(F.col("gap_ms") > timeout_ms)


class Least:
    """A set whose least elements are found without sorting it: a heap, where what has left the set is dropped as it comes up."""

    def __init__(self) -> None:
        self.live: set[str] = set()
        self.heap: list[str] = []

    def __len__(self) -> int:
        return len(self.live)

    def add(self, x: str) -> None:
        if x not in self.live:
            self.live.add(x)
            heappush(self.heap, x)

    def discard(self, x: str) -> None:
        self.live.discard(x)
        if len(self.heap) > 2 * len(self.live) + 16:
            self.heap = sorted(self.live)

    def first(self) -> str | None:
        while self.heap and self.heap[0] not in self.live:
            heappop(self.heap)
        return self.heap[0] if self.heap else None

    def least(self, n: int) -> list[str]:
        """The ``n`` least, or all, in order."""
        found: list[str] = []
        while self.heap and len(found) < n:
            x = heappop(self.heap)
            # what left and came back may stand there twice
            if x in self.live and (not found or found[-1] != x):
                found.append(x)
        for x in found:
            heappush(self.heap, x)
        return found


@dataclass
class Assignments:
    """What members are assigned, ``rest`` where it isn't said, so that all lose theirs or get none in one step."""

    own: dict[str, object] = field(default_factory=dict)
    rest: object = None


@dataclass
class Member:
    id: str
    kind: tuple
    topics: tuple[str, ...]
    session_timeout_ms: int
    last_heartbeat_ms: int
    assignments: Assignments
    #: The deadline under which the group looks at the member again, at most the real one.
    queued: int | None = None

    @property
    def deadline(self) -> int:
        return self.last_heartbeat_ms + self.session_timeout_ms

    @property
    def assignment(self) -> object:
        return self.assignments.own.get(self.id, self.assignments.rest)


@dataclass
class Group:
    """A consumer group; ``step`` is the fold that batch and streaming share.

    No event goes over all members: expired ones are found by a heap of deadlines, the leader and those that get partitions by
    heaps of ids."""

    generation: int = 0
    protocol: str = ""
    leader: str | None = None
    ready: bool = False
    failed: bool = False
    members: dict[str, Member] = field(default_factory=dict)
    exists: bool = False
    assignments: Assignments = field(default_factory=Assignments)
    ids: Least = field(default_factory=Least)
    subscribers: dict[str, Least] = field(default_factory=dict)
    deadlines: list[tuple[int, str]] = field(default_factory=list)

    def _watch(self, m: Member) -> None:
        """Sees to it that the member is looked at by its deadline.  One that moved on is put off when it comes up, so beats
        leave no entries behind."""
        if m.queued is not None and m.queued <= m.deadline:
            return
        m.queued = m.deadline
        heappush(self.deadlines, (m.deadline, m.id))
        if len(self.deadlines) > 2 * len(self.members) + 16:
            for m in self.members.values():
                m.queued = m.deadline
            self.deadlines = sorted((m.deadline, m.id) for m in self.members.values())

    def _put(self, m: Member) -> None:
        old = self.members.get(m.id)
        if old is not None:
            m.queued = old.queued
        self.members[m.id] = m
        self.ids.add(m.id)
        if old is None or old.topics != m.topics:
            if old is not None:
                self._unsubscribe(old)
            for t in m.topics:
                if t not in self.subscribers:
                    self.subscribers[t] = Least()
                self.subscribers[t].add(m.id)
        self._watch(m)

    def _unsubscribe(self, m: Member) -> None:
        for t in set(m.topics):
            self.subscribers[t].discard(m.id)
            if not self.subscribers[t]:
                del self.subscribers[t]

    def _remove(self, member_id: str) -> None:
        self._unsubscribe(self.members.pop(member_id))
        self.ids.discard(member_id)
        self.assignments.own.pop(member_id, None)

    def _assign(self, own: dict[str, object], rest: object) -> None:
        self.assignments.own, self.assignments.rest = own, rest

    def _prune(self, now: int) -> bool:
        before = len(self.members)
        while self.deadlines and self.deadlines[0][0] < now:
            at, k = heappop(self.deadlines)
            m = self.members.get(k)
            if m is None or m.queued != at:
                continue  # it left, or has another entry
            if m.deadline < now:
                self._remove(k)
            else:
                m.queued = None
                self._watch(m)
        return len(self.members) != before

    def join(self, group_id: str, member_id: str | None, protocol_type: str, protocol: str, topics: tuple[str, ...], session_ms: int, rebalance_ms: int, now: int) -> str:
        """The member's id, made up where it has none.  A change of members or of what one asks for starts a generation."""
        member_id = member_id or f"{group_id}-member-{now}"
        self.exists = True
        pruned = self._prune(now)
        kind = (protocol_type, protocol, session_ms, rebalance_ms)
        old = self.members.get(member_id)
        changed = old is None or (old.kind, old.topics) != (kind, topics)
        self._put(Member(member_id, kind, topics, session_ms, now, self.assignments))
        if pruned or changed or self.generation == 0:
            self.generation += 1
            self.protocol = protocol
            self.ready = self.failed = False
            self._assign({}, None)
        else:
            self.assignments.own[member_id] = None
        self.leader = self.ids.first()
        return member_id

    def build(self, partitions: dict[str, list[int]]) -> None:
        """Range assignment of ``partitions`` (by topic) to the members.  Beyond as many members as a topic has partitions none gets
        any of it."""
        shares: dict[str, list[tuple[str, int]]] = {}
        for topic in partitions.keys() & self.subscribers.keys():
            places, own = partitions[topic], self.subscribers[topic]
            if places is None:
                continue
            base, rest, at = *divmod(len(places), len(own)), 0
            for i, k in enumerate(own.least(len(places))):
                size = base + (i < rest)
                shares.setdefault(k, []).extend((topic, p) for p in places[at : at + size])
                at += size
        self._assign({k: sorted(v) for k, v in shares.items()}, [])

    def sync(self, member_id: str, generation: int, given: dict[str, object], partitions: dict[str, list[int]], now: int) -> tuple[int, object]:
        """(error, assignment).  The leader may bring assignments, complete and not empty; else they are built here."""
        if not self.exists:
            return schema.STALE_GENERATION, None
        self._prune(now)
        if member_id not in self.members or generation < self.generation:
            return schema.UNKNOWN_MEMBER, None
        if generation != self.generation:
            return schema.STALE_GENERATION, None
        if given:
            if any(not v or k not in self.members for k, v in given.items()) or len(given) < len(self.members):
                self.ready, self.failed = False, True
                return schema.UNKNOWN_MEMBER, None
            self._assign(dict(given), None)
            self.ready, self.failed = True, False
        elif self.leader == member_id:
            self.build(partitions)
            self.ready, self.failed = True, False
        else:
            if self.failed:
                return schema.UNKNOWN_MEMBER, None
            if not self.ready:
                self.build(partitions)
                self.ready, self.failed = True, False
            if self.members[member_id].assignment is None:
                return schema.UNKNOWN_MEMBER, None
        return schema.OK, self.members[member_id].assignment

    def heartbeat(self, member_id: str, generation: int, now: int) -> int:
        if member_id not in self.members:
            return schema.UNKNOWN_MEMBER
        if generation != self.generation:
            return schema.STALE_GENERATION
        m = self.members[member_id]
        m.last_heartbeat_ms = now
        self._watch(m)
        return schema.OK

    def leave(self, member_id: str) -> int:
        if member_id in self.members:
            self._remove(member_id)
            self.generation += 1
            self.leader = self.ids.first()
        return schema.OK

    def commit(self, member_id: str, generation: int) -> int:
        if member_id not in self.members:
            return schema.UNKNOWN_MEMBER
        return schema.STALE_GENERATION if generation > self.generation else schema.OK

    def step(self, e: dict, partitions: dict[str, list[int]]) -> dict:
        """The outcome of one event: member_id, generation_id, leader_member_id, error_code, members, assignment."""
        op, member, error, assignment = e["op"], e["member_id"], schema.OK, None
        if op == "join":
            member = self.join(e["group_id"], member, e["protocol_type"], e["protocol_name"], tuple(e["topics"] if e["topics"] is not None else ()), e["session_timeout_ms"], e["rebalance_timeout_ms"], e["now_ms"])
        elif op == "sync":
            error, assignment = self.sync(member, e["generation_id"], dict(e.get("assignments") or {}), partitions, e["now_ms"])
        elif op == "heartbeat":
            error = self.heartbeat(member, e["generation_id"], e["now_ms"])
        elif op == "leave":
            error = self.leave(member)
        elif op == "commit":
            error = self.commit(member, e["generation_id"])
        else:
            raise ValueError(f"no such group operation: {op}")
        said = None if assignment is None else assignment.decode("utf-8", "replace") if isinstance(assignment, bytes) else json.dumps(assignment)
        return {"member_id": member, "generation_id": self.generation, "leader_member_id": self.leader, "error_code": error, "members": len(self.members), "assignment": said}


OUTCOME = "group_id string, seq bigint, op string, member_id string, generation_id bigint, leader_member_id string, error_code bigint, members bigint, assignment string"
_OUTCOME_COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]


def fold(group: Group, events: Iterable[dict], partitions: dict[str, list[int]]) -> list[dict]:
    return [{"group_id": e["group_id"], "seq": e["seq"], "op": e["op"]} | group.step(e, partitions) for e in events]


_NUMBERS = ("generation_id", "session_timeout_ms", "rebalance_timeout_ms", "now_ms")


def event_rows(frame: pd.DataFrame) -> list[dict]:
    """Events of a frame by ``seq``, with 0 for missing numbers."""
    rows = frame.sort_values("seq").to_dict("records")
    for r in rows:
        for k in _NUMBERS:
            r[k] = 0 if pd.isna(r[k]) else int(r[k])
    return rows


def fold_groups(events: DataFrame, partitions: dict[str, list[int]]) -> DataFrame:
    """The outcome of each group event, in the order of ``seq`` within its group; missing numbers count as 0."""

    def step(group: Group, e: dict) -> dict:
        e |= {k: e[k] or 0 for k in _NUMBERS}
        return {"group_id": e["group_id"], "seq": e["seq"], "op": e["op"]} | group.step(e, partitions)

    return fold_sorted(events, ("group_id",), "seq", Group, step, OUTCOME)
