"""Queries of the folds, where each event's outcome hangs on the events before it, beside recursive SQL that takes one event of each
key a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.operators import append, cluster, groups, scan
from logmill.operators.scan import PARTITION
from logmill.plans.log_queries import literal, lossy, plain, query, retried
from logmill.sources.logview import EVENTS_SQL, events_log

# --- producers ---

NEXT_PRODUCER = 1 << 40


def _batches(spark, sf) -> DataFrame:
    """Produce batches of one to three records, with retries, lost batches (every 97th), fenced ones, producers that no id was handed
    out to and producers without an id."""
    rows = lossy(retried(spark, sf))
    epoch = F.when(F.col("arrival") % 331 == 0, -1).when(F.col("arrival") > 5000, 1).otherwise(0)
    user, n = F.col("producer_id"), 1 + F.col("producer_id") % 3
    producer = F.when(user % 29 == 7, NEXT_PRODUCER + user).when(user % 31 == 5, -1).otherwise(user)
    first = F.col("sequence") * n
    return rows.select(*PARTITION, F.col("sent").alias("batch"), producer.alias("producer_id"), epoch.alias("producer_epoch"), first.alias("first_sequence"), (first + n - 1).alias("last_sequence"), n.alias("records"))


def _outcomes_sql(routed: str) -> str:
    return EVENTS_SQL.replace("WITH L", "WITH RECURSIVE L") + f"""
, S AS (SELECT *, arrival * 2 AS batch FROM L UNION ALL SELECT *, arrival * 2 + 1 FROM L WHERE arrival % 10 = 0),
B AS (SELECT topic, partition, batch, CASE WHEN producer_id % 29 = 7 THEN {NEXT_PRODUCER} + producer_id WHEN producer_id % 31 = 5 THEN -1 ELSE producer_id END AS producer_id,
             CASE WHEN arrival % 331 = 0 THEN -1 WHEN arrival > 5000 THEN 1 ELSE 0 END AS epoch, sequence * (1 + producer_id % 3) AS first, sequence * (1 + producer_id % 3) + producer_id % 3 AS last, 1 + producer_id % 3 AS records
      FROM S WHERE arrival % 97 <> 0),
R AS (SELECT *, {routed} AS routed FROM B),
H AS (SELECT *, row_number() OVER (PARTITION BY topic, partition, producer_id ORDER BY batch) AS n FROM R WHERE routed = 0 AND producer_id >= 0 AND producer_id < {NEXT_PRODUCER}),
K AS (
  SELECT topic, partition, producer_id, n, batch, records, epoch, first, last, batch AS held, CAST(0 AS BIGINT) AS error, CAST(NULL AS BIGINT) AS repeats FROM H WHERE n = 1
  UNION ALL
  SELECT topic, partition, producer_id, n, batch, records, CASE WHEN ok THEN e ELSE epoch END, CASE WHEN ok THEN f ELSE first END, CASE WHEN ok THEN l ELSE last END, CASE WHEN ok THEN batch ELSE held END,
         CAST(CASE WHEN e < epoch THEN 47 WHEN ok OR again THEN 0 ELSE 45 END AS BIGINT), CASE WHEN again THEN held END
  FROM (SELECT K.topic, K.partition, K.producer_id, H.n, H.batch, H.records, K.epoch, K.first, K.last, K.held, H.epoch AS e, H.first AS f, H.last AS l,
               H.epoch = K.epoch AND H.first = K.first AND H.last = K.last AS again, H.epoch > K.epoch OR (H.epoch = K.epoch AND H.first = K.last + 1) AS ok
        FROM K JOIN H ON H.topic = K.topic AND H.partition = K.partition AND H.producer_id = K.producer_id AND H.n = K.n + 1)),
J AS (SELECT topic, partition, batch, producer_id, records, error, repeats FROM K
      UNION ALL SELECT topic, partition, batch, producer_id, records, CASE WHEN producer_id < 0 THEN 0 ELSE 59 END, NULL FROM R WHERE routed = 0 AND (producer_id < 0 OR producer_id >= {NEXT_PRODUCER})),
P AS (SELECT *, coalesce(sum(CASE WHEN error = 0 AND repeats IS NULL THEN records ELSE 0 END) OVER (PARTITION BY topic, partition ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM J)
SELECT P.topic, CAST(P.partition AS BIGINT) AS partition, P.batch, P.producer_id, P.error AS error_code, CAST(CASE WHEN P.error <> 0 THEN -1 ELSE coalesce(Q.base, P.base) END AS BIGINT) AS base_offset,
       CAST(CASE WHEN P.error <> 0 THEN -1 ELSE coalesce(Q.base + Q.records, P.base + P.records) - 1 END AS BIGINT) AS last_offset
FROM P LEFT JOIN P AS Q ON Q.topic = P.topic AND Q.partition = P.partition AND Q.batch = P.repeats
UNION ALL SELECT topic, CAST(partition AS BIGINT), batch, producer_id, routed, -1, -1 FROM R WHERE routed <> 0
"""


@query(_outcomes_sql("CASE WHEN topic = 'view' AND partition = 0 THEN 3 WHEN topic = 'signup' THEN 6 ELSE 0 END"))
def q_produce_outcomes(spark, sf):
    batches = _batches(spark, sf)
    leaders = batches.select(*PARTITION).distinct().where("not (topic = 'view' and partition = 0)").withColumn("leader_id", F.when(F.col("topic") == "signup", 2).otherwise(1))
    return plain(append.produce_outcomes(batches, NEXT_PRODUCER, leaders))


# "click" is known with partition 0 alone; two partitions a topic are made of what is unknown, "signup" may not be made elsewhere
@query(_outcomes_sql("CASE WHEN topic = 'click' THEN CASE WHEN partition = 0 THEN 0 ELSE 3 END WHEN partition >= 2 THEN 3 ELSE 0 END"))
def q_produce_auto_create(spark, sf):
    batches = _batches(spark, sf)
    catalog = literal(spark, [("click", 0)], "topic string, partition int")
    assert cluster.may_auto_create([1], 1, None, ["broker", "controller"])
    made = scan.auto_created(catalog, batches, 2)
    return plain(append.produce_outcomes(batches, NEXT_PRODUCER, made.withColumn("leader_id", F.lit(1))))


@query(EVENTS_SQL + """
, C AS (SELECT topic, count(DISTINCT partition) AS n FROM L WHERE topic <> 'view' GROUP BY topic),
A AS (SELECT event_type AS topic FROM events UNION SELECT 'new-' || event_type FROM events)
SELECT A.topic, CAST(0 AS BIGINT) AS error_code, coalesce(C.n, 4) AS partitions FROM A LEFT JOIN C ON A.topic = C.topic
""")
def q_metadata_auto_create(spark, sf):
    catalog = scan.topic_metadata(events_log(spark, sf)).where("topic <> 'view'")
    names = spark.read.parquet(f"{sf}/events.parquet").select(F.explode(F.array(F.col("event_type"), F.concat(F.lit("new-"), "event_type"))).alias("topic")).distinct()
    return plain(scan.metadata_lookup(names, catalog, create_partitions=4))


# --- groups ---

_TOPICS = {"click": [0, 1, 2], "view": [0, 1, 2]}
_OPS = ("join", "heartbeat", "commit", "sync", "join", "heartbeat", "sync", "sync", "leave", "heartbeat")


def group_events(spark, sf) -> DataFrame:
    """Joins, beats, commits, syncs and leaves of the members of fifty groups, one event each from ``events``.  Some members have no id, some
    change what they ask for, and some syncs bring assignments: whole ones of groups of one, empty ones, and ones of strangers."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    member = F.concat(F.lit("m-"), "user_id")
    given = lambda k, v: F.create_map(k, F.lit(v).cast("binary"))
    op = F.element_at(F.array(*map(F.lit, _OPS)), (F.floor(i / 3) % 10 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("g"), F.col("user_id") % 50).alias("group_id"), i.alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("now_ms"),
        op.alias("op"), F.when(i % 101 != 7, member).otherwise("").alias("member_id"), (F.floor(i / 250) + i % 3 - 1).cast("int").alias("generation_id"), F.lit("consumer").alias("protocol_type"),
        F.when(i % 37 == 0, "sticky").otherwise("range").alias("protocol_name"), F.when(i % 13 == 0, F.array(F.lit("click"), F.lit("nowhere"))).otherwise(F.array(F.lit("click"), F.lit("view"))).alias("topics"),
        F.lit(86_400_000).alias("session_timeout_ms"), F.lit(60_000).alias("rebalance_timeout_ms"),
        F.when(i % 7 == 0, given(member, "all of it")).when(i % 7 == 1, given(member, "")).when(i % 7 == 2, given(F.lit("m-stranger"), "x")).alias("assignments"),
    )


def _share(topic: str) -> str:
    """SQL for a member's partitions of a topic with three: its place among the sorted members that want it decides."""
    own = f"list_transform(list_filter(alive, lambda o: list_contains(o.topics, '{topic}')), lambda o: o.id)"
    place, k = f"(list_position({own}, m.id) - 1)", f"len({own})"
    return (
        f"CASE WHEN list_contains(m.topics, '{topic}') THEN list_transform(range({place} * (3 // {k}) + least({place}, 3 % {k}), ({place} + 1) * (3 // {k}) + least({place} + 1, 3 % {k})), "
        f"""lambda p: '["{topic}", ' || p || ']') ELSE [] END"""
    )


_GROUPS_SQL = f"""
WITH RECURSIVE E AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS n FROM (
    SELECT 'g' || (user_id % 50) AS group_id, event_id AS seq, epoch_us(ts) // 1000 AS now, [{', '.join(f"'{x}'" for x in _OPS)}][event_id // 3 % 10 + 1] AS op, 'm-' || user_id AS own,
           CASE WHEN event_id % 101 <> 7 THEN 'm-' || user_id ELSE '' END AS member_id, event_id // 250 + event_id % 3 - 1 AS asked,
           CASE WHEN event_id % 37 = 0 THEN 'sticky' ELSE 'range' END AS kind, CASE WHEN event_id % 13 = 0 THEN ['click', 'nowhere'] ELSE ['click', 'view'] END AS topics,
           CASE event_id % 7 WHEN 0 THEN 'm-' || user_id WHEN 1 THEN 'm-' || user_id WHEN 2 THEN 'm-stranger' END AS given_to,
           CASE event_id % 7 WHEN 0 THEN 'all of it' WHEN 1 THEN '' WHEN 2 THEN 'x' END AS given FROM events)),
G AS (
  SELECT group_id, CAST(0 AS BIGINT) AS n, false AS known, CAST(0 AS BIGINT) AS gen, CAST(NULL AS VARCHAR) AS leader, false AS ready, false AS failed,
         CAST([] AS STRUCT(id VARCHAR, kind VARCHAR, topics VARCHAR[], beat BIGINT, has VARCHAR)[]) AS members,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS member_id, CAST(NULL AS BIGINT) AS error_code, CAST(NULL AS VARCHAR) AS assignment
  FROM (SELECT DISTINCT group_id FROM E)
  UNION ALL
  SELECT group_id, n, known OR op = 'join', CASE WHEN moves THEN gen + 1 ELSE gen END,
         CASE WHEN op = 'join' OR (op = 'leave' AND old IS NOT NULL) THEN list_min(list_transform(after, lambda m: m.id)) ELSE leader END,
         CASE WHEN op = 'join' AND moves THEN false WHEN op = 'sync' AND (builds OR gives) THEN true WHEN refuses THEN false ELSE ready END,
         CASE WHEN op = 'join' AND moves THEN false WHEN op = 'sync' AND (builds OR gives) THEN false WHEN refuses THEN true ELSE failed END,
         after, seq, op, id, CAST(error AS BIGINT), CASE WHEN op = 'sync' AND error = 0 THEN list_filter(after, lambda m: m.id = id)[1].has END
  FROM (
    SELECT *, CASE op
        WHEN 'join' THEN list_sort(list_append(list_transform(list_filter(alive, lambda m: m.id <> id), lambda m: struct_pack(id := m.id, kind := m.kind, topics := m.topics, beat := m.beat, has := CASE WHEN moves THEN NULL ELSE m.has END)),
                                               struct_pack(id := id, kind := kind, topics := topics, beat := now, has := CAST(NULL AS VARCHAR))))
        WHEN 'sync' THEN CASE WHEN gives THEN list_transform(alive, lambda m: struct_pack(id := m.id, kind := m.kind, topics := m.topics, beat := m.beat, has := given))
                              WHEN builds THEN list_transform(alive, lambda m: struct_pack(id := m.id, kind := m.kind, topics := m.topics, beat := m.beat, has := '[' || array_to_string(list_concat({_share('click')}, {_share('view')}), ', ') || ']'))
                              ELSE alive END
        WHEN 'heartbeat' THEN list_transform(alive, lambda m: struct_pack(id := m.id, kind := m.kind, topics := m.topics, beat := CASE WHEN m.id = id AND error = 0 THEN now ELSE m.beat END, has := m.has))
        WHEN 'leave' THEN list_filter(alive, lambda m: m.id <> id) ELSE alive END AS after
    FROM (
      SELECT *, CASE op WHEN 'join' THEN len(alive) <> had OR old IS NULL OR old.kind <> kind OR old.topics <> topics OR gen = 0 WHEN 'leave' THEN old IS NOT NULL ELSE false END AS moves,
             coalesce(valid AND given IS NOT NULL AND whole, false) AS gives, coalesce(valid AND given IS NOT NULL AND NOT whole, false) AS refuses,
             coalesce(valid AND given IS NULL AND (leader = id OR (NOT failed AND NOT ready)), false) AS builds,
             CASE op
               WHEN 'sync' THEN CASE WHEN NOT known THEN 22 WHEN old IS NULL OR asked < gen THEN 25 WHEN asked <> gen THEN 22 WHEN given IS NOT NULL THEN CASE WHEN whole THEN 0 ELSE 25 END
                                     WHEN leader = id THEN 0 WHEN failed THEN 25 WHEN NOT ready THEN 0 WHEN old.has IS NULL THEN 25 ELSE 0 END
               WHEN 'heartbeat' THEN CASE WHEN old IS NULL THEN 25 WHEN asked <> gen THEN 22 ELSE 0 END
               WHEN 'commit' THEN CASE WHEN old IS NULL THEN 25 WHEN asked > gen THEN 22 ELSE 0 END ELSE 0 END AS error
      FROM (
        SELECT *, list_filter(alive, lambda m: m.id = id)[1] AS old, len(alive) = 1 AND alive[1].id = given_to AND given <> '' AS whole,
               op = 'sync' AND known AND asked = gen AND len(list_filter(alive, lambda m: m.id = id)) = 1 AS valid
        FROM (
          SELECT G.group_id, E.n, G.known, G.gen, G.leader, G.ready, G.failed, len(G.members) AS had, E.seq, E.op, E.now, E.asked, E.kind, E.topics, E.given_to, E.given,
                 CASE WHEN E.op = 'join' AND E.member_id = '' THEN E.group_id || '-member-' || E.now ELSE E.member_id END AS id,
                 CASE WHEN E.op = 'join' OR (E.op = 'sync' AND G.known) THEN list_filter(G.members, lambda m: E.now - m.beat <= 86400000) ELSE G.members END AS alive
          FROM G JOIN E ON E.group_id = G.group_id AND E.n = G.n + 1)))))
SELECT group_id, seq, op, member_id, gen AS generation_id, leader AS leader_member_id, error_code, len(members) AS members, assignment FROM G WHERE n > 0
"""


@query(f"SELECT * FROM ({_GROUPS_SQL}) WHERE op IN ('join', 'leave', 'sync')")
def q_group_generations(spark, sf):
    return groups.fold_groups(group_events(spark, sf), _TOPICS).where("op in ('join', 'leave', 'sync')")


@query(f"SELECT group_id, seq, member_id, generation_id, error_code, assignment FROM ({_GROUPS_SQL}) WHERE op = 'sync'")
def q_sync_outcomes(spark, sf):
    return groups.fold_groups(group_events(spark, sf), _TOPICS).where("op = 'sync'").select("group_id", "seq", "member_id", "generation_id", "error_code", "assignment")


@query(f"""
SELECT group_id, seq, op, members, coalesce(lag(members) OVER (PARTITION BY group_id ORDER BY seq), 0) AS before FROM ({_GROUPS_SQL})
""")
def q_group_pruning(spark, sf):
    # a join or a sync after which there are fewer members has dropped expired ones
    from pyspark.sql import Window

    out = groups.fold_groups(group_events(spark, sf), _TOPICS)
    return out.select("group_id", "seq", "op", "members", F.coalesce(F.lag("members").over(Window.partitionBy("group_id").orderBy("seq")), F.lit(0)).alias("before"))


@query(f"SELECT group_id, seq, member_id, generation_id, error_code FROM ({_GROUPS_SQL}) WHERE op = 'heartbeat'")
def q_heartbeat_outcomes(spark, sf):
    return groups.fold_groups(group_events(spark, sf), _TOPICS).where("op = 'heartbeat'").select("group_id", "seq", "member_id", "generation_id", "error_code")


@query(f"SELECT group_id, seq, member_id, generation_id, error_code FROM ({_GROUPS_SQL}) WHERE op = 'commit'")
def q_commit_outcomes(spark, sf):
    return groups.fold_groups(group_events(spark, sf), _TOPICS).where("op = 'commit'").select("group_id", "seq", "member_id", "generation_id", "error_code")


# --- metadata ---

_KINDS = ("UpdateReplicaProgress", "UpdateReplicaProgress", "UpdatePartitionLeader", "UpdateReplicaProgress", "UpdatePartitionReplication", "UpdateReplicaProgress", "BeginPartitionReassignment", "AdvancePartitionReassignment", "UpdateReplicaProgress", "AdvancePartitionReassignment", "CompletePartitionReassignment")


def metadata_events(spark, sf) -> DataFrame:
    """A metadata log over 24 partitions, one record from each event, among them records of controllers and brokers and of a partition that
    isn't known yet."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    k = F.floor(i / 24).cast("bigint")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    ints = lambda *xs: F.array(*map(F.lit, xs))
    made = (i < 23) | (i == 23 + 24 * 6)
    kind = F.when(made, "UpsertPartition").when(i % 50 == 49, "SetController").when(i % 50 == 24, "RegisterBroker").otherwise(pick(_KINDS, (k + i % 5) % 11))
    return e.select(
        i.alias("seq"), kind.alias("kind"), F.concat(F.lit("t"), i % 3).alias("topic_name"), F.floor(i % 24 / 3).cast("int").alias("partition_index"), (1 + F.col("user_id") % 3).cast("int").alias("leader_id"),
        F.when(made, 0).otherwise(F.floor(k / 40)).cast("int").alias("leader_epoch"), F.when(F.col("user_id") % 2 == 0, ints(1, 2, 3)).otherwise(ints(2, 1)).alias("replicas"), ints(1, 2).alias("isr"),
        (1 + F.col("user_id") % 4).cast("int").alias("broker_id"), (F.floor(k / 4) + F.col("user_id") % 3).cast("bigint").alias("log_end_offset"), F.floor(i / 60).cast("bigint").alias("last_caught_up_ms"),
        F.when(k % 3 == 0, ints(3, 1)).when(k % 3 == 1, ints(2, 2, 4, 2)).otherwise(F.when(i % 7 == 0, F.array().cast("array<int>")).otherwise(ints(1))).alias("target_replicas"),
        pick(cluster.STEPS, (k + F.col("user_id")) % 6).alias("step"), (F.floor(i / 700) % 3).cast("int").alias("controller_id"), F.concat(F.lit("h"), F.floor(i / 900) % 2).alias("host"), (9092 + F.floor(i / 1300)).cast("int").alias("port"),
    )


_HAS = "len(list_filter(progress, lambda p: p.b = {b} AND p.z >= mark)) > 0"
_METADATA_SQL = f"""
WITH RECURSIVE M AS (
  SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) - 1 AS metadata_offset, 't' || (event_id % 3) AS topic_name, event_id % 24 // 3 AS partition_index, event_id // 24 AS k,
         CASE WHEN event_id < 23 OR event_id = 23 + 24 * 6 THEN 'UpsertPartition' WHEN event_id % 50 = 49 THEN 'SetController' WHEN event_id % 50 = 24 THEN 'RegisterBroker'
              ELSE [{', '.join(f"'{x}'" for x in _KINDS)}][(event_id // 24 + event_id % 5) % 11 + 1] END AS kind,
         1 + user_id % 3 AS leader_id, CASE WHEN event_id < 23 OR event_id = 23 + 24 * 6 THEN 0 ELSE event_id // 24 // 40 END AS epoch,
         CASE WHEN user_id % 2 = 0 THEN CAST([1, 2, 3] AS BIGINT[]) ELSE [2, 1] END AS replicas, CAST([1, 2] AS BIGINT[]) AS isr, 1 + user_id % 4 AS broker_id, event_id // 24 // 4 + user_id % 3 AS z, event_id // 60 AS ms,
         CASE WHEN event_id // 24 % 3 = 0 THEN CAST([3, 1] AS BIGINT[]) WHEN event_id // 24 % 3 = 1 THEN [2, 2, 4, 2] WHEN event_id % 7 = 0 THEN [] ELSE [1] END AS targets,
         [{', '.join(f"'{x}'" for x in cluster.STEPS)}][(event_id // 24 + user_id) % 6 + 1] AS step, event_id // 700 % 3 AS controller_id, 'h' || (event_id // 900 % 2) AS host, 9092 + event_id // 1300 AS port
  FROM events),
E AS (SELECT *, CASE WHEN kind = 'CompletePartitionReassignment' THEN 'Complete' ELSE step END AS goal, row_number() OVER (PARTITION BY topic_name, partition_index ORDER BY seq) AS n FROM M WHERE kind NOT IN ('SetController', 'RegisterBroker')),
P AS (
  SELECT topic_name, partition_index, CAST(0 AS BIGINT) AS n, false AS known, CAST(-1 AS BIGINT) AS leader, CAST(-1 AS BIGINT) AS epoch, CAST(-1 AS BIGINT) AS mark, CAST([] AS BIGINT[]) AS replicas, CAST([] AS BIGINT[]) AS isr,
         CAST([] AS STRUCT(b BIGINT, z BIGINT, ms BIGINT)[]) AS progress, CAST(NULL AS BIGINT[]) AS targets, CAST(NULL AS VARCHAR) AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS metadata_offset, CAST(NULL AS VARCHAR) AS kind, false AS changed
  FROM (SELECT DISTINCT topic_name, partition_index FROM E)
  UNION ALL
  SELECT topic_name, partition_index, n, known OR kind = 'UpsertPartition', leader, epoch,
         -- a report or a change of replicas moves the watermark to the least end in the set, if any
         CASE WHEN kind = 'UpsertPartition' THEN 0 WHEN does AND kind IN ('UpdateReplicaProgress', 'UpdatePartitionReplication')
              THEN coalesce(list_min(list_transform(list_filter(progress, lambda p: list_contains(isr, p.b)), lambda p: p.z)), mark) ELSE mark END,
         replicas, isr, progress, targets, step, seq, metadata_offset, kind, does
  FROM (
    SELECT topic_name, partition_index, n, known, mark, seq, metadata_offset, kind, does, progress, leader, epoch,
           CASE WHEN NOT does THEN replicas WHEN kind IN ('UpsertPartition', 'UpdatePartitionReplication') THEN e_replicas WHEN kind = 'UpdatePartitionLeader' AND NOT list_contains(replicas, e_leader) THEN list_prepend(e_leader, replicas)
                WHEN goes AND goal = 'ExpandingIsr' THEN list_concat(replicas, list_filter(targets, lambda t, i: list_position(targets, t) = i AND NOT list_contains(replicas, t))) WHEN goes AND goal IN ('Shrinking', 'Complete') THEN targets ELSE replicas END AS replicas,
           CASE WHEN NOT does THEN isr WHEN kind IN ('UpsertPartition', 'UpdatePartitionReplication') THEN e_isr WHEN kind = 'UpdatePartitionLeader' AND NOT list_contains(isr, e_leader) THEN list_prepend(e_leader, isr)
                WHEN kind = 'UpdateReplicaProgress' THEN CASE WHEN tip IS NULL THEN [leader] ELSE list_filter(replicas, lambda r: r = leader OR len(list_filter(progress, lambda p: p.b = r AND tip - p.z <= 1)) > 0) END
                WHEN goes AND goal = 'ExpandingIsr' THEN list_concat(isr, list_filter(targets, lambda t, i: list_position(targets, t) = i AND NOT list_contains(isr, t))) WHEN goes AND goal IN ('Shrinking', 'Complete') THEN list_filter(isr, lambda r: list_contains(targets, r)) ELSE isr END AS isr,
           CASE WHEN does AND kind = 'UpsertPartition' THEN NULL WHEN does AND kind = 'BeginPartitionReassignment' THEN e_targets WHEN goes AND goal = 'Complete' THEN NULL ELSE targets END AS targets,
           CASE WHEN does AND kind = 'UpsertPartition' THEN NULL WHEN does AND kind = 'BeginPartitionReassignment' THEN 'Planned' WHEN goes THEN nullif(goal, 'Complete') ELSE step END AS step
    FROM (
      SELECT * REPLACE (
               CASE WHEN does AND kind = 'UpsertPartition' THEN [] WHEN does AND kind = 'UpdateReplicaProgress' THEN list_append(list_filter(progress, lambda p: p.b <> broker_id), struct_pack(b := broker_id, z := z, ms := ms)) ELSE progress END AS progress,
               CASE WHEN does AND kind IN ('UpsertPartition', 'UpdatePartitionLeader') THEN e_leader WHEN goes AND goal = 'LeaderSwitch' THEN targets[1] ELSE leader END AS leader,
               CASE WHEN does AND kind IN ('UpsertPartition', 'UpdatePartitionLeader', 'UpdatePartitionReplication') THEN e_epoch WHEN goes AND goal = 'LeaderSwitch' THEN epoch + 1 ELSE epoch END AS epoch),
             CASE WHEN broker_id = leader THEN z ELSE list_filter(progress, lambda p: p.b = leader)[1].z END AS tip
      FROM (
        SELECT *, does AND kind IN ('AdvancePartitionReassignment', 'CompletePartitionReassignment') AS goes FROM (
          SELECT P.topic_name, P.partition_index, E.n, P.known, P.leader, P.epoch, P.mark, P.replicas, P.isr, P.progress, P.targets, P.step, E.seq, E.metadata_offset, E.kind, E.goal, E.broker_id, E.z, E.ms,
                 E.leader_id AS e_leader, E.epoch AS e_epoch, E.replicas AS e_replicas, E.isr AS e_isr, E.targets AS e_targets,
                 coalesce(CASE WHEN E.kind = 'UpsertPartition' THEN true WHEN NOT P.known THEN false ELSE CASE E.kind
                   WHEN 'UpdatePartitionLeader' THEN E.epoch >= P.epoch AND NOT (E.leader_id = P.leader AND E.epoch = P.epoch)
                   WHEN 'UpdatePartitionReplication' THEN E.epoch >= P.epoch AND NOT (E.replicas = P.replicas AND E.isr = P.isr AND E.epoch = P.epoch)
                   WHEN 'UpdateReplicaProgress' THEN E.epoch = P.epoch AND len(list_filter(P.progress, lambda p: p.b = E.broker_id AND p.z = E.z AND p.ms = E.ms)) = 0
                   WHEN 'BeginPartitionReassignment' THEN len(E.targets) > 0 AND P.targets IS NULL
                   ELSE P.targets IS NOT NULL AND E.goal <> P.step AND CASE E.goal
                     WHEN 'ExpandingIsr' THEN len(list_filter(P.targets, lambda t: len(list_filter(P.progress, lambda p: p.b = t AND p.z >= P.mark)) = 0)) = 0
                     WHEN 'LeaderSwitch' THEN list_contains(P.isr, P.targets[1]) AND len(list_filter(P.progress, lambda p: p.b = P.targets[1] AND p.z >= P.mark)) > 0
                     WHEN 'Shrinking' THEN P.leader = P.targets[1] WHEN 'Complete' THEN P.leader = P.targets[1] ELSE true END END END, false) AS does
          FROM P JOIN E ON E.topic_name = P.topic_name AND E.partition_index = P.partition_index AND E.n = P.n + 1))))),
A AS (
  SELECT seq, metadata_offset, kind, topic_name, CAST(partition_index AS BIGINT) AS partition_index, changed, leader AS leader_id, epoch AS leader_epoch, mark AS high_watermark, array_to_string(replicas, ',') AS replicas, array_to_string(isr, ',') AS isr, step FROM P WHERE n > 0
  UNION ALL SELECT seq, metadata_offset, kind, NULL, NULL, controller_id <> lag(controller_id, 1, 0) OVER (ORDER BY seq), NULL, NULL, NULL, NULL, NULL, NULL FROM M WHERE kind = 'SetController'
  UNION ALL SELECT seq, metadata_offset, kind, NULL, NULL, (host || ':' || port) IS DISTINCT FROM lag(host || ':' || port) OVER (PARTITION BY broker_id ORDER BY seq), NULL, NULL, NULL, NULL, NULL, NULL FROM M WHERE kind = 'RegisterBroker')
"""


@query(_METADATA_SQL + "SELECT * FROM A")
def q_meta_fold(spark, sf):
    return plain(cluster.fold_metadata(metadata_events(spark, sf)))


@query(_METADATA_SQL + "SELECT topic_name, partition_index, seq, kind, changed, leader_id, leader_epoch, replicas, isr, step FROM A WHERE kind LIKE '%Reassignment'")
def q_reassignment(spark, sf):
    return plain(cluster.fold_metadata(metadata_events(spark, sf)).where("kind like '%Reassignment'"), "topic_name", "partition_index", "seq", "kind", "changed", "leader_id", "leader_epoch", "replicas", "isr", "step")


@query("""
WITH RECURSIVE E AS (
  SELECT user_id % 64 AS log_id, event_id AS seq, event_id // 600 AS term, 1 + CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 19 = 0 THEN (event_id // 600 + 1) % 3 ELSE event_id // 600 % 3 END AS leader_id, event_id // 150 - 1 AS previous,
         row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS n FROM events),
Q AS (
  SELECT log_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS term, CAST(NULL AS BIGINT) AS leader, CAST(-1 AS BIGINT) AS z, CAST(NULL AS BIGINT) AS seq, false AS accepted FROM (SELECT DISTINCT log_id FROM E)
  UNION ALL
  SELECT log_id, n, CASE WHEN heard THEN greatest(term, e_term) ELSE term END, CASE WHEN heard THEN leader_id ELSE leader END, CASE WHEN heard AND previous = z THEN z + 1 ELSE z END, seq, heard AND previous = z
  FROM (SELECT Q.log_id, E.n, Q.term, Q.leader, Q.z, E.seq, E.term AS e_term, E.leader_id, E.previous, E.leader_id <= 3 AND E.term >= Q.term AND NOT (E.term = Q.term AND coalesce(Q.leader <> E.leader_id, false)) AS heard
        FROM Q JOIN E ON E.log_id = Q.log_id AND E.n = Q.n + 1))
SELECT log_id, seq, accepted, term, z AS last_metadata_offset FROM Q WHERE n > 0
""")
def q_meta_cas(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i, term = F.col("event_id"), F.floor(F.col("event_id") / 600).cast("bigint")
    leader = 1 + F.when(i % 17 == 0, 3).when(i % 19 == 0, (term + 1) % 3).otherwise(term % 3)
    requests = e.select((F.col("user_id") % 64).alias("log_id"), i.alias("seq"), term.alias("term"), leader.cast("int").alias("leader_id"), (F.floor(i / 150) - 1).cast("bigint").alias("previous_offset"), F.lit(1).cast("bigint").alias("records"))
    return cluster.compare_and_append(requests, (1, 2, 3))


@query("""
WITH RECURSIVE E AS (
  SELECT user_id % 64 AS voter_id, event_id AS seq, event_id // 400 + user_id % 2 AS term, 1 + event_id % 4 AS candidate, event_id % 6 - 2 AS z, row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS n FROM events),
Q AS (
  SELECT voter_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS term, CAST(NULL AS BIGINT) AS chosen, CAST(NULL AS BIGINT) AS seq, false AS granted FROM (SELECT DISTINCT voter_id FROM E)
  UNION ALL
  SELECT voter_id, n, CASE WHEN heard THEN e_term ELSE term END, CASE WHEN gives THEN candidate WHEN heard AND e_term > term THEN NULL ELSE chosen END, seq, gives
  FROM (SELECT *, heard AND z >= -1 AND (e_term > term OR chosen IS NULL OR chosen = candidate) AS gives
        FROM (SELECT Q.voter_id, E.n, Q.term, Q.chosen, E.seq, E.term AS e_term, E.candidate, E.z, E.candidate <= 3 AND E.term >= Q.term AS heard FROM Q JOIN E ON E.voter_id = Q.voter_id AND E.n = Q.n + 1)))
SELECT voter_id, seq, granted, term, chosen AS voted_for FROM Q WHERE n > 0
""")
def q_vote_outcomes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    requests = e.select((u % 64).alias("voter_id"), i.alias("seq"), (F.floor(i / 400) + u % 2).cast("bigint").alias("term"), (1 + i % 4).cast("bigint").alias("candidate_id"), (i % 6 - 2).cast("bigint").alias("last_metadata_offset"))
    return cluster.vote_outcomes(requests, (1, 2, 3))
