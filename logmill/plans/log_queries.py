"""The log operators' queries over the log views, each beside the SQL that must give the same rows.

Every query takes all rows of its tables.  The tables hold a clean log, so some queries make the fault that their operator
is there to find: ``lossy`` is a log from which records were lost, ``retried`` one with records sent twice.  Where a condition names one partition or an offset, it is the read's own argument.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logmill.functions.headers import decode_headers, encode_headers
from logmill.operators import append, cluster, groups, scan, stats
from logmill.operators.scan import PARTITION
from logmill.sources.logview import EVENTS_SQL, ORDERS_SQL, dense_rank_in, events_log, orders_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
START, LIMIT = 100, 40
RECORD = ("topic", "partition", "offset", "timestamp_ms", "producer_id", "sequence", "key", "value")
_RECORD_SQL = 'topic, CAST(partition AS BIGINT) AS partition, "offset", timestamp_ms, producer_id, sequence, key, value'


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """``columns``, all where none are named, with whole numbers as bigint and bytes as text."""
    kinds = dict(df.dtypes)
    cast = {"int": "bigint", "smallint": "bigint", "binary": "string"}
    return df.select([F.col(f"`{c}`").cast(cast[kinds[c]]).alias(c) if kinds[c] in cast else F.col(f"`{c}`") for c in columns or df.columns])


def lossy(log: DataFrame) -> DataFrame:
    """The log after a fault that lost every 97th record."""
    return log.where("arrival % 97 <> 0")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- reads ---


@query(EVENTS_SQL + f"SELECT {_RECORD_SQL} FROM L WHERE topic = 'purchase' AND partition = 1 AND \"offset\" >= {START} ORDER BY \"offset\" LIMIT {LIMIT}")
def q_fetch_range(spark, sf):
    return plain(scan.fetch_range(events_log(spark, sf, sequences=True), "purchase", 1, START, LIMIT), *RECORD)


@query(EVENTS_SQL + f"""
, B AS (SELECT topic, partition, "offset" // 16 AS batch_id, max("offset") AS last_offset, sum(CAST("offset" >= {START} AS INTEGER)) AS visible FROM L GROUP BY ALL),
C AS (SELECT *, coalesce(sum(visible) OVER (PARTITION BY topic, partition ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM B WHERE last_offset >= {START})
SELECT L.topic, CAST(L.partition AS BIGINT) AS partition, L."offset", C.batch_id FROM L JOIN C ON L.topic = C.topic AND L.partition = C.partition AND L."offset" // 16 = C.batch_id WHERE C.before < {LIMIT}
""")
def q_fetch_batch_aligned(spark, sf):
    return plain(scan.fetch_batch_aligned(events_log(spark, sf), START, LIMIT), *PARTITION, "offset", "batch_id")


@query(EVENTS_SQL + f"""
SELECT * FROM (SELECT {_RECORD_SQL}, max("offset") OVER (PARTITION BY topic, partition) + 1 AS high_watermark FROM L)
WHERE topic = 'purchase' AND partition = 1 AND "offset" >= {START} ORDER BY "offset" LIMIT {LIMIT}
""")
def q_fetch_with_hw(spark, sf):
    return plain(scan.fetch_with_high_watermark(events_log(spark, sf, sequences=True), "purchase", 1, START, LIMIT), *RECORD, "high_watermark")


_REQUESTS = [("purchase", 0, 10), ("purchase", 1, 0), ("click", 2, 500), ("view", 1, 1 << 40), ("nowhere", 0, 0)]


@query(EVENTS_SQL + f"""
, R(topic, partition, fetch_offset) AS (VALUES {', '.join(f"('{t}', {p}, CAST({o} AS BIGINT))" for t, p, o in _REQUESTS)}),
N AS (SELECT L.*, R.fetch_offset, row_number() OVER (PARTITION BY L.topic, L.partition, R.fetch_offset ORDER BY "offset") AS rank FROM L JOIN R ON L.topic = R.topic AND L.partition = R.partition AND L."offset" >= R.fetch_offset)
SELECT {_RECORD_SQL}, fetch_offset FROM N WHERE rank <= 1000
""")
def q_fetch_multi(spark, sf):
    requests = literal(spark, _REQUESTS, "topic string, partition int, fetch_offset bigint")
    return plain(scan.fetch_multi(events_log(spark, sf, sequences=True), requests), *RECORD, "fetch_offset")


@query(EVENTS_SQL + f"""
SELECT topic, CAST(partition AS BIGINT) AS partition, greatest("offset", CAST(row_number() OVER (ORDER BY "offset") - 1 AS BIGINT)) AS "offset", timestamp_ms,
       CAST(-1 AS BIGINT) AS producer_id, CAST(-1 AS BIGINT) AS producer_epoch, key, value
FROM (SELECT * FROM L WHERE topic = 'purchase' AND partition = 1 AND "offset" >= {START} ORDER BY "offset" LIMIT {LIMIT})
""")
def q_fetch_projection(spark, sf):
    return plain(scan.encode_records(scan.fetch_range(events_log(spark, sf), "purchase", 1, START, LIMIT)))


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 AS log_end_offset FROM L GROUP BY ALL)
SELECT L.topic, CAST(L.partition AS BIGINT) AS partition, "offset", log_end_offset AS high_watermark, log_end_offset
FROM L JOIN E ON L.topic = E.topic AND L.partition = E.partition WHERE "offset" >= log_end_offset - 25
""")
def q_replica_fetch(spark, sf):
    return plain(scan.tail(events_log(spark, sf), 25).withColumn("high_watermark", F.col("log_end_offset")), *PARTITION, "offset", "high_watermark", "log_end_offset")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, min("offset") AS earliest_offset, arg_min(timestamp_ms, "offset") AS earliest_timestamp_ms,
       max("offset") + 1 AS latest_offset, CAST(0 AS BIGINT) AS latest_timestamp_ms FROM L GROUP BY ALL
""")
def q_list_offsets(spark, sf):
    return plain(scan.list_offsets(events_log(spark, sf)))


@query(EVENTS_SQL + """
, S(spec) AS (VALUES (CAST(-2 AS BIGINT)), (-1), (12345)),
O AS (SELECT topic, partition, min("offset") AS e, arg_min(timestamp_ms, "offset") AS t, max("offset") + 1 AS l FROM L GROUP BY ALL)
SELECT topic, CAST(partition AS BIGINT) AS partition, spec, CASE WHEN spec = -1 THEN l ELSE e END AS found_offset, CASE WHEN spec = -1 THEN 0 ELSE t END AS found_timestamp_ms FROM O, S
""")
def q_list_offsets_spec(spark, sf):
    return plain(scan.list_offsets_spec(events_log(spark, sf), literal(spark, [(-2,), (-1,), (12345,)], "spec bigint")))


_INDEX_SQL = """
, H AS (SELECT topic, partition, "offset" // {size} AS batch_id, min("offset") AS base_offset, max("offset") AS last_offset, max(timestamp_ms) AS max_timestamp_ms, count(*) AS records,
              sum(42 + 2 + coalesce(strlen(key), 0) + coalesce(strlen(value), 0)) + 32 AS bytes FROM L GROUP BY ALL),
I AS (SELECT *, coalesce(sum(bytes + 4) OVER (PARTITION BY topic, partition ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM H)
"""


@query(EVENTS_SQL + _INDEX_SQL.format(size=12) + f"SELECT topic, CAST(partition AS BIGINT) AS partition, max(base_offset) AS base_offset, CAST(arg_max(position, base_offset) AS BIGINT) AS position FROM I WHERE base_offset % 16 = 0 AND base_offset <= {START} GROUP BY ALL")
def q_index_lookup(spark, sf):
    index = scan.sparse_index(scan.rebuild_index(scan.with_batches(events_log(spark, sf), 12)))
    return plain(scan.index_lookup(index, START))


@query(EVENTS_SQL + _INDEX_SQL.format(size=12) + "SELECT topic, CAST(partition AS BIGINT) AS partition, batch_id, base_offset, last_offset FROM I WHERE base_offset % 16 = 0")
def q_sparse_index(spark, sf):
    return plain(scan.sparse_index(scan.batch_headers(scan.with_batches(events_log(spark, sf), 12))), *PARTITION, "batch_id", "base_offset", "last_offset")


@query(EVENTS_SQL + _INDEX_SQL.format(size=16) + "SELECT topic, CAST(partition AS BIGINT) AS partition, base_offset, CAST(bytes AS BIGINT) AS bytes, CAST(position AS BIGINT) AS position FROM I")
def q_rebuild_index(spark, sf):
    return plain(scan.rebuild_index(scan.with_batches(events_log(spark, sf))), *PARTITION, "base_offset", "bytes", "position")


@query(EVENTS_SQL + _INDEX_SQL.format(size=16) + "SELECT topic, CAST(partition AS BIGINT) AS partition, batch_id, base_offset, last_offset, max_timestamp_ms, records FROM I")
def q_batch_headers(spark, sf):
    return plain(scan.batch_headers(scan.with_batches(events_log(spark, sf))))


@query(ORDERS_SQL + _INDEX_SQL.format(size=16) + "SELECT topic, CAST(partition AS BIGINT) AS partition, batch_id, base_offset, last_offset, max_timestamp_ms, records FROM I")
def q_batch_headers_orders(spark, sf):
    return plain(scan.batch_headers(scan.with_batches(orders_log(spark, sf))))


@query(EVENTS_SQL + """
, N AS (SELECT topic, partition, "offset" FROM L WHERE "offset" < 100 + 10 * partition)
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset" // 16 AS batch_id, min("offset") AS base_offset, max("offset") AS last_offset, count(*) AS records FROM N GROUP BY ALL
""")
def q_truncate_log(spark, sf):
    log = events_log(spark, sf)
    bounds = scan.topic_metadata(log).withColumn("next_offset", (100 + 10 * F.col("partition")).cast("bigint"))
    return plain(scan.batch_headers(scan.with_batches(scan.truncate(log, bounds))), *PARTITION, "batch_id", "base_offset", "last_offset", "records")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset", arrival FROM (
  SELECT *, sum(CAST(arrival % 1009 = 0 AS INTEGER)) OVER (PARTITION BY topic, partition ORDER BY "offset") AS bad FROM L) WHERE bad = 0
""")
def q_recover_prefix(spark, sf):
    return plain(scan.valid_prefix(events_log(spark, sf), F.col("arrival") % 1009 == 0), *PARTITION, "offset", "arrival")


@query("""
SELECT section, max(seq) AS seq, arg_max(payload, seq) AS payload
FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'Topics' WHEN 1 THEN 'Offsets' ELSE 'Groups' END AS section, event_id AS seq, props AS payload FROM events)
WHERE section <> 'Groups' GROUP BY section
""")
def q_journal_replay(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = F.col("event_id") % 3
    entries = e.select(F.when(m == 0, "Topics").when(m == 1, "Offsets").otherwise("Groups").alias("section"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return cluster.last_entries(entries)


@query("""
WITH T AS (SELECT event_id AS line_no, event_id AS metadata_offset, event_type AS kind, event_id = (SELECT max(event_id) FROM events) - 3 AS broken FROM events)
SELECT line_no, metadata_offset, kind FROM T WHERE metadata_offset > 10 AND line_no < coalesce((SELECT min(line_no) FROM T WHERE broken), 1 << 62)
""")
def q_metadata_replay(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.to_json(F.struct(F.col("event_id").alias("metadata_offset"), F.col("event_type").alias("kind")))
    # a torn tail: a line near the end is cut
    torn = F.broadcast(e.agg((F.max("event_id") - 3).alias("torn")))
    lines = e.crossJoin(torn).select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") == F.col("torn"), F.substring(text, 1, 9)).otherwise(text).alias("text"))
    return cluster.replay_metadata(lines, 10, "metadata_offset bigint, kind string")


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 AS leo FROM L GROUP BY ALL)
SELECT L.topic, CAST(L.partition AS BIGINT) AS partition, "offset" FROM L JOIN E ON L.topic = E.topic AND L.partition = E.partition
WHERE CASE WHEN L.partition = 2 THEN L.topic < 'd' ELSE "offset" < leo - 1 END
""")
def q_visible_records(spark, sf):
    log = events_log(spark, sf)
    # partition 2 has no watermark yet: of the topics before "d" no replica has reported either
    bare = F.col("partition") == 2
    marks = scan.log_ends(log).select(*PARTITION, F.when(bare, 0).otherwise(F.col("log_end_offset") - 1).alias("high_watermark"), (~bare | (F.col("topic") >= "d")).alias("has_progress"))
    return plain(scan.visible(log, marks), *PARTITION, "offset")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, count(*) AS records FROM L WHERE topic <> 'view' AND partition = 0 GROUP BY ALL
""")
def q_leader_filter(spark, sf):
    log = events_log(spark, sf)
    leaders = scan.topic_metadata(log).where("topic <> 'view'").withColumn("leader_id", F.col("partition") + 1)
    return plain(scan.led_here(log, leaders, broker=1, voters=3).groupBy(*PARTITION).agg(F.count("*").alias("records")))


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, count(*) FILTER (value IS NULL) AS null_values, count(*) FILTER (key IS NULL) AS null_keys, count(*) AS records FROM L GROUP BY ALL
""")
def q_tombstones(spark, sf):
    return plain(scan.tombstones(events_log(spark, sf)))


def _with_headers(log: DataFrame) -> DataFrame:
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    return log.withColumn("headers", F.array(header("trace-id", F.col("arrival").cast("string")), header("empty", F.lit(None).cast("string"))))


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset",
       '[["trace-id",[' || array_to_string(list_transform(string_split(CAST(arrival AS VARCHAR), ''), lambda c: ascii(c)), ',') || ']],["empty",null]]' AS headers_json FROM L
""")
def q_header_encode(spark, sf):
    return plain(_with_headers(events_log(spark, sf)).withColumn("headers_json", encode_headers(F.col("headers"))), *PARTITION, "offset", "headers_json")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset", name, CASE WHEN name = 'trace-id' THEN CAST(arrival AS VARCHAR) END AS header_value
FROM L, (VALUES ('trace-id'), ('empty')) AS N(name) WHERE arrival % 7 <> 0
""")
def q_header_decode(spark, sf):
    log = _with_headers(events_log(spark, sf)).withColumn("json", F.when(F.col("arrival") % 7 != 0, encode_headers(F.col("headers"))).otherwise("not json"))
    h = log.select(*PARTITION, "offset", F.explode(decode_headers(F.col("json"))).alias("h"))
    return plain(h.select(*PARTITION, "offset", F.col("h.key").alias("name"), F.col("h.value").alias("header_value")))


@query(EVENTS_SQL + "SELECT DISTINCT topic, CAST(partition AS BIGINT) AS partition FROM L")
def q_topic_metadata(spark, sf):
    return plain(scan.topic_metadata(events_log(spark, sf)))


@query(EVENTS_SQL + "SELECT topic, CAST(partition AS BIGINT) AS partition, max(\"offset\") + 1 AS next_offset, CAST(0 AS BIGINT) AS log_start_offset, CAST(0 AS BIGINT) AS active_segment_base_offset FROM L GROUP BY ALL")
def q_topic_summary(spark, sf):
    return plain(scan.topic_summary(events_log(spark, sf)))


@query(EVENTS_SQL + """
, C AS (SELECT topic, count(DISTINCT partition) AS n FROM L GROUP BY topic)
SELECT R.topic, CASE WHEN n IS NULL THEN CAST(3 AS BIGINT) ELSE 0 END AS error_code, coalesce(n, 0) AS partitions
FROM (VALUES ('purchase'), ('click'), ('nowhere')) AS R(topic) LEFT JOIN C USING (topic)
""")
def q_metadata_lookup(spark, sf):
    return plain(scan.metadata_lookup(literal(spark, [("purchase",), ("click",), ("nowhere",)], "topic string"), scan.topic_metadata(events_log(spark, sf))))


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 AS leo FROM L GROUP BY ALL)
SELECT L.topic, CAST(L.partition AS BIGINT) AS partition, "offset", arrival FROM L JOIN E ON L.topic = E.topic AND L.partition = E.partition WHERE "offset" >= leo - 5
""")
def q_seek_tail(spark, sf):
    return plain(scan.tail(events_log(spark, sf), 5), *PARTITION, "offset", "arrival")



@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset", arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY "offset" DESC) AS k FROM L WHERE arrival % 97 <> 0) WHERE k <= 10
""")
def q_tail_k(spark, sf):
    return plain(scan.last_k(lossy(events_log(spark, sf)), 10), *PARTITION, "offset", "arrival")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset", previous_offset FROM (
  SELECT *, lag("offset") OVER (PARTITION BY topic, partition ORDER BY "offset") AS previous_offset FROM L WHERE arrival % 97 <> 0) WHERE "offset" <> previous_offset + 1
""")
def q_offset_gaps(spark, sf):
    return plain(scan.offset_gaps(lossy(events_log(spark, sf))), *PARTITION, "offset", "previous_offset")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, producer_id, sequence, previous_sequence FROM (
  SELECT *, lag(sequence) OVER (PARTITION BY topic, partition, producer_id ORDER BY arrival) AS previous_sequence FROM L WHERE arrival % 97 <> 0) WHERE sequence <> previous_sequence + 1
""")
def q_sequence_gaps(spark, sf):
    return plain(scan.sequence_gaps(lossy(events_log(spark, sf, sequences=True))), *PARTITION, "producer_id", "sequence", "previous_sequence")


# --- appends ---


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, count(*) AS n FROM L WHERE arrival % 2 = 0 GROUP BY ALL)
SELECT A.topic, CAST(A.partition AS BIGINT) AS partition, arrival, coalesce(n, 0) + row_number() OVER (PARTITION BY A.topic, A.partition ORDER BY arrival) - 1 AS "offset"
FROM L A LEFT JOIN E ON A.topic = E.topic AND A.partition = E.partition WHERE arrival % 2 = 1
""")
def q_append_offsets(spark, sf):
    log = events_log(spark, sf).drop("offset")
    old = dense_rank_in(log.where("arrival % 2 = 0"), PARTITION, "arrival", "offset")
    return plain(append.append_offsets(old, log.where("arrival % 2 = 1")), *PARTITION, "arrival", "offset")


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, producer_id, CAST(0 AS BIGINT) AS producer_epoch, arg_max(sequence, "offset") AS last_sequence, max("offset") AS last_offset FROM L GROUP BY ALL
""")
def q_producer_state(spark, sf):
    return plain(append.producer_state(events_log(spark, sf, sequences=True)))


@query("""
SELECT client, row_number() OVER (ORDER BY first_seen) AS producer_id, CAST(0 AS BIGINT) AS producer_epoch
FROM (SELECT CAST(user_id AS VARCHAR) AS client, min(event_id) AS first_seen FROM events GROUP BY 1)
""")
def q_producer_ids(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return plain(append.producer_ids(e.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("arrival"))))


@query("SELECT event_id % 3 AS partition, count(*) AS records FROM events GROUP BY 1")
def q_round_robin(spark, sf):
    return stats.round_robin(spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id"), 3)


def retried(spark, sf) -> DataFrame:
    """Every tenth record is sent again at once."""
    sent = F.col("arrival") * 2
    return events_log(spark, sf, sequences=True).withColumn("sent", F.explode(F.when(F.col("arrival") % 10 == 0, F.array(sent, sent + 1)).otherwise(F.array(sent))))


@query(EVENTS_SQL + """
, S AS (SELECT *, arrival * 2 AS sent FROM L UNION ALL SELECT *, arrival * 2 + 1 FROM L WHERE arrival % 10 = 0)
SELECT topic, CAST(partition AS BIGINT) AS partition, producer_id, sequence, sent FROM (
  SELECT *, lag(sequence) OVER (PARTITION BY topic, partition, producer_id ORDER BY sent) AS last FROM S) WHERE last IS NULL OR last <> sequence
""")
def q_dedup_retries(spark, sf):
    return plain(append.drop_retries(retried(spark, sf), "sent"), *PARTITION, "producer_id", "sequence", "sent")


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 - (10 + partition) AS log_end_offset FROM L GROUP BY topic, partition),
R AS (SELECT L.*, E.log_end_offset FROM L JOIN E ON L.topic = E.topic AND L.partition = E.partition WHERE "offset" >= E.log_end_offset - 3 + CASE WHEN L.topic = 'click' THEN 5 ELSE 0 END AND NOT (L.topic = 'purchase' AND "offset" = E.log_end_offset + 4)),
F AS (SELECT topic, partition, count(*) AS n, min("offset") AS a, max("offset") AS z FROM R WHERE "offset" >= log_end_offset GROUP BY ALL)
SELECT E.topic, CAST(E.partition AS BIGINT) AS partition, CASE WHEN a = log_end_offset AND z - a + 1 = n THEN n ELSE 0 END AS appended, coalesce(a, -1) AS first_offset,
       CASE WHEN a = log_end_offset AND z - a + 1 = n THEN z + 1 ELSE log_end_offset END AS log_end_offset,
       CASE WHEN n IS NULL THEN '' WHEN a <> log_end_offset THEN 'expected offset' WHEN z - a + 1 <> n THEN 'not contiguous' ELSE '' END AS error
FROM E LEFT JOIN F ON E.topic = F.topic AND E.partition = F.partition
""")
def q_replica_append(spark, sf):
    log = events_log(spark, sf)
    ends = scan.log_ends(log).withColumn("log_end_offset", F.col("log_end_offset") - (10 + F.col("partition")))
    sent = log.join(ends, [*PARTITION]).where(F.col("offset") >= F.col("log_end_offset") - 3 + F.when(F.col("topic") == "click", 5).otherwise(0))
    sent = sent.where(~((F.col("topic") == "purchase") & (F.col("offset") == F.col("log_end_offset") + 4))).drop("log_end_offset")
    return plain(append.replica_append(ends, sent))


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 AS leo FROM L GROUP BY ALL)
SELECT topic, CAST(partition AS BIGINT) AS partition, CASE WHEN topic = 'click' THEN leo - 10 ELSE leo - 4 END AS log_end_offset,
       least(leo - 6, CASE WHEN topic = 'click' THEN leo - 10 ELSE leo - 4 END) AS high_watermark, topic = 'click' AS mismatch FROM E
""")
def q_replica_apply_hw(spark, sf):
    log = events_log(spark, sf)
    leader = scan.log_ends(log)
    ends = leader.withColumn("log_end_offset", F.col("log_end_offset") - 10)
    shift = F.when(F.col("topic") == "click", 1).otherwise(0)
    sent = log.join(leader, [*PARTITION]).where((F.col("offset") >= F.col("log_end_offset") - 10 + shift) & (F.col("offset") < F.col("log_end_offset") - 4)).drop("log_end_offset")
    marks = leader.select(*PARTITION, (F.col("log_end_offset") - 6).alias("leader_high_watermark"))
    return plain(append.replica_apply(ends, sent, marks))


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, broker_id, least(max("offset") + 1, max("offset") + 1 + CASE broker_id WHEN 2 THEN -1 ELSE 5 END) AS log_end_offset
FROM L, (VALUES (CAST(2 AS BIGINT)), (3)) AS B(broker_id) GROUP BY topic, partition, broker_id
""")
def q_replica_progress(spark, sf):
    leader = scan.log_ends(events_log(spark, sf))
    own = leader.select(*PARTITION, F.col("log_end_offset").alias("leader_end"), F.explode(F.array(F.lit(2), F.lit(3))).alias("broker_id"))
    own = own.withColumn("log_end_offset", F.col("leader_end") + F.when(F.col("broker_id") == 2, -1).otherwise(5))
    return plain(cluster.follower_progress(own, leader))


@query(EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 AS leo FROM L GROUP BY ALL)
SELECT topic, CAST(partition AS BIGINT) AS partition, CAST(ceil((leo - least(leo, 7 * partition)) / 100.0) AS BIGINT) AS rounds, leo - least(leo, 7 * partition) AS copied, leo AS log_end_offset FROM E
""")
def q_replica_sync(spark, sf):
    log = events_log(spark, sf)
    followers = scan.topic_metadata(log).withColumn("log_end_offset", (7 * F.col("partition")).cast("bigint"))
    return plain(cluster.replica_sync(log, followers, 100))


# --- groups ---

_COMMITS_SQL = EVENTS_SQL + """
, M AS (SELECT 'g' || (producer_id % 4) AS group_id, topic, partition, "offset" + 1 AS next_offset, arrival AS commit_seq FROM L),
K AS (SELECT group_id, topic, partition, arg_max(next_offset, commit_seq) AS next_offset FROM M GROUP BY ALL),
E AS (SELECT topic, partition, max("offset") + 1 AS log_end_offset FROM L GROUP BY ALL)
"""


def commits(log: DataFrame) -> DataFrame:
    """Consumers that commit behind every record, as it comes."""
    return log.select(F.concat(F.lit("g"), F.col("producer_id") % 4).alias("group_id"), *PARTITION, (F.col("offset") + 1).alias("next_offset"), F.col("arrival").alias("commit_seq"))


@query(_COMMITS_SQL + "SELECT group_id, topic, CAST(partition AS BIGINT) AS partition, next_offset FROM K")
def q_committed_offsets(spark, sf):
    return plain(groups.committed_offsets(commits(events_log(spark, sf))))


@query(_COMMITS_SQL + "SELECT group_id, K.topic, CAST(K.partition AS BIGINT) AS partition, next_offset, log_end_offset, log_end_offset - next_offset AS lag FROM K JOIN E ON K.topic = E.topic AND K.partition = E.partition")
def q_consumer_lag(spark, sf):
    log = events_log(spark, sf)
    return plain(groups.consumer_lag(groups.committed_offsets(commits(log)), log))


@query(_COMMITS_SQL + 'SELECT group_id, L.topic, CAST(L.partition AS BIGINT) AS partition, "offset" FROM L JOIN K ON L.topic = K.topic AND L.partition = K.partition AND "offset" >= next_offset')
def q_consumer_resume(spark, sf):
    log = events_log(spark, sf)
    return plain(groups.consumer_resume(groups.committed_offsets(commits(log)), log), "group_id", *PARTITION, "offset")


@query(_COMMITS_SQL + """
, R AS (SELECT g AS group_id, t AS topic, p AS partition FROM (VALUES ('g0'), ('g9')) AS A(g), (VALUES ('click'), ('nowhere')) AS B(t), (VALUES (0), (1), (7)) AS C(p))
SELECT R.group_id, R.topic, CAST(R.partition AS BIGINT) AS partition, CASE WHEN E.topic IS NULL THEN -1 ELSE coalesce(K.next_offset, -1) END AS next_offset, CASE WHEN E.topic IS NULL THEN CAST(3 AS BIGINT) ELSE 0 END AS error_code
FROM R LEFT JOIN K ON R.group_id = K.group_id AND R.topic = K.topic AND R.partition = K.partition LEFT JOIN E ON R.topic = E.topic AND R.partition = E.partition
""")
def q_offset_fetch(spark, sf):
    log = events_log(spark, sf)
    requested = literal(spark, [(g, t, p) for g in ("g0", "g9") for t in ("click", "nowhere") for p in (0, 1, 7)], "group_id string, topic string, partition int")
    return plain(groups.offset_fetch(groups.committed_offsets(commits(log)), requested, log))


@query(EVENTS_SQL + """
, P AS (SELECT topic, partition, row_number() OVER (PARTITION BY topic ORDER BY partition) - 1 AS place, count(*) OVER (PARTITION BY topic) AS n FROM (SELECT DISTINCT topic, partition FROM L)),
M AS (SELECT topic, member_id, row_number() OVER (PARTITION BY topic ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY topic) AS k
      FROM (SELECT DISTINCT topic FROM P), (VALUES ('m-a'), ('m-b'), ('m-c')) AS V(member_id) WHERE member_id <> 'm-c' OR topic < 'm')
SELECT member_id, P.topic, CAST(partition AS BIGINT) AS partition FROM P JOIN M ON P.topic = M.topic AND place >= i * (n // k) + least(i, n % k) AND place < (i + 1) * (n // k) + least(i + 1, n % k)
""")
def q_range_assignor(spark, sf):
    log = scan.topic_metadata(events_log(spark, sf))
    members = log.select("topic").distinct().select("topic", F.explode(F.array(*map(F.lit, ("m-a", "m-b", "m-c")))).alias("member_id")).where("member_id <> 'm-c' or topic < 'm'")
    return plain(groups.range_assignor(members, log))


def _members(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.concat(F.lit("g"), F.col("user_id") % 4).alias("group_id"), F.concat(F.lit("m-"), "user_id").alias("member_id"), "event_id", "user_id", "ts")


_MEMBERS_SQL = "WITH M AS (SELECT DISTINCT 'g' || (user_id % 4) AS group_id, 'm-' || user_id AS member_id, user_id FROM events)"


@query(_MEMBERS_SQL + """
, A AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'g9' ELSE group_id END AS group_id, member_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'x' END AS assignment FROM M WHERE user_id % 3 <> 0)
SELECT group_id, member_id, 'unknown member' AS problem FROM A WHERE NOT EXISTS (SELECT 1 FROM M WHERE M.group_id = A.group_id AND M.member_id = A.member_id)
UNION ALL SELECT group_id, member_id, 'empty assignment' FROM A WHERE assignment = '' AND EXISTS (SELECT 1 FROM M WHERE M.group_id = A.group_id AND M.member_id = A.member_id)
UNION ALL SELECT group_id, member_id, 'no assignment' FROM M WHERE NOT EXISTS (SELECT 1 FROM A WHERE M.group_id = A.group_id AND M.member_id = A.member_id)
""")
def q_assignment_complete(spark, sf):
    m = _members(spark, sf).select("group_id", "member_id", "user_id").distinct()
    a = m.where("user_id % 3 <> 0").select(F.when(F.col("user_id") % 7 == 0, "g9").otherwise(F.col("group_id")).alias("group_id"), "member_id", F.when(F.col("user_id") % 5 == 0, "").otherwise("x").cast("binary").alias("assignment"))
    return groups.assignment_complete(m.select("group_id", "member_id"), a)


@query(_MEMBERS_SQL + "SELECT group_id, min(member_id) AS leader_member_id FROM M GROUP BY 1")
def q_group_leader(spark, sf):
    return groups.group_leader(_members(spark, sf))


@query("""
SELECT group_id, member_id, now_ms, gap_ms FROM (
  SELECT *, lead(now_ms) OVER (PARTITION BY group_id, member_id ORDER BY now_ms) - now_ms AS gap_ms
  FROM (SELECT 'g' || (user_id % 4) AS group_id, 'm-' || user_id AS member_id, epoch_us(ts) // 1000 AS now_ms FROM events)) WHERE gap_ms > 86400000
""")
def q_session_expiry(spark, sf):
    beats = _members(spark, sf).select("group_id", "member_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("now_ms"))
    return groups.session_expiry(beats, 86_400_000)


# --- cluster ---


def progress_of(log: DataFrame) -> DataFrame:
    """Brokers 1 to 3 at the end, one and five behind; of partition 2 broker 1 has yet to report."""
    ends = scan.log_ends(log).select(*PARTITION, F.explode(F.array(*[F.struct(F.lit(b).alias("broker_id"), (F.col("log_end_offset") - k).alias("log_end_offset")) for b, k in ((1, 0), (2, 1), (3, 5))])).alias("r"))
    return ends.select(*PARTITION, "r.*").where("partition <> 2 or broker_id <> 1")


_PROGRESS_SQL = EVENTS_SQL + """
, E AS (SELECT topic, partition, max("offset") + 1 AS leo FROM L GROUP BY ALL),
P AS (SELECT topic, partition, b AS broker_id, leo - k AS log_end_offset FROM E, (VALUES (1, 0), (2, 1), (3, 5)) AS B(b, k) WHERE partition <> 2 OR b <> 1)
"""


@query(_PROGRESS_SQL + """
, I AS (SELECT topic, partition, b AS broker_id FROM E, (VALUES (1), (2)) AS V(b) WHERE NOT (partition = 2 AND b = 2)),
M AS (SELECT I.topic, I.partition, min(log_end_offset) AS least FROM I JOIN P ON I.topic = P.topic AND I.partition = P.partition AND I.broker_id = P.broker_id GROUP BY ALL)
SELECT E.topic, CAST(E.partition AS BIGINT) AS partition, coalesce(least, 7) AS high_watermark FROM E LEFT JOIN M ON E.topic = M.topic AND E.partition = M.partition
""")
def q_high_watermark(spark, sf):
    log = events_log(spark, sf)
    catalog = scan.topic_metadata(log)
    isr = catalog.select(*PARTITION, F.explode(F.array(F.lit(1), F.lit(2))).alias("broker_id")).where("not (partition = 2 and broker_id = 2)")
    return plain(cluster.high_watermark(isr, progress_of(log), catalog.withColumn("high_watermark", F.lit(7).cast("bigint"))))


@query(_PROGRESS_SQL + "SELECT topic, CAST(partition AS BIGINT) AS partition, CASE WHEN partition = 2 THEN '1' ELSE '2,1' END AS isr FROM E")
def q_isr_reconcile(spark, sf):
    log = events_log(spark, sf)
    partitions = scan.topic_metadata(log).withColumn("leader_id", F.lit(1)).withColumn("replicas", F.array(F.lit(3), F.lit(2), F.lit(1)))
    return plain(cluster.isr_reconcile(partitions, progress_of(log)).withColumn("isr", F.concat_ws(",", "isr")))


@query(_PROGRESS_SQL + """
SELECT E.topic, CAST(E.partition AS BIGINT) AS partition, bool_and(coalesce(log_end_offset >= leo - 2, false)) AS caught_up
FROM E CROSS JOIN (VALUES (1), (2)) AS T(b) LEFT JOIN P ON E.topic = P.topic AND E.partition = P.partition AND T.b = P.broker_id GROUP BY ALL
""")
def q_caught_up(spark, sf):
    log = events_log(spark, sf)
    targets = scan.topic_metadata(log).select(*PARTITION, F.explode(F.array(F.lit(1), F.lit(2))).alias("broker_id"))
    marks = scan.log_ends(log).select(*PARTITION, (F.col("log_end_offset") - 2).alias("high_watermark"))
    return plain(cluster.caught_up(targets, progress_of(log), marks))


_SETS_SQL = """
WITH S AS (SELECT event_id, [event_id % 5, 5 + event_id % 4] AS a, [5 + event_id % 3, event_id % 2] AS b FROM events)
"""


def _sets(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    return e.select("event_id", F.array(i % 5, 5 + i % 4).alias("a"), F.array(5 + i % 3, i % 2).alias("b"))


@query(_SETS_SQL + "SELECT event_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS replicas FROM S")
def q_replica_union(spark, sf):
    return _sets(spark, sf).select("event_id", F.concat_ws(",", cluster.replica_union(F.col("a"), F.col("b")).cast("array<string>")).alias("replicas"))


@query(_SETS_SQL + "SELECT event_id, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS isr FROM S")
def q_isr_shrink(spark, sf):
    return _sets(spark, sf).select("event_id", F.concat_ws(",", cluster.isr_shrink(F.col("a"), F.col("b")).cast("array<string>")).alias("isr"))


@query(_PROGRESS_SQL + """
, R AS (SELECT t AS topic, p AS partition FROM (VALUES ('click'), ('view'), ('nowhere')) AS A(t), (VALUES (0), (2), (9)) AS B(p))
SELECT R.topic, CAST(R.partition AS BIGINT) AS partition, E.topic IS NOT NULL AS found, CASE WHEN E.topic IS NULL THEN CAST(-1 AS BIGINT) ELSE 1 END AS leader_id, CASE WHEN E.topic IS NULL THEN CAST(-1 AS BIGINT) ELSE 4 END AS leader_epoch,
       CASE WHEN E.topic IS NULL THEN -1 ELSE leo - 1 END AS high_watermark, CASE WHEN E.topic IS NULL THEN -1 ELSE coalesce(log_end_offset, 0) END AS leader_log_end_offset
FROM R LEFT JOIN E ON R.topic = E.topic AND R.partition = E.partition LEFT JOIN P ON P.topic = E.topic AND P.partition = E.partition AND P.broker_id = 1
""")
def q_partition_state(spark, sf):
    log = events_log(spark, sf)
    partitions = scan.log_ends(log).select(*PARTITION, F.lit(1).alias("leader_id"), F.lit(4).alias("leader_epoch"), (F.col("log_end_offset") - 1).alias("high_watermark"))
    requested = literal(spark, [(t, p) for t in ("click", "view", "nowhere") for p in (0, 2, 9)], "topic string, partition int")
    return plain(cluster.partition_state(requested, partitions, progress_of(log)))


@query(EVENTS_SQL + """
SELECT DISTINCT topic, CAST(partition AS BIGINT) AS partition, CASE WHEN partition = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS leader_id FROM L WHERE topic <> 'view'
""")
def q_merge_topic(spark, sf):
    store = scan.topic_metadata(events_log(spark, sf))
    image = store.where("partition = 0 and topic <> 'view'").withColumn("leader_id", F.lit(1).cast("bigint"))
    return plain(cluster.merge_topic(image, store))


@query("""
SELECT event_id // 10 AS term, sum(CAST(user_id % 3 = 0 AS INTEGER)) + 1 AS votes, sum(CAST(user_id % 3 = 0 AS INTEGER)) + 1 > 5 AS elected FROM events GROUP BY 1
""")
def q_election_majority(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return plain(cluster.election(e.select(F.floor(F.col("event_id") / 10).cast("bigint").alias("term"), (F.col("user_id") % 3 == 0).alias("granted")), 11))


@query("""
WITH E AS (SELECT user_id % 50 AS node_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
R AS (SELECT node_id, max(event_id // 1000) AS broker_epoch, arg_max(ms, event_id) AS registered_ms FROM E WHERE event_id % 7 = 0 GROUP BY 1),
B AS (SELECT R.node_id, max(ms) AS beat_ms FROM E JOIN R ON E.node_id = R.node_id AND E.event_id // 1000 = R.broker_epoch WHERE event_id % 7 <> 0 GROUP BY 1),
N AS (SELECT max(ms) AS now_ms FROM E)
SELECT R.node_id, broker_epoch, greatest(registered_ms, coalesce(beat_ms, registered_ms)) AS last_heartbeat_ms, now_ms - greatest(registered_ms, coalesce(beat_ms, registered_ms)) <= 3600000 AS alive
FROM R LEFT JOIN B ON R.node_id = B.node_id, N
""")
def q_broker_liveness(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 50).alias("node_id"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("timestamp_ms"))
    e = e.withColumn("epoch", F.floor(F.col("event_id") / 1000).cast("bigint"))
    # of several registrations in one epoch the last counts
    registrations = e.where("event_id % 7 = 0").groupBy("node_id", F.col("epoch").alias("broker_epoch")).agg(F.max_by("timestamp_ms", "event_id").alias("timestamp_ms"))
    beats = e.where("event_id % 7 <> 0").withColumnRenamed("epoch", "broker_epoch")
    now = e.agg(F.max("timestamp_ms").alias("now_ms"))
    alive = cluster.broker_liveness(registrations, beats, F.lit(0), 0).drop("alive").crossJoin(F.broadcast(now))
    return plain(alive.select("node_id", "broker_epoch", "last_heartbeat_ms", (F.col("now_ms") - F.col("last_heartbeat_ms") <= 3_600_000).alias("alive")))


@query("SELECT DISTINCT 'g' || (user_id % 4) AS key, CAST(0 AS BIGINT) AS error_code, CAST(1 AS BIGINT) AS node_id, 'localhost' AS host, CAST(9092 AS BIGINT) AS port FROM events")
def q_find_coordinator(spark, sf):
    return cluster.find_coordinator(_members(spark, sf).agg(F.collect_set("group_id").alias("keys")), 1, "localhost", 9092)


@query(EVENTS_SQL + "SELECT topic, CAST(sum(b) AS BIGINT) AS bytes, sum(n) AS records FROM (SELECT topic, partition, sum(coalesce(strlen(value), 0)) AS b, count(*) AS n FROM L GROUP BY ALL) GROUP BY topic")
def q_total_of_nodes(spark, sf):
    log = events_log(spark, sf)
    nodes = log.groupBy(*PARTITION).agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"), F.count("*").alias("records"))
    return stats.total_of_nodes(nodes, "topic", ["bytes", "records"])


# --- summaries ---


@query(EVENTS_SQL + """
, V AS (SELECT topic, metric, row_number() OVER (PARTITION BY topic ORDER BY metric) AS r, count(*) OVER (PARTITION BY topic) AS n FROM L WHERE metric IS NOT NULL)
SELECT topic, share, metric AS value FROM V, (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)) AS S(share) WHERE r = CAST(round((n - 1) * share) AS BIGINT) + 1
""")
def q_latency_percentiles(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("topic"), F.col("value").alias("metric"))
    return stats.nearest_rank(e, ["topic"], "metric", (0.5, 0.95, 0.99))


@query(EVENTS_SQL + "SELECT topic, count(*) AS records, round(count(*) / greatest((max(timestamp_ms) - min(timestamp_ms)) / 1000.0, 0.001), 6) AS per_second FROM L GROUP BY 1")
def q_throughput(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return stats.throughput(e.select(F.col("event_type").alias("topic"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("timestamp_ms")), ["topic"], "timestamp_ms")


@query(_COMMITS_SQL + """
SELECT (SELECT count(DISTINCT topic) FROM L) AS topics, (SELECT count(*) FROM E) AS partitions, (SELECT count(DISTINCT group_id) FROM K) AS groups, (SELECT count(*) FROM K) AS committed_offsets,
       (SELECT CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) FROM L) AS value_bytes
""")
def q_storage_summary(spark, sf):
    log = events_log(spark, sf)
    k = groups.committed_offsets(commits(log)).agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("committed_offsets"))
    p = log.groupBy(*PARTITION).agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes")).agg(F.count_distinct("topic").alias("topics"), F.count("*").alias("partitions"), F.sum("bytes").alias("value_bytes"))
    return p.crossJoin(k)


@query("""
WITH A AS (SELECT event_type AS scenario, count(*) AS figure FROM events WHERE event_type <> 'view' GROUP BY 1), B AS (SELECT event_type AS scenario, max(event_id) AS figure FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT coalesce(A.scenario, B.scenario) AS scenario, A.figure AS before, B.figure AS after, CASE WHEN A.figure IS NULL OR B.figure IS NULL THEN 'missing in one report' ELSE '' END AS note
FROM A FULL JOIN B ON A.scenario = B.scenario
""")
def q_bench_compare(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "scenario")
    a = e.where("scenario <> 'view'").groupBy("scenario").agg(F.count("*").alias("figure"))
    return stats.bench_compare(a, e.where("scenario <> 'click'").groupBy("scenario").agg(F.max("event_id").alias("figure")))


_APIS = [
    ("ApiVersions", 18, 0, 3), ("Metadata", 3, 1, 12), ("InitProducerId", 22, 0, 4), ("Produce", 0, 3, 9), ("Fetch", 1, 4, 11), ("ListOffsets", 2, 1, 7), ("FindCoordinator", 10, 0, 4),
    ("JoinGroup", 11, 0, 5), ("SyncGroup", 14, 0, 5), ("Heartbeat", 12, 0, 4), ("LeaveGroup", 13, 0, 4), ("OffsetCommit", 8, 0, 7), ("OffsetFetch", 9, 1, 7),
]


@query(f"SELECT name, CAST(k AS BIGINT) AS api_key, CAST(a AS BIGINT) AS min_version, CAST(b AS BIGINT) AS max_version FROM (VALUES {', '.join(map(str, _APIS))}) AS T(name, k, a, b)")
def q_api_versions(spark, sf):
    return literal(spark, _APIS, "name string, api_key bigint, min_version bigint, max_version bigint")


@query(EVENTS_SQL + "SELECT topic, CAST(partition AS BIGINT) AS partition, \"offset\", arrival FROM L")
def q_stream_tail(spark, sf):
    from logmill.streaming.tail import tail_events

    return plain(tail_events(spark, sf), *PARTITION, "offset", "arrival")
