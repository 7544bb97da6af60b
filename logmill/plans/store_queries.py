"""Queries that write what a broker stores and read it again: segments, indexes, journals, metadata logs, reports; and its settings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.functions import codec, properties
from logmill.operators import cluster, groups, stats
from logmill.operators.scan import PARTITION
from logmill.plans.log_queries import _INDEX_SQL, plain, query
from logmill.sources import segments, state_store, table
from logmill.sources.logview import EVENTS_SQL, events_log
from logmill.streaming.tail import work_dir


def _written(spark, sf, batch: int = 16) -> str:
    """The folder to which the log of ``events`` was written as segments."""
    root = f"{work_dir(spark)}/segments"
    # a row a partition, which tells that its file stands
    segments.write_log(events_log(spark, sf, sequences=True), root, batch).collect()
    return root


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset", timestamp_ms, producer_id, CAST(producer_epoch AS BIGINT) AS producer_epoch, sequence, key, value, '[]' AS headers FROM L
""")
def q_segment_read(spark, sf):
    segments.register(spark)
    return plain(spark.read.format("log_segments").load(_written(spark, sf)))


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, "offset", key, value FROM L WHERE topic = 'purchase' AND partition = 1 AND "offset" >= 70
""")
def q_segment_range(spark, sf):
    segments.register(spark)
    rows = spark.read.format("log_segments").option("splitBytes", 4096).load(_written(spark, sf))
    return plain(rows.where("topic = 'purchase' and partition = 1 and offset >= 70"), *PARTITION, "offset", "key", "value")


@query(EVENTS_SQL + _INDEX_SQL.format(size=12) + "SELECT topic, CAST(partition AS BIGINT) AS partition, base_offset, CAST(position AS BIGINT) AS position, max_timestamp_ms FROM I WHERE base_offset % 16 = 0")
def q_segment_index(spark, sf):
    root = _written(spark, sf, 12)
    index = segments.read_index(spark, root).select(*PARTITION, F.col("first").alias("base_offset"), F.col("second").alias("position"))
    times = segments.read_index(spark, root, "timeindex").select(*PARTITION, F.col("second").alias("base_offset"), F.col("first").alias("max_timestamp_ms"))
    return plain(index.join(times, [*PARTITION, "base_offset"]), *PARTITION, "base_offset", "position", "max_timestamp_ms")


@query(EVENTS_SQL + _INDEX_SQL.format(size=12) + """
SELECT CAST(sum(bytes + 4) AS BIGINT) AS log_bytes, count(*) FILTER (base_offset % 16 = 0) * 16 AS index_bytes, count(*) FILTER (base_offset % 16 = 0) * 16 AS timeindex_bytes, CAST(0 AS BIGINT) AS journal_bytes,
       CAST(sum(bytes + 4) AS BIGINT) + count(*) FILTER (base_offset % 16 = 0) * 32 AS total_bytes FROM I
""")
def q_segment_storage(spark, sf):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{_written(spark, sf, 12)}/topics").select("path", "length")
    return stats.storage_summary(files)


@query(EVENTS_SQL + """
SELECT topic, CAST(partition AS BIGINT) AS partition, count(*) AS records, max("offset") AS last_offset FROM L
WHERE NOT (topic = 'purchase' AND partition = 1) AND NOT (topic = 'click' AND partition = 0 AND "offset" >= 50) GROUP BY ALL
""")
def q_truncate_stored(spark, sf):
    path = f"{work_dir(spark)}/log"
    table.write_log(events_log(spark, sf), path)
    table.truncate_stored(spark, path, "purchase", 1, 0)
    table.truncate_stored(spark, path, "click", 0, 50)
    return plain(table.read_log(spark, path).groupBy(*PARTITION).agg(F.count("*").alias("records"), F.max("offset").alias("last_offset")))


def _journals(spark, sf) -> DataFrame:
    """A thousand events are a journal."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.floor(F.col("event_id") / 1000).cast("bigint").alias("journal"), F.col("event_id").alias("seq"), "event_type", "props")


@query("""
SELECT event_id // 1000 AS journal, CASE event_id % 3 WHEN 0 THEN 'Topics' ELSE 'Offsets' END AS section, arg_max(props, event_id) AS payload
FROM events WHERE event_id % 3 <> 2 AND event_id % 1000 <> 999 GROUP BY ALL
""")
def q_journal_write(spark, sf):
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        data = b"".join(codec.encode_journal_entry({"section": ("Topics", "Offsets", "Groups")[s % 3], "payload": p}) for s, p in zip(frame.seq, frame.props) if s % 1000 != 999)
        torn = codec.encode_journal_entry({"section": "Topics", "payload": "torn"})[:-3]
        state = codec.replay_journal(data + torn)
        return pd.DataFrame({"journal": frame.journal.iloc[0], "section": list(state), "payload": list(state.values())})

    return _journals(spark, sf).groupBy("journal").applyInPandas(each, "journal bigint, section string, payload string")


@query("""
SELECT event_id // 1000 AS journal, event_id % 1000 AS metadata_offset, event_type AS record FROM events WHERE event_id % 1000 BETWEEN 500 AND 998
""")
def q_metadata_write(spark, sf):
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        lines = b"".join(codec.encode_metadata_line(s % 1000, kind) for s, kind in zip(frame.seq, frame.event_type) if s % 1000 != 999)
        # a snapshot has the first 500; the last line is torn
        found, valid = codec.replay_metadata_log(lines + codec.encode_metadata_line(999, "torn")[:-4], 499)
        if valid != len(lines):
            raise AssertionError("the valid prefix is what was written whole")
        return pd.DataFrame({"journal": frame.journal.iloc[0], "metadata_offset": [r["metadata_offset"] for r in found], "record": [r["record"] for r in found]})

    return _journals(spark, sf).groupBy("journal").applyInPandas(each, "journal bigint, metadata_offset bigint, record string")


@query("""
WITH S AS (SELECT event_type AS scenario, count(*) AS records, max(user_id) AS most FROM events GROUP BY 1)
SELECT 'json' AS kind, scenario, records, most FROM S UNION ALL SELECT 'csv', scenario, records, most FROM S UNION ALL SELECT 'md', scenario, records, most FROM S
""")
def q_reports(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("scenario")).agg(F.count("*").alias("records"), F.max("user_id").alias("most"))
    place = work_dir(spark)
    for kind in ("json", "csv", "md"):
        table.write_report(rows, f"{place}/{kind}", kind)
    schema = "scenario string, records bigint, most bigint"
    cells = F.split(F.col("value"), r" *\| *")
    md = spark.read.text(f"{place}/md").where("value not like '|--%' and value not like '| scenario |%'").select(cells[1].alias("scenario"), cells[2].cast("bigint").alias("records"), cells[3].cast("bigint").alias("most"))
    found = {"json": spark.read.schema(schema).json(f"{place}/json"), "csv": spark.read.schema("scenario string, records bigint, most bigint").option("header", True).csv(f"{place}/csv"), "md": md}
    out = [df.select(F.lit(k).alias("kind"), "scenario", "records", "most") for k, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
WITH T AS (SELECT event_id AS id, event_id % 6 AS v, user_id AS u FROM events)
SELECT id, CASE WHEN v IN (0, 3) THEN u END AS node_id, CASE v WHEN 0 THEN 1 + id % 3 WHEN 3 THEN 1 END AS partitions, CASE v WHEN 0 THEN '/d' WHEN 3 THEN 'data' END AS log_dir,
       CASE v WHEN 0 THEN 'PLAIN=0.0.0.0:9092, SSL=h:9093' WHEN 3 THEN 'PLAINTEXT=127.0.0.1:9092' END AS listeners, CASE v WHEN 0 THEN '' WHEN 3 THEN '1=a:1, 2=b:2' END AS voters,
       CASE v WHEN 0 THEN 'broker,controller' WHEN 3 THEN 'controller' END AS roles,
       CASE v WHEN 1 THEN 'num.partitions must be at least 1' WHEN 2 THEN 'log.dirs must name one directory' WHEN 4 THEN 'line 2 is no key=value' WHEN 5 THEN 'a listener needs host:port, not ''h:99999''' END AS error FROM T
""")
def q_server_properties(spark, sf):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    variants = [
        say("# a comment\n\n node.id = ", u, "\nnum.partitions=", 1 + i % 3, "\nlog.dirs=/d\nlisteners=plain://:9092, ssl://h:9093\n"), say("node.id=", u, "\nnum.partitions=0"), say("log.dirs=/a,/b\nnode.id=", u),
        say("node.id=-5\ncontroller.quorum.voters=1@a:1,2@b:2\nprocess.roles=controller\nnode.id=", u), say("node.id=", u, "\nno value"), say("listeners=plain://h:99999\nnode.id=", u),
    ]
    return properties.load_all(spark.read.parquet(f"{sf}/events.parquet").select(i.alias("id"), F.element_at(F.array(*variants), (i % 6 + 1).cast("int")).alias("text")))


@query("""
WITH T AS (SELECT event_id, event_id % 4 AS voters, 1 + user_id % 3 AS me, CASE WHEN event_id % 5 <> 0 THEN 1 + event_id % 3 END AS leader, user_id % 4 IN (0, 1) AS controls FROM events)
SELECT event_id, voters = 0 OR (controls AND coalesce(leader = me, false)) AS may_write, CASE WHEN controls THEN voters <= 1 OR coalesce(leader = me, false) ELSE voters = 0 END AS may_create FROM T
""")
def q_write_authority(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    voters = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (i % 4).cast("int"))
    roles = F.element_at(F.array(F.array(F.lit("controller")), F.array(F.lit("broker"), F.lit("controller")), F.array(F.lit("broker")), F.array().cast("array<string>")), (u % 4 + 1).cast("int"))
    writes, creates = cluster.authority(voters, 1 + u % 3, F.when(i % 5 != 0, 1 + i % 3), roles)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", writes.alias("may_write"), creates.alias("may_create"))


@query("SELECT event_id AS id, event_id % 5 < 3 AS accepted, least(event_id % 5 + 1, 3) AS attempts FROM events")
def q_append_retries(spark, sf):
    return state_store.retry_outcomes(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("refused")))


_KEYS = ["'g' || user_id || ':' || event_type || ':' || event_id % 7", "'g' || user_id || ':' || event_type", "'g' || user_id", "'g:' || event_type || ':x'", "'g:' || event_type || ':a:' || event_id % 7", "'::+' || event_id % 7", "event_type || ':x:' || event_id % 7 || ':' || user_id", "'g:t:99999999999'"]


@query(f"""
WITH T AS (SELECT event_id, CASE event_id % 8 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(_KEYS))} END AS text FROM events), S AS (SELECT *, string_split(text, ':') AS s FROM T)
SELECT event_id, s[1] AS group_id, coalesce(s[2], '') AS topic, CAST(coalesce(TRY_CAST(array_to_string(s[3:], ':') AS INTEGER), 0) AS BIGINT) AS partition,
       CASE WHEN regexp_full_match(text, '.*:[0-9]{{1,9}}:-?[0-9]{{1,18}}') THEN CAST(s[len(s)] AS BIGINT) END AS producer_id,
       CASE WHEN regexp_full_match(text, '.*:[0-9]{{1,9}}:-?[0-9]{{1,18}}') THEN array_to_string(s[:len(s) - 2], ':') END AS producer_topic FROM S
""")
def q_stored_keys(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.expr("CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_KEYS)) + " END")
    parsed = e.select("event_id", groups.parse_key(text).alias("k"), groups.parse_producer_key(text).alias("p"))
    return plain(parsed.select("event_id", "k.group_id", "k.topic", "k.partition", "p.producer_id", F.col("p.topic").alias("producer_topic")))
