import pytest

from logmill.functions.codec import Record
from logmill.operators import stats
from logmill.sources import segments, table


@pytest.fixture
def root(spark, tmp_path):
    segments.register(spark)
    for t, p, n in (("a", 0, 50), ("a", 1, 3), ("b", 0, 7)):
        segments.write_segment(str(tmp_path), t, p, [[Record(o, 1000 + o, key=None if o % 5 == 0 else b"k", value=b"v%d" % o)] for o in range(n)])
    (tmp_path / "topics/a/partitions/junk").mkdir()
    with open(tmp_path / "topics/a/partitions/1" / f"{segments.SEGMENT}.log", "ab") as f:
        f.write(b"partial-tail")
    return str(tmp_path)


def load(spark, root):
    return spark.read.format("log_segments").load(root)


def test_batch_read_and_pruning(spark, root):
    df = load(spark, root)
    assert sorted((r.topic, r.partition, r.n) for r in df.groupBy("topic", "partition").count().withColumnRenamed("count", "n").collect()) == [("a", 0, 50), ("a", 1, 3), ("b", 0, 7)]
    some = df.where("topic = 'a' and partition = 0 and offset >= 47")
    assert [(r.offset, bytes(r.value)) for r in some.orderBy("offset").collect()] == [(47, b"v47"), (48, b"v48"), (49, b"v49")]
    assert some.rdd.getNumPartitions() == 1
    assert df.where("topic = 'nowhere'").count() == 0 and df.where("key is null").count() == 10 + 1 + 2


def test_splits_begin_at_index_entries_and_cover_every_record_once(spark, tmp_path):
    root = str(tmp_path)
    segments.register(spark)
    segments.write_segment(root, "a", 0, [[Record(8 * b + k, b, value=b"v" * (b % 50)) for k in range(8)] for b in range(200)])
    segments.write_segment(root, "b", 1, [[Record(k, k)] for k in range(3)])
    for size in (1, 700, 5_000, 1 << 30):
        df = spark.read.format("log_segments").option("splitBytes", size).load(root)
        assert sorted((r.topic, r.offset) for r in df.collect()) == [("a", o) for o in range(1600)] + [("b", o) for o in range(3)]
        assert sorted(r.offset for r in df.where("topic = 'a' and offset > 1234").collect()) == list(range(1235, 1600))
    assert spark.read.format("log_segments").option("splitBytes", 700).load(root).rdd.getNumPartitions() > 20
    files, base = segments.storage(root)
    folder = f"{base}/topics/a/partitions/0"
    assert segments.end_of(files, folder) == 1600
    index = segments.Index(files, folder)
    assert index.entries == 100 and [index.position(o) for o in (0, 15)] == [0, 0] and index.position(16) == index[1][1] and index.position(10**9) == index[99][1]
    for start, end in ((0, 10), (17, 18), (500, 901), (1599, 1600)):
        got = [r for s in segments.splits(files, "a", 0, folder, start, end, 300) for b in segments.read_split(root, s) for r in b.column("offset").to_pylist()]
        assert got == list(range(start, end))


def test_small_splits_of_a_large_log_do_not_grow_with_it(spark, tmp_path):
    root = str(tmp_path)
    segments.register(spark)
    segments.write_segment(root, "a", 0, [[Record(16 * b + k, b) for k in range(16)] for b in range(3 * segments.SPLITS)])
    segments.write_segment(root, "a", 1, [[Record(16 * b + k, b) for k in range(16)] for b in range(40)])
    assert spark.read.format("log_segments").option("splitBytes", 1).load(root).rdd.getNumPartitions() <= segments.SPLITS + 2
    wanted = [(*p, start, end) for p, (start, end) in zip(segments.folders(root), ((70, 40_000), (0, None)))]
    found = segments.plan(root, wanted, 1)
    assert 500 < len(found) <= segments.SPLITS + 2
    got = [r for s in found for b in segments.read_split(root, s) for r in zip(b.column("partition").to_pylist(), b.column("offset").to_pylist())]
    assert got == [(0, o) for o in range(70, 40_000)] + [(1, o) for o in range(640)]


def test_a_log_is_written_byte_by_byte_as_its_batches_are(spark, tmp_path):
    records = {p: [Record(o, 5_000 - o * (o % 3), o % 4 - 1, o % 2, o, None if o % 5 == 0 else b"k" * (o % 9), None if o % 7 == 0 else b"\xff" * (o % 50), b"[]") for o in range(3 * p, 300, 1 + p)] for p in range(4)}
    log = spark.createDataFrame([("t", p, r.offset, r.timestamp_ms, r.producer_id, r.producer_epoch, r.sequence, r.key, r.value, "[]") for p, rs in records.items() for r in rs], segments.SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        segments.write_log(log.repartition(3), str(tmp_path / "log"), 16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for p, rs in records.items():
        segments.write_segment(str(tmp_path / "one"), "t", p, [[r for r in rs if r.offset // 16 == b] for b in range(19) if any(r.offset // 16 == b for r in rs)])
        for kind in ("log", "index", "timeindex"):
            place = f"topics/t/partitions/{p}/{segments.SEGMENT}.{kind}"
            assert (tmp_path / "log" / place).read_bytes() == (tmp_path / "one" / place).read_bytes(), place


def test_a_log_is_written_as_segments(spark, tmp_path):
    segments.register(spark)
    root = str(tmp_path / "root")
    rows = [("t", p, o, 100 + o, None, 0, o, None if o % 7 == 0 else b"k", b"" if o % 3 else None, None if o % 2 else '[["h",null]]') for p in (0, 1) for o in range(3, 60)]
    log = spark.createDataFrame(rows, segments.SCHEMA)
    for _ in range(2):  # writing again replaces
        done = {(r.topic, r.partition): (r.records, r.batches, r.bytes) for r in segments.write_log(log, root).collect()}
    assert {k: v[:2] for k, v in done.items()} == {("t", 0): (57, 4), ("t", 1): (57, 4)}
    got = sorted((r.partition, r.offset, r.timestamp_ms, r.producer_id, r.sequence, None if r.key is None else bytes(r.key), None if r.value is None else bytes(r.value), r.headers) for r in load(spark, root).collect())
    assert got == sorted((p, o, t, -1, q, k, v, h or "[]") for _, p, o, t, _, _, q, k, v, h in rows)
    entries = sorted((r.partition, r.first, r.second) for r in segments.read_index(spark, root).collect())
    assert [(p, o) for p, o, _ in entries] == [(p, o) for p in (0, 1) for o in (16, 32, 48)]
    assert segments.write_log(log.limit(0), root).count() == 0


def test_stream_reads_what_is_new(spark, root, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = spark.readStream.format("log_segments").load(root).writeStream.format("parquet").option("checkpointLocation", check).trigger(processingTime="1 second").start(out)
        q.processAllAvailable()
        q.stop()

    run()
    assert spark.read.parquet(out).count() == 60
    segments.write_segment(root, "b", 0, [[Record(7, 1), Record(8, 1)]])
    run()
    assert spark.read.parquet(out).count() == 62 and spark.read.parquet(out).distinct().count() == 62


def test_stored_log_is_pruned_and_truncated(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", 0, o) for o in range(100)] + [("a", 1, o) for o in range(10)] + [("b", 0, 0)]
    table.write_log(spark.createDataFrame(rows, "topic string, partition int, offset bigint"), path, files_per_partition=2)
    some = table.read_log(spark, path).where("topic = 'a' and partition = 0 and offset >= 98")
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(offset,98)" in plan and "PartitionFilters: [isnotnull(topic" in plan
    assert some.count() == 2
    table.truncate_stored(spark, path, "a", 0, 5)
    assert sorted((r.topic, r.partition, r.n) for r in table.read_log(spark, path).groupBy("topic", "partition").count().withColumnRenamed("count", "n").collect()) == [("a", 0, 5), ("a", 1, 10), ("b", 0, 1)]


def test_truncating_to_nothing_and_leaving_no_trace(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a b/c", 0, o) for o in range(10)] + [("a b/c", 1, 0), ("d", 0, 0)]
    table.write_log(spark.createDataFrame(rows, "topic string, partition int, offset bigint"), path)
    table.truncate_stored(spark, path, "a b/c", 0, 0)
    assert sorted((r.topic, r.partition) for r in table.read_log(spark, path).collect()) == [("a b/c", 1), ("d", 0)]
    table.truncate_stored(spark, path, "d", 0, 5)
    table.truncate_stored(spark, path, "nowhere", 7, 0)
    assert table.read_log(spark, path).count() == 2 and [x.name for x in tmp_path.iterdir()] == ["log"]


def test_storage_summary_of_files(spark, root):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/topics").select("path", "length")
    got = stats.storage_summary(files).collect()[0]
    assert got.log_bytes > 0 and got.index_bytes == got.timeindex_bytes == 16 * (4 + 1 + 1) and got.total_bytes == got.log_bytes + got.index_bytes + got.timeindex_bytes


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1.0)], "scenario string, seconds double")
    for kind in ("json", "csv"):
        table.write_report(rows, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).collect()[0].seconds == 1.0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    table.write_report(rows, str(tmp_path / "md"), "md")
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| scenario | seconds |", "|---|---|", "| s | 1.0 |"]
    with pytest.raises(ValueError):
        table.write_report(rows, str(tmp_path / "x"), "xml")
