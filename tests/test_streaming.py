import pytest
from pyspark.sql import functions as F

from logmill.operators import append, groups
from logmill.streaming import stateful, tail

BATCH = "topic string, partition int, batch bigint, producer_id bigint, producer_epoch int, first_sequence bigint, last_sequence bigint, records bigint"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start(f"{tmp_path}/{name}")
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def in_files(spark, rows, kinds, tmp_path, parts=3):
    """``rows`` in as many files, read one by one as a stream."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_producers_as_a_stream_agree_with_the_batch_form(spark, rocks, tmp_path):
    rows = [("t", p, k, (None if k == 7 else -1) if k % 13 == 7 else k % 3, 0 if k < 20 else k % 2, k // 6 + (k % 11 == 0), k // 6 + (k % 11 == 0), 1) for k, p in enumerate([0, 1] * 15)]
    got = run(stateful.produce_stream(in_files(spark, rows, BATCH, tmp_path), 2), tmp_path, "out")
    expected = append.produce_outcomes(spark.createDataFrame(rows, BATCH), 2)
    assert sorted((r.batch, r.error_code) for r in got.collect()) == sorted((r.batch, r.error_code) for r in expected.collect())
    assert len({r.error_code for r in got.collect()}) >= 3


def test_groups_as_a_stream_agree_with_the_batch_form(spark, rocks, tmp_path):
    ops = ["join", "join", "sync", "heartbeat", "commit", "join", "sync", "leave", "heartbeat", "commit"]
    kinds = "group_id string, seq bigint, now_ms bigint, op string, member_id string, generation_id int, protocol_type string, protocol_name string, topics array<string>, session_timeout_ms int, rebalance_timeout_ms int, assignments map<string,binary>"
    rows = [(f"g{k % 2}", k, 100 + 7 * k, ops[k // 2 % 10], f"m{k // 2 % 3}", 1 + k // 10, "consumer", "range", ["t"], 60, 60, None) for k in range(60)]
    got = run(stateful.group_stream(in_files(spark, rows, kinds, tmp_path), {"t": [0, 1, 2]}), tmp_path, "out")
    expected = groups.fold_groups(spark.createDataFrame(rows, kinds), {"t": [0, 1, 2]})
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(got) == key(expected)


def test_appending_resumes_without_loss_or_repeats(spark, tmp_path):
    kinds = "topic string, partition int, arrival bigint"
    rows = [("t", k % 2, k) for k in range(20)]
    stream = in_files(spark, rows[:10], kinds, tmp_path, 2)
    tail.append_stream(stream, "arrival", f"{tmp_path}/log", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 10
    spark.createDataFrame(rows[10:], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tail.append_stream(again, "arrival", f"{tmp_path}/log", f"{tmp_path}/check")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r.partition, r.offset, r.arrival) for r in log.collect()) == [(p, o, 2 * o + p) for p in (0, 1) for o in range(10)]
    # the last micro-batch run again gives the same folder
    last = log.agg(F.max("batch")).collect()[0][0]
    assert last == 2
    ends = spark.read.parquet(f"{tmp_path}/log.ends/batch=2")
    assert sorted(map(tuple, ends.select("topic", "partition", "log_end_offset").collect())) == [("t", 0, 10), ("t", 1, 10)]


class _Elsewhere:
    """A session on a cluster that names no shared folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, *_):
        return None

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, place):
        self.place = place


def test_only_a_local_session_gets_a_folder_of_its_own():
    assert tail.work_dir(_Elsewhere("local[2]"))
    for master in ("local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            tail.work_dir(_Elsewhere(master))
