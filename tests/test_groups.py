import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from logmill.operators import folds, groups
from logmill.operators.groups import Group


def join(g, member, now, topics=("t",), session=1000, rebalance=5000):
    return g.join("g", member, "consumer", "range", topics, session, rebalance, now)


def test_generations_follow_changes_only():
    g = Group()
    join(g, "a", 100)
    assert (g.generation, g.leader) == (1, "a")
    join(g, "a", 110)
    assert g.generation == 1  # the same again
    join(g, "a", 120, session=2000)
    assert g.generation == 2
    join(g, "b", 130)
    assert (g.generation, g.leader) == (3, "a")
    g.leave("nobody")
    assert g.generation == 3
    g.leave("a")
    assert (g.generation, g.leader) == (4, "b")


def test_a_member_without_an_id_gets_one():
    assert Group().join("readers", "", "consumer", "range", ("t",), 10, 10, 77) == "readers-member-77" == Group().join("readers", None, "consumer", "range", ("t",), 10, 10, 77)


def test_expired_members_go_at_the_next_join():
    g = Group()
    join(g, "a", 100, session=10)
    join(g, "b", 200, session=10)
    assert list(g.members) == ["b"]
    assert g.sync("b", g.generation, {}, {"t": [0, 1]}, 200) == (0, [("t", 0), ("t", 1)])
    assert g.heartbeat("a", g.generation, 200) == 25


def test_heartbeats_keep_members_and_check_generations():
    g = Group()
    join(g, "a", 100, session=10)
    assert g.heartbeat("a", 1, 108) == 0 and g.heartbeat("a", 2, 109) == 22 and g.heartbeat("x", 1, 109) == 25
    join(g, "b", 117, session=10)
    assert set(g.members) == {"a", "b"}


def test_commits():
    g = Group()
    assert g.commit("a", 0) == 25
    join(g, "a", 100)
    join(g, "b", 100)
    assert [g.commit("a", k) for k in (g.generation, g.generation - 1, g.generation + 1)] == [0, 0, 22] and g.commit("c", 1) == 25


def test_sync_errors():
    g = Group()
    assert g.sync("a", 1, {}, {}, 0)[0] == 22
    join(g, "a", 100)
    join(g, "b", 100)
    assert g.sync("x", 2, {}, {}, 100)[0] == 25 and g.sync("a", 1, {}, {}, 100)[0] == 25 and g.sync("a", 3, {}, {}, 100)[0] == 22
    assert g.sync("a", 2, {"a": b"x"}, {}, 100)[0] == 25  # b has none
    assert g.sync("b", 2, {}, {"t": [0]}, 100)[0] == 25  # the leader's attempt failed
    assert g.sync("a", 2, {"a": b"x", "b": b""}, {}, 100)[0] == 25 and g.sync("a", 2, {"a": b"x", "b": b"y", "c": b"z"}, {}, 100)[0] == 25
    assert g.sync("a", 2, {"a": b"x", "b": b"y"}, {}, 100) == (0, b"x") and g.sync("b", 2, {}, {}, 100) == (0, b"y")


def test_server_side_assignment():
    g = Group()
    for m in ("b", "a"):
        join(g, m, 100)
    assert g.sync("b", 2, {}, {"t": [0, 1, 2]}, 100) == (0, [("t", 2)]) and g.sync("a", 2, {}, {"t": [0, 1, 2]}, 100) == (0, [("t", 0), ("t", 1)])


class Counted(str):
    """An id that counts how often it is looked at."""

    seen = 0

    def __hash__(self):
        Counted.seen += 1
        return str.__hash__(self)

    def __lt__(self, other):
        Counted.seen += 1
        return str.__lt__(self, other)


def test_an_event_does_not_go_over_all_members():
    g, events = Group(), 0
    Counted.seen = 0
    for k in range(600):
        m = Counted(f"m{k * 7919 % 600:04}")
        join(g, m, k, ("t", "u"), session=100_000)
        assert g.sync(m, g.generation, {}, {"t": [0, 1, 2], "u": [0]}, k)[0] == 0
        assert g.heartbeat(m, g.generation, k + 1) == 0
        assert g.leader == min(g.members) if k % 100 == 0 else True
        events += 3
    assert len(g.members) == 600 and {k for k, m in g.members.items() if m.assignment} == {"m0000", "m0001", "m0002"}
    for k in range(0, 600, 2):
        g.leave(Counted(f"m{k:04}"))
        events += 1
    assert g.leader == "m0001" and Counted.seen < 100 * events


def test_beats_leave_nothing_behind_and_clocks_may_go_back():
    g = Group()
    join(g, "a", 0, session=10)
    join(g, "b", 0, session=10)
    for now in [*range(1, 1000), 500, *range(500, 1000)]:
        assert g.heartbeat("a", g.generation, now) == 0
    assert len(g.deadlines) < 50
    join(g, "c", 20, session=10)  # "b" was last heard at 0
    assert set(g.members) == {"a", "c"}
    assert g.heartbeat("a", g.generation, 5) == 0
    join(g, "c", 16, session=10)
    assert set(g.members) == {"c"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("tu")), min_size=1, max_size=8), st.integers(0, 9))
def test_assignment_splits_evenly_and_agrees_with_the_fold(spark, subscriptions, n):
    members = spark.createDataFrame(subscriptions, "member_id string, topic string")
    partitions = spark.createDataFrame([("t", p) for p in range(n)], "topic string, partition int")
    got = {}
    for r in groups.range_assignor(members, partitions).collect():
        got.setdefault(r.member_id, []).append((r.topic, r.partition))
    g = Group()
    for m in {m for m, _ in subscriptions}:
        join(g, m, 0, tuple(t for k, t in subscriptions if k == m))
    g.build({"t": list(range(n))})
    assert {k: sorted(v) for k, v in got.items()} == {k: m.assignment for k, m in g.members.items() if m.assignment}
    sizes = [len(m.assignment) for m in g.members.values() if "t" in m.topics]
    assert not sizes or (sum(sizes) == n and max(sizes) - min(sizes) <= 1)


def test_committed_offsets_may_go_back(spark):
    commits = spark.createDataFrame([("g", "t", 1, 11, 1), ("g", "t", 2, 30, 2), ("g", "t", 2, 22, 3)], "group_id string, topic string, partition int, next_offset bigint, commit_seq bigint")
    committed = groups.committed_offsets(commits)
    assert sorted((r.partition, r.next_offset) for r in committed.collect()) == [(1, 11), (2, 22)]
    catalog = spark.createDataFrame([("t", p) for p in range(3)], "topic string, partition int")
    requested = spark.createDataFrame([("g", "t", p) for p in range(4)], "group_id string, topic string, partition int")
    assert sorted((r.partition, r.next_offset, r.error_code) for r in groups.offset_fetch(committed, requested, catalog).collect()) == [(0, -1, 0), (1, 11, 0), (2, 22, 0), (3, -1, 3)]


def test_resume_and_lag(spark):
    log = spark.createDataFrame([("t", 0, o) for o in range(3)], "topic string, partition int, offset bigint")
    committed = spark.createDataFrame([("g", "t", 0, 2)], "group_id string, topic string, partition int, next_offset bigint")
    assert [r.offset for r in groups.consumer_resume(committed, log).collect()] == [2]
    assert [r.lag for r in groups.consumer_lag(committed, log).collect()] == [1]


def test_stored_keys(spark):
    texts = ["g:t:3", "g:t", "g", "", "g:t:x", "g:a:b:3", "g:t:99999999999", "g:t:-2", ":", "g::+4", "g:t:3\n", "ü:é:1"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = [tuple(r.k) if r.k else None for r in df.select(groups.parse_key(F.col("text")).alias("k")).collect()]
    assert got[:-1] == [("g", "t", 3), ("g", "t", 0), ("g", "", 0), ("", "", 0), ("g", "t", 0), ("g", "a", 0), ("g", "t", 0), ("g", "t", -2), ("", "", 0), ("g", "", 4), ("g", "t", 0), ("ü", "é", 1)]
    assert got[-1] == (None, None, 0)
    one = spark.createDataFrame([("g", "t", 5)], "g string, t string, p int").select(groups.render_key(F.col("g"), F.col("t"), F.col("p")).alias("k")).collect()
    assert one[0].k == "g:t:5"
    keys = spark.createDataFrame([("t:0:7",), ("a:b:12:-1",), ("t:0",), ("t:x:1",), ("t:0:x",), (None,)], "text string")
    found = [tuple(r.k) if r.k else None for r in keys.select(groups.parse_producer_key(F.col("text")).alias("k")).collect()]
    assert found == [("t", 0, 7), ("a:b", 12, -1), None, None, None, None]


def test_columns_are_converted_as_arrow_does():
    rows = [{"i": None if k % 3 == 0 else k, "n": 2**62 + k, "s": None if k % 4 == 0 else f"ü{k}", "b": None if k % 5 == 0 else b"\xff" * k, "l": None if k % 7 == 0 else [None, "x"][: k % 3], "x": [k, None], "f": None if k % 2 else k / 3, "t": k % 2 == 0,
             "m": None if k % 5 == 1 else [("a", b"1"), ("b", None)][: k % 3]} for k in range(50)]
    kinds = pa.schema({"i": pa.int32(), "n": pa.int64(), "s": pa.string(), "b": pa.binary(), "l": pa.list_(pa.string()), "x": pa.list_(pa.int32()), "f": pa.float64(), "t": pa.bool_(), "m": pa.map_(pa.string(), pa.binary())})
    whole = pa.RecordBatch.from_pylist(rows, schema=kinds)
    for b in (whole, whole.slice(3, 20), whole.slice(50), whole.slice(0, 1)):
        for name, column in zip(b.schema.names, b.columns):
            got = folds.values_of(column)
            assert got == column.to_pylist() and [type(x) for x in got] == [type(x) for x in column.to_pylist()], name


def test_one_group_over_many_arrow_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ops = ["join", "sync", "heartbeat", "commit", "leave"]
    rows = [(f"g{k % 3 if k % 5 else 0}", k, 10 * k, ops[k % 5], f"m{k % 4}", k // 9, "consumer", "range", ["t"], 200, 60, None) for k in range(400)]
    kinds = "group_id string, seq bigint, now_ms bigint, op string, member_id string, generation_id int, protocol_type string, protocol_name string, topics array<string>, session_timeout_ms int, rebalance_timeout_ms int, assignments map<string,binary>"
    events, partitions = spark.createDataFrame(rows, kinds).repartition(5), {"t": [0, 1]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((r.group_id, r.seq, r.generation_id, r.error_code, r.members, r.assignment) for r in groups.fold_groups(events, partitions).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    names = [c.split()[0] for c in kinds.split(", ")]
    state, expected = {}, []
    for r in sorted(rows, key=lambda r: r[1]):
        e = dict(zip(names, r))
        out = state.setdefault(e["group_id"], Group()).step(e, partitions)
        expected.append((e["group_id"], e["seq"], out["generation_id"], out["error_code"], out["members"], out["assignment"]))
    assert got == sorted(expected)
