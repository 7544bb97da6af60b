import pytest

from logmill.operators import cluster
from logmill.operators.cluster import Image, PartitionImage, Quorum


def image():
    p = PartitionImage(1, 1, 5, [1, 2], [1, 2])
    p.progress = {1: (6, 0), 2: (5, 0)}
    return p


def test_a_lagging_replica_leaves_the_set():
    p = image()
    assert p.report(1, 2, 1, 9) and (p.isr, p.high_watermark) == ([1], 6)
    assert not p.report(1, 2, 1, 9)
    assert not p.report(0, 2, 6, 9) and not p.report(2, 2, 6, 9)
    assert p.report(1, 2, 5, 10) and (p.isr, p.high_watermark) == ([1, 2], 5)  # one behind is in sync; the watermark may fall


def test_leader_updates():
    p = image()
    assert not p.lead(3, 0) and not p.lead(1, 1)
    assert p.lead(3, 2) and p.replicas == [3, 1, 2] and p.isr == [3, 1, 2]


def test_replication_updates_keep_the_watermark():
    p = image()
    assert p.replicate([1, 2, 3], [1, 2], 2) and p.high_watermark == 5 and not p.replicate([1, 2, 3], [1, 2], 2) and not p.replicate([1], [1], 1)


def test_reassignment_needs_caught_up_targets():
    p = image()
    assert not p.begin([]) and p.begin([3, 1]) and not p.begin([2])
    assert not any(p.advance(s) for s in ("Planned", "ExpandingIsr", "LeaderSwitch", "Shrinking", "Complete"))
    p.report(1, 3, 6, 1)
    assert p.advance("ExpandingIsr") and p.replicas == [1, 2, 3] and p.isr == [1, 2, 3]
    assert not p.advance("ExpandingIsr") and not p.advance("Shrinking")
    assert p.advance("LeaderSwitch") and (p.leader_id, p.leader_epoch) == (3, 2)
    assert p.advance("Shrinking") and (p.replicas, p.isr) == ([3, 1], [1, 3])
    assert p.advance("Complete") and p.targets is None and not p.advance("Complete")


def test_a_leader_without_a_report_stands_alone():
    p = PartitionImage(1, 0, 7, [1, 2], [1, 2])
    assert p.report(0, 2, 9, 0) and p.isr == [1] and p.high_watermark == 7


def test_every_record_advances_the_offset():
    i, e = Image(), {"topic_name": None, "partition_index": 0, "controller_id": 2, "broker_id": 1, "host": "h", "port": 1}
    assert i.apply(e | {"kind": "SetController"}) and not i.apply(e | {"kind": "SetController"})
    assert i.apply(e | {"kind": "RegisterBroker"}) and not i.apply(e | {"kind": "CompletePartitionReassignment", "topic_name": "x"})
    assert i.offset == 3
    with pytest.raises(ValueError):
        i.apply(e | {"kind": "Nonsense", "topic_name": "x", "partition_index": 0} | {"x": i.partitions.setdefault(("x", 0), PartitionImage())})


def test_compare_and_append():
    q = Quorum(frozenset((1, 2)))
    assert q.append(1, 1, -1, 1) and not q.append(1, 1, -1, 1) and q.offset == 0
    assert not q.append(1, 2, 0, 1) and not q.append(0, 1, 0, 1) and not q.append(2, 9, 0, 1)
    assert q.append(2, 2, 0, 3) and (q.offset, q.term, q.leader) == (3, 2, 2)


def test_votes():
    q = Quorum(frozenset((1, 2, 3)), offset=4)
    assert not q.vote(1, 9, 9) and not q.vote(1, 2, 3) and q.vote(1, 2, 4) and q.vote(1, 2, 5) and not q.vote(1, 3, 5) and q.vote(2, 3, 4) and not q.vote(1, 2, 9)


def test_batch_forms_agree_with_the_fold(spark):
    kinds = "topic string, partition int, broker_id int, log_end_offset bigint"
    for ends in ({1: 6, 2: 5, 3: 1}, {2: 5}, {}, {1: 3, 2: 9}):
        p = PartitionImage(1, 0, 7, [3, 2, 1], [1, 2])
        for b, e in ends.items():
            p.report(0, b, e, 0)
        progress = spark.createDataFrame([("t", 0, b, e) for b, e in ends.items()], kinds)
        one = spark.createDataFrame([("t", 0, 1, [3, 2, 1])], "topic string, partition int, leader_id int, replicas array<int>")
        isr = cluster.isr_reconcile(one, progress).collect()[0].isr
        assert isr == (p.isr if ends else [1])
        members = spark.createDataFrame([("t", 0, b) for b in isr], "topic string, partition int, broker_id int")
        mark = cluster.high_watermark(members, progress, spark.createDataFrame([("t", 0, 7)], "topic string, partition int, high_watermark bigint")).collect()[0].high_watermark
        assert mark == min((ends[b] for b in isr if b in ends), default=7)


def test_merge_adds_missing_partitions_of_known_topics(spark):
    image_ = spark.createDataFrame([("t", 0, 5)], "topic string, partition int, leader_id bigint")
    store = spark.createDataFrame([("t", 2), ("t", 1), ("t", 0), ("u", 0)], "topic string, partition int")
    assert sorted((r.topic, r.partition, r.leader_id) for r in cluster.merge_topic(image_, store).collect()) == [("t", 0, 5), ("t", 1, 0), ("t", 2, 0)]


def test_metadata_log_stops_at_the_first_bad_line(spark):
    lines = spark.createDataFrame([(0, '{"metadata_offset": 0, "kind": "a"}'), (1, '{"metadata_offset": 1, "kind": "b"}'), (2, '{"metada'), (3, '{"metadata_offset": 3, "kind": "c"}')], "line_no bigint, text string")
    assert [r.kind for r in cluster.replay_metadata(lines, 0, "metadata_offset bigint, kind string").collect()] == ["b"]


def test_repeated_targets_are_added_once():
    p = image()
    p.report(1, 4, 9, 1)
    assert p.begin([2, 2, 4, 2, 4]) and p.advance("ExpandingIsr") and p.replicas == [1, 2, 4] and p.isr == [1, 2, 4]


def test_repeated_reports(spark):
    kinds = "topic string, partition int, broker_id int, log_end_offset bigint, at bigint"
    progress = spark.createDataFrame([("t", 0, 1, 6, 1), ("t", 0, 2, 6, 1), ("t", 0, 2, 1, 2), ("t", 0, 2, 6, 0)], kinds)
    one = spark.createDataFrame([("t", 0, 1, [1, 2])], "topic string, partition int, leader_id int, replicas array<int>")
    assert cluster.isr_reconcile(one, progress, order="at").collect()[0].isr == [1] and cluster.isr_reconcile(one, progress).collect()[0].isr == [1, 2]
    both = spark.createDataFrame([("t", 0, 1), ("t", 0, 2)], "topic string, partition int, broker_id int")
    mark = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, high_watermark bigint")
    assert cluster.high_watermark(both, progress, mark, order="at").collect()[0].high_watermark == 1 and cluster.high_watermark(both, progress, mark).collect()[0].high_watermark == 6
    assert [cluster.caught_up(both, progress, mark, order=o).collect()[0].caught_up for o in ("at", None)] == [False, True]


def test_every_record_of_a_log_has_an_offset(spark):
    from logmill.schema import META_EVENT

    names = [c.split()[0] for c in META_EVENT.replace(", ", ",").split(",")]
    record = lambda seq, kind, **more: tuple(({"seq": seq, "kind": kind} | more).get(n) for n in names)
    rows = [
        record(5, "SetController", controller_id=2), record(7, "SetController", controller_id=2), record(11, "RegisterBroker", broker_id=1, host="h", port=1), record(12, "RegisterBroker", broker_id=2, host="h", port=1),
        record(13, "RegisterBroker", broker_id=1, host="h", port=1), record(14, "RegisterBroker", broker_id=1, host="h", port=2), record(20, "UpdatePartitionLeader", topic_name="t", partition_index=0, leader_id=1, leader_epoch=0),
        record(21, "UpsertPartition", topic_name="t", partition_index=0, leader_id=1, leader_epoch=0, replicas=[1], isr=[1]), record(22, "UpdatePartitionLeader", topic_name="t", partition_index=0, leader_id=3, leader_epoch=1),
        record(30, "SetController", controller_id=1),
    ]
    got = sorted((r.metadata_offset, r.seq, r.changed, r.replicas) for r in cluster.fold_metadata(spark.createDataFrame(rows, META_EVENT)).collect())
    assert got == [(0, 5, True, None), (1, 7, False, None), (2, 11, True, None), (3, 12, True, None), (4, 13, False, None), (5, 14, True, None), (6, 20, False, ""), (7, 21, True, "1"), (8, 22, True, "3,1"), (9, 30, True, None)]
    assert cluster.fold_metadata(spark.createDataFrame([], META_EVENT)).count() == 0


def test_votes_and_appends_of_many_logs_are_those_of_one_voter_each(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(3), k, k // 20 + rng.randrange(2), rng.randrange(1, 5), rng.randrange(-2, 3)) for k in range(300)]
    votes = cluster.vote_outcomes(spark.createDataFrame(rows, "voter_id bigint, seq bigint, term bigint, candidate_id bigint, last_metadata_offset bigint"), (1, 2, 3)).collect()
    voters = {}
    expected = {}
    for v, k, term, candidate, end in rows:
        q = voters.setdefault(v, Quorum(frozenset((1, 2, 3))))
        expected[k] = (v, q.vote(term, candidate, end), q.term, q.voted_for)
    assert {r.seq: (r.voter_id, r.granted, r.term, r.voted_for) for r in votes} == expected


def test_topics_are_made_when_asked_for(spark):
    from logmill.operators import scan

    catalog = spark.createDataFrame([("known", 0)], "topic string, partition int")
    asked = spark.createDataFrame([("known", 2), ("new", 1), ("new", 9), ("far", 2), ("below", -1), (None, 0)], "topic string, partition int")
    made = sorted((r.topic, r.partition) for r in scan.auto_created(catalog, asked, 2).collect())
    assert made == [("known", 0), ("new", 0), ("new", 1)]
    names = spark.createDataFrame([("known",), ("x",)], "topic string")
    assert sorted(map(tuple, scan.metadata_lookup(names, catalog, create_partitions=3).collect())) == [("known", 0, 1), ("x", 0, 3)]
    assert sorted(map(tuple, scan.metadata_lookup(names, catalog).collect())) == [("known", 0, 1), ("x", 3, 0)]
    assert scan.auto_created(catalog, asked, 0).count() == 1
