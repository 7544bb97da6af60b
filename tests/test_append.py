import random

import pytest

from logmill.operators import append, cluster
from logmill.operators.append import ProducerSession

BATCH = "topic string, partition int, batch bigint, producer_id bigint, producer_epoch int, first_sequence bigint, last_sequence bigint, records bigint"


def outcomes(spark, batches, next_id=10, **more):
    rows = [("t", 0, k, *b) for k, b in enumerate(batches)]
    got = append.produce_outcomes(spark.createDataFrame(rows, BATCH), next_id, **more).collect()
    return [(r.error_code, r.base_offset, r.last_offset) for r in sorted(got, key=lambda r: r.batch)]


@pytest.mark.parametrize(
    "batches, expected",
    [
        ([(1, 0, 0, 0, 1)], [(0, 0, 0)]),
        ([(1, 0, 0, 1, 2), (1, 0, 0, 1, 2)], [(0, 0, 1), (0, 0, 1)]),  # a retry has the stored offsets
        ([(-1, -1, 0, 0, 1), (-1, -1, 0, 0, 1)], [(0, 0, 0), (0, 1, 1)]),  # not idempotent
        ([(None, None, None, None, 1), (1, 0, 3, 3, 1)], [(0, 0, 0), (0, 1, 1)]),
        ([(1, 1, 0, 0, 1), (1, 0, 1, 1, 1)], [(0, 0, 0), (47, -1, -1)]),  # fenced
        ([(10, 0, 0, 0, 1)], [(59, -1, -1)]),  # never handed out
        ([(1, 0, 0, 0, 1), (1, 0, 2, 2, 1), (1, 0, 1, 1, 1)], [(0, 0, 0), (45, -1, -1), (0, 1, 1)]),  # a refused batch leaves no trace
        ([(1, 0, 0, 0, 1), (1, 0, 1, 1, 1), (1, 0, 0, 0, 1)], [(0, 0, 0), (0, 1, 1), (45, -1, -1)]),  # only the last batch is remembered
        ([(1, 0, 0, 0, 1), (1, 1, 77, 77, 1)], [(0, 0, 0), (0, 1, 1)]),  # a new epoch begins anywhere
        ([(1, 0, 0, 0, 1), (2, 0, 0, 4, 5), (1, 0, 1, 2, 2)], [(0, 0, 0), (0, 1, 5), (0, 6, 7)]),
        ([(1, 0, 0, 0, 0), (1, 0, 5, 5, 1)], [(0, 0, 0)]),  # empty batches are ignored
    ],
)
def test_outcomes(spark, batches, expected):
    assert outcomes(spark, batches) == expected


def simulate(rows, next_id):
    """The broker's way: one batch after another, with the state of each partition."""
    end, last, out = {}, {}, []
    for topic, partition, batch, pid, epoch, first, seq, n in sorted(rows, key=lambda r: r[2]):
        if n <= 0:
            continue
        place, key = (topic, partition), (topic, partition, pid)
        state = last.get(key) if pid >= 0 else None
        code, base = 0, None
        if pid >= next_id:
            code = 59
        elif state and epoch < state[0]:
            code = 47
        elif state and epoch == state[0]:
            if (first, seq) == state[1:3]:
                base = state[3]
            elif first != state[2] + 1:
                code = 45
        if code:
            out.append((batch, code, -1, -1))
            continue
        if base is None:
            base = (end.get(place, 0), end.get(place, 0) + n - 1)
            end[place] = base[1] + 1
            if pid >= 0:
                last[key] = (epoch, first, seq, base)
        out.append((batch, 0, *base))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_against_a_sequential_broker(spark, seed):
    rng = random.Random(seed)
    rows, at = [], {}
    for k in range(400):
        place = ("t", rng.randrange(2), rng.choice((-1, 0, 1, 2, 9)))
        n, first = rng.randrange(0, 4), at.get(place, 0) + rng.choice((0, 0, 0, 0, 1))
        if rng.random() < 0.2 and rows and rows[-1][7]:
            rows.append((*rows[-1][:2], k, *rows[-1][3:]))
            continue
        rows.append((*place[:2], k, place[2], rng.choice((0, 0, 0, 0, 0, 1)) if k > 200 else 0, first, first + max(n, 1) - 1, n))
        at[place] = first + max(n, 1)
    got = append.produce_outcomes(spark.createDataFrame(rows, BATCH), 5).collect()
    expected = simulate(rows, 5)
    assert sorted((r.batch, r.error_code, r.base_offset, r.last_offset) for r in got) == expected
    assert {c for _, c, *_ in expected} == {0, 45, 47, 59}


def test_leaders_decide_first(spark):
    leaders = lambda b: spark.createDataFrame([("t", 0, b)], "topic string, partition int, leader_id int")
    assert outcomes(spark, [(1, 0, 0, 0, 1)], leaders=leaders(1)) == [(0, 0, 0)]
    assert outcomes(spark, [(1, 0, 0, 0, 1)], leaders=leaders(2)) == [(6, -1, -1)]
    assert outcomes(spark, [(1, 0, 0, 0, 1)], leaders=leaders(1).limit(0)) == [(3, -1, -1)]


def test_no_batches(spark):
    assert append.produce_outcomes(spark.createDataFrame([], BATCH), 1).count() == 0


def test_a_producer_spans_frames():
    import pandas as pd

    columns = ["topic", "partition", "producer_id", "producer_epoch", "first_sequence", "last_sequence", "batch"]
    frames = [pd.DataFrame([("t", 0, 1, 0, 0, 0, 0)], columns=columns), pd.DataFrame([("t", 0, 1, 0, 0, 0, 1), ("t", 0, 2, 0, 0, 0, 2)], columns=columns)]
    assert [r for f in append.fold_sessions(frames, 5) for r in f.repeated] == [False, True, False]


def test_frames_of_any_size_are_folded_as_row_by_row():
    import random

    import pandas as pd

    columns = ["topic", "partition", "producer_id", "producer_epoch", "first_sequence", "last_sequence", "batch"]
    rng = random.Random(4)
    for trial in range(200):
        rows, batch = [], 0
        for producer in range(rng.randrange(1, 6)):
            at, epoch = 0, 0
            for _ in range(rng.randrange(1, 12)):
                what = rng.random()
                size = rng.randrange(1, 4)
                if what < 0.15 and rows:
                    rows.append((*rows[-1][:6], batch))  # a retry, perhaps of another producer's batch
                elif what < 0.25:
                    rows.append(("t", 0, producer, epoch - 1, at, at + size - 1, batch))
                elif what < 0.35:
                    rows.append(("t", 0, producer, epoch, at + 2, at + 1 + size, batch))
                else:
                    if what > 0.9:
                        epoch += 1
                    rows.append(("t", 0, producer, epoch, at, at + size - 1, batch))
                    at += size
                batch += 1
        rows.sort(key=lambda r: (r[2], r[6]))
        expected, key, session = [], None, None
        for t, p, producer, epoch, first, last, batch in rows:
            if (t, p, producer) != key:
                key, session = (t, p, producer), ProducerSession()
            code, repeats = session.offer(producer, 4, epoch, first, last, batch)
            expected.append((code, repeats is not None))
        frames, k = [], 0
        while k < len(rows):
            size = rng.randrange(1, 9)
            frames.append(pd.DataFrame(rows[k : k + size], columns=columns))
            k += size
        got = [(int(c), bool(r)) for f in append.fold_sessions(frames, 4) for c, r in zip(f.error_code, f.repeated)]
        assert got == expected, trial


def test_session_ids():
    s = ProducerSession()
    assert s.offer(0, 1, 0, 5, 5, 1) == (0, None) and s.offer(0, 1, 0, 5, 5, 2) == (0, 1)


ENDS = "topic string, partition int, log_end_offset bigint"
ROWS = "topic string, partition int, offset bigint"


@pytest.mark.parametrize(
    "end, sent, expected",
    [(1, [0], (0, 1, "")), (1, [0, 1, 2], (2, 3, "")), (1, [5], (0, 1, "expected offset")), (1, [1, 3], (0, 1, "not contiguous")), (1, [1, 1], (0, 1, "not contiguous")), (0, [], (0, 0, ""))],
)
def test_replica_append(spark, end, sent, expected):
    got = append.replica_append(spark.createDataFrame([("t", 0, end)], ENDS), spark.createDataFrame([("t", 0, o) for o in sent], ROWS)).collect()[0]
    assert (got.appended, got.log_end_offset, got.error) == expected


@pytest.mark.parametrize("end, sent, leader, expected", [(0, [0], 2, (1, 1, False)), (0, [1], 2, (0, 0, True)), (2, [2, 3, 4], 4, (5, 4, False)), (2, [], 1, (2, 1, False)), (2, [1, 2], 9, (2, 2, True))])
def test_replica_apply(spark, end, sent, leader, expected):
    marks = spark.createDataFrame([("t", 0, leader)], "topic string, partition int, leader_high_watermark bigint")
    got = append.replica_apply(spark.createDataFrame([("t", 0, end)], ENDS), spark.createDataFrame([("t", 0, o) for o in sent], ROWS), marks).collect()[0]
    assert (got.log_end_offset, got.high_watermark, got.mismatch) == expected


@pytest.mark.parametrize("own, rounds, copied", [(0, 3, 2500), (2500, 0, 0), (9999, 0, 0), (1500, 1, 1000)])
def test_replica_sync_rounds(spark, own, rounds, copied):
    leader = spark.range(2500).selectExpr("'t' AS topic", "0 AS partition", "id AS offset")
    got = cluster.replica_sync(leader, spark.createDataFrame([("t", 0, own)], ENDS)).collect()[0]
    assert (got.rounds, got.copied, got.log_end_offset) == (rounds, copied, 2500)


def test_appends_continue_the_log(spark):
    log = spark.createDataFrame([("t", 0, o) for o in range(3)], ROWS)
    new = spark.createDataFrame([("t", 0, 7), ("t", 0, 9), ("u", 1, 8)], "topic string, partition int, arrival bigint")
    assert sorted((r.topic, r.arrival, r.offset) for r in append.append_offsets(log, new).collect()) == [("t", 7, 3), ("t", 9, 4), ("u", 8, 0)]
