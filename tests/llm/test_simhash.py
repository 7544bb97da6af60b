import random

import numpy as np
import pytest

from logmill.llm import simhash
from logmill.llm.tokens import Tokeniser

from .conftest import words


def edited(rng, text, share):
    return " ".join(f"w{rng.randrange(5000)}" if rng.random() < share else w for w in text.split())


def corpus(seed=1, bases=40):
    rng = random.Random(seed)
    rows, group = [], {}
    for g in range(bases):
        base = words(rng, rng.randrange(60, 400))
        for k in range(rng.choice((1, 1, 2, 5))):
            i = len(rows) * 7 % 1009 + 1
            rows.append((i, base if k == 0 else edited(rng, base, 0.03)))
            group[i] = g
    return rows, group


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute(rows, limit=simhash.MAX_DISTANCE):
    rows = sorted((i, t) for i, t in rows if i is not None and t and any(c.isalnum() for c in t))
    tok = Tokeniser()
    fps = np.array([np.frombuffer(simhash.fingerprint_words(tok([t])[0]), np.uint64) for _, t in rows])
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][0] == rows[b][0] or np.bitwise_count(fps[a] ^ fps[b]).sum() <= limit]
    least = components(len(rows), pairs)
    return sorted({(rows[k][0], rows[r][0]) for k, r in enumerate(least) if rows[k][0] != rows[r][0]})


def test_groups_against_brute_force_and_truth(make_docs):
    rows, group = corpus()
    rows += [(5000, None), (5001, ""), (5002, " ;!"), (None, rows[0][1]), (None, rows[0][1]), (rows[3][0], rows[3][1]), (6000, rows[5][1].upper()), (6001, words(random.Random(8), 30_000))]
    docs = make_docs(rows, fp="clash", node="clash", kept_doc_id="clash")
    got = sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_copies(docs).collect())
    assert got == brute(rows)
    group[6000] = group[rows[5][0]]
    caught = {d for d, _ in got}
    for g in set(group.values()):
        assert len([i for i, x in group.items() if x == g and i not in caught]) == 1
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == sorted(({i for i, _ in rows if i} - caught))
    assert sum(r.doc_id is None for r in kept) == 2


def test_rows_that_repeat_a_doc_id_are_one_document(make_docs):
    rng = random.Random(3)
    a, b = words(rng, 100), words(rng, 100)
    rows = [(3, a), (3, b), (1, b), (9, a)]
    assert sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_copies(make_docs(rows)).collect()) == [(3, 1), (9, 1)]


def test_empty_table_and_no_copies(make_docs):
    assert simhash.near_copies(make_docs([])).count() == 0
    assert simhash.drop_near_copies(make_docs([])).count() == 0
    docs = make_docs([(1, "one two three"), (2, "four five six seven")])
    assert simhash.near_copies(docs).count() == 0 and simhash.drop_near_copies(docs).count() == 2


def flipped(fp, bits):
    out = np.unpackbits(fp)
    out[bits] ^= 1
    return np.packbits(out)


def fingerprint_nodes(spark, fps):
    return spark.createDataFrame([(i, bytes(f)) for i, f in enumerate(fps)], "node bigint, fp binary")


def all_pairs(fps, limit):
    w = np.ascontiguousarray(fps).view(np.uint64)
    return [(a, b) for a in range(len(w)) for b in np.flatnonzero(np.bitwise_count(w[a + 1 :] ^ w[a]).sum(axis=1) <= limit) + a + 1]


@pytest.mark.parametrize("distance", [simhash.MAX_DISTANCE, 30, 20])
def test_recall_of_the_blocks(spark, distance):
    """Of pairs that differ in random bits none is missed: some block and its neighbours keep to what they may differ in."""
    rng = np.random.default_rng(distance)
    fps = rng.integers(0, 256, (1500, 32), np.uint8)
    fps = np.stack((fps, [flipped(f, rng.choice(simhash.BITS, distance, replace=False)) for f in fps]), axis=1).reshape(-1, 32)
    got = {(r.a, r.b) for r in simhash.close_pairs(fingerprint_nodes(spark, fps)).collect()}
    assert got == {(i, i + 1) for i in range(0, 3000, 2)}


def test_pairs_at_the_limit_whose_bits_lie_worst(spark):
    """The limit's bits dealt evenly over the ring from any bit on, so that each block has as many as it can; one more is too many."""
    rng = np.random.default_rng(5)
    fps, want = [], set()
    for k in range(400):
        n = simhash.MAX_DISTANCE + k % 2
        base = rng.integers(0, 256, 32, np.uint8)
        fps += [base, flipped(base, (np.arange(n) * simhash.BITS // n + k) % simhash.BITS)]
        if k % 2 == 0:
            want.add((2 * k, 2 * k + 1))
    assert {(r.a, r.b) for r in simhash.close_pairs(fingerprint_nodes(spark, fps)).collect()} == want


@pytest.mark.parametrize(
    "limit, options",
    [
        (simhash.MAX_DISTANCE, {}),
        (simhash.MAX_DISTANCE, {"part_rows": 9, "heavy": 4}),
        (simhash.MAX_DISTANCE, {"part_rows": 40}),
        (simhash.MAX_DISTANCE, {"heavy": 1}),
        (simhash.MAX_DISTANCE, {"blocks": 20, "part_rows": 100}),
        (30, {"blocks": 11, "part_rows": 100}),
        (5, {"part_rows": 40, "heavy": 4}),
        (0, {}),
    ],
)
def test_pairs_connect_what_all_pairs_connect(spark, limit, options):
    rng = np.random.default_rng(limit)
    fps = []
    for size in (1, 1, 1, 2, 3, 30, 120):  # groups that wander off, so that few of a group's pairs are close
        group = [rng.integers(0, 256, 32, np.uint8)]
        while len(group) < size:
            group.append(flipped(group[rng.integers(len(group))], rng.choice(simhash.BITS, rng.integers(1, max(limit, 1) + 3), replace=False)))
        fps += group
    low = np.zeros((40, simhash.BITS), np.uint8)  # few bits set, as short texts have
    low[np.arange(40)[:, None], rng.integers(0, simhash.BITS, (40, 25))] = 1
    fps = np.unique(np.concatenate((fps, np.packbits(low, axis=1), [np.zeros(32, np.uint8), np.full(32, 255, np.uint8)])), axis=0)
    rng.shuffle(fps)
    pairs = all_pairs(fps, limit)
    got = [(r.a, r.b) for r in simhash.close_pairs(fingerprint_nodes(spark, fps), limit, **options).collect()]
    assert set(got) <= set(pairs) and len(got) == len(set(got))
    assert components(len(fps), got) == components(len(fps), pairs)


def test_pairs_of_no_and_one_node(spark):
    assert simhash.close_pairs(fingerprint_nodes(spark, [])).count() == 0
    assert simhash.close_pairs(fingerprint_nodes(spark, [bytes(32)])).count() == 0


def test_a_large_group_leaves_few_pairs(spark):
    """A group of 2000 near copies, half of which share each block, leaves about a spanning tree a block."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, 32, np.uint8)
    fps = np.unique([base, *(flipped(base, rng.choice(simhash.BITS, 8, replace=False)) for _ in range(2000))], axis=0)
    got = [(r.a, r.b) for r in simhash.close_pairs(fingerprint_nodes(spark, fps)).collect()]
    assert set(components(len(fps), got)) == {0} and len(got) < simhash.BLOCKS * len(fps)


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (6, 32), np.uint8)
    fps = np.repeat(base, 8, axis=0)
    for row in fps:
        bits = np.unpackbits(row)
        bits[rng.choice(256, 14, replace=False)] ^= 1
        row[:] = np.packbits(bits)
    words_ = fps.view(np.uint64)
    pairs = [(a, b) for a in range(48) for b in range(a + 1, 48) if np.bitwise_count(words_[a] ^ words_[b]).sum() <= 20]
    edges = simhash.forest(np.arange(48), fps, 20)
    assert components(48, edges) == components(48, pairs) and len(edges) == 48 - len(set(components(48, pairs)))


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 200), (200, 250)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "a bigint, b bigint")
    got = {r.node: r.least for r in simhash.components(frame).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)} | {250: 200, 300: 200}


def test_fingerprint_is_a_majority_of_distinct_words():
    h, _ = Tokeniser()(["one two two three three three"])
    a = simhash.fingerprint_words(h)
    assert a == simhash.fingerprint_words(np.unique(h)[::-1].copy()) and len(a) == 32
    bits = np.unpackbits(simhash._votes(np.unique(h)), axis=1).sum(axis=0) * 2 > 3
    assert (np.unpackbits(np.frombuffer(a, np.uint8)).astype(bool) == bits).all()
