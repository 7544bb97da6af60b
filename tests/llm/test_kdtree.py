import random
import zlib
from collections import defaultdict

import pytest

from logmill.llm import kdtree


def brute(rows, target):
    """Leaf of each row by plain recursion over sorted lists."""
    crc = lambda s: -1 if s is None else zlib.crc32(s.encode())
    least = min((r[0] for r in rows if r[0] is not None), default=0)
    points = [((least if i is None else i), len((t or "").encode()), crc(s), crc(g)) for i, t, g, s in rows]
    weight = [p[1] for p in points]
    leaf = [0] * len(rows)
    root = [max(1, max(p[k] for p in points) - min(p[k] for p in points)) for k in range(4)]

    def split(members, path):
        shares = [(max(points[m][k] for m in members) - min(points[m][k] for m in members)) / root[k] for k in range(4)]
        total = sum(weight[m] for m in members)
        if total <= target or max(shares) == 0:
            for m in members:
                leaf[m] = path
            return
        k = shares.index(max(shares))
        values = sorted({points[m][k] for m in members})
        below = defaultdict(int)
        for m in members:
            below[points[m][k]] += weight[m]
        run = 0
        for at, v in enumerate(values):
            run += below[v]
            if 2 * run >= total:
                break
        cut = values[min(at, len(values) - 2)]
        split([m for m in members if points[m][k] <= cut], 2 * path)
        split([m for m in members if points[m][k] > cut], 2 * path + 1)

    if rows:
        split(list(range(len(rows))), 1)
    return sorted(((r[0], w, x) for r, w, x in zip(rows, weight, leaf)), key=repr)


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(3 * n), "x" * int(rng.paretovariate(1.2) * 20), rng.choice(["en", "fr", "de"]), f"s{rng.randrange(9)}") for _ in range(n)]
    return rows + [(None, "null id", "en", "s1"), (4, None, None, None), (5, "", "en", None)] + [(9, "same" * 100, "en", "s1")] * 20


@pytest.mark.parametrize("local_rows", [1, 40, 1_000_000])
def test_against_brute_force_whatever_the_driver_splits(spark, local_rows):
    rows = sample(300)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, bytes int")
    got = kdtree.shards(docs, target_bytes=1500, local_rows=local_rows).collect()
    assert sorted(((r.doc_id, r.bytes, r.shard) for r in got), key=repr) == brute(rows, 1500)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.bytes
    # one row, or rows that are alike, may exceed the target
    assert all(s <= 1500 or len({(r.doc_id, r.bytes) for r in got if r.shard == k}) == 1 for k, s in sizes.items()) and len(sizes) > 8


def test_small_empty_and_alike(spark):
    kinds = "doc_id bigint, text string, lang string, source string"
    assert kdtree.shards(spark.createDataFrame([], kinds)).count() == 0
    assert [r.shard for r in kdtree.shards(spark.createDataFrame([(1, "a", "en", "s")], kinds)).collect()] == [1]
    alike = spark.createDataFrame([(1, "abc", "en", "s")] * 5, kinds)
    for local_rows in (1, 100):
        assert {r.shard for r in kdtree.shards(alike, 4, local_rows).collect()} == {1}


@pytest.mark.parametrize("local_rows", [1, 1_000_000])
def test_extreme_ids_and_nulls_whatever_the_driver_splits(spark, local_rows):
    kinds = "doc_id bigint, text string, lang string, source string"
    ids = [None, 5, 2**63 - 2, 2**63 - 1, -(2**63), -(2**63) + 1, None, 0, 7]
    for chosen in (ids, ids[:3], [None, 1, 2, 3, 4], [None, None]):
        rows = [(i, "x" * (3 + k), "en", "s") for k, i in enumerate(chosen)]
        got = kdtree.shards(spark.createDataFrame(rows, kinds), target_bytes=6, local_rows=local_rows).collect()
        assert sorted(((r.doc_id, r.bytes, r.shard) for r in got), key=repr) == brute(rows, 6)


def test_a_very_long_text_has_a_leaf_of_its_own_size(spark):
    rows = [(k, "y" * 10, "en", "s") for k in range(30)] + [(30, "z" * 3_000_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for local_rows in (1, 1000):
        got = kdtree.shards(docs, target_bytes=100, local_rows=local_rows).collect()
        assert sorted(((r.doc_id, r.bytes, r.shard) for r in got), key=repr) == brute(rows, 100)


def test_sql_gives_the_same_leaves(spark):
    import duckdb

    rows = sample(200) + [(-5, "é" * 30, "ü", "ß/x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute("CREATE TABLE typed AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM documents")
    con.unregister("documents")
    con.execute("ALTER TABLE typed RENAME TO documents")
    for target in (1 << 30, 3000, 700):
        theirs = con.execute(kdtree.oracle(target)).fetchall()
        assert sorted(theirs, key=repr) == sorted(((r.doc_id, r.bytes, r.shard) for r in kdtree.shards(docs, target_bytes=target).collect()), key=repr)
