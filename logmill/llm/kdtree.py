"""Sharding by a k-d tree over metadata: split at weighted medians until leaves reach the target bytes.

Dimensions are doc_id, the bytes of the text and the CRC-32 of source and of language; weights are bytes.  A node with more
than ``target_bytes`` is split along its widest dimension (its extent as a share of the root's; ties: the first in
this order) at the weighted median: the left half takes the values up to the least one with which it has half of
the bytes, and at least one value stays for the right.  Only a node whose rows are all alike stays larger.

A row without a doc_id stands with the least doc_id there is, so that it stretches no dimension.  Extents are Python
integers and positions within a span unsigned ones: any 64-bit doc_id will do.

The metadata are written once, without the texts.  Nodes with more than ``local_rows`` rows are split by passes over them that send
the driver a histogram a node, narrowed until the median stands; the tree goes out with the next pass.  A smaller node is
finished by one task.  Both find the same exact medians, so ``local_rows`` doesn't change the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.base import staged

TARGET_BYTES = 32 << 20
LOCAL_ROWS = 100_000
DIMS = ("d0", "d1", "d2", "d3")
_HISTOGRAM_CELLS = 1 << 18
_EXTENTS = [f"{f}{k}" for k in range(len(DIMS)) for f in ("lo", "hi")]


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes, d0..d3).  Null text counts as no bytes, null strings as -1; ``d0`` stays null with the doc_id."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint")
    crc = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("bytes"), F.col("doc_id").cast("bigint").alias("d0"), size.alias("d1"), crc("source").alias("d2"), crc("lang").alias("d3"))


def widest(lo: list[int], hi: list[int], root: list[int]) -> int | None:
    """The dimension with the largest extent as a share of the root's, None where all are points."""
    best, share = None, 0.0
    for k in range(len(DIMS)):
        if hi[k] > lo[k] and (s := (hi[k] - lo[k]) / root[k]) > share:
            best, share = k, s
    return best


def split_value(values: np.ndarray, weights: np.ndarray) -> int:
    """The greatest value of the left half, among distinct sorted ``values`` (two at least)."""
    total = np.cumsum(weights)
    at = int(np.searchsorted(2 * total, total[-1]))
    return int(values[min(at, len(values) - 2)])


def grow(points: np.ndarray, weights: np.ndarray, root: list[int], target: int, path: int) -> np.ndarray:
    """Leaf of each row of a subtree: its path from the root as bits behind a leading 1."""
    leaf = np.full(len(weights), path, np.int64)
    stack = [(np.arange(len(weights)), path)]
    while stack:
        rows, p = stack.pop()
        if not len(rows) or weights[rows].sum() <= target:
            leaf[rows] = p
            continue
        x = points[rows]
        dim = widest(x.min(0).tolist(), x.max(0).tolist(), root)
        if dim is None:
            leaf[rows] = p
            continue
        values, where = np.unique(x[:, dim], return_inverse=True)
        left = x[:, dim] <= split_value(values, np.bincount(where, weights[rows], len(values)))
        stack += [(rows[left], 2 * p), (rows[~left], 2 * p + 1)]
    return leaf


def _descend(points: np.ndarray, tree: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node of each row in the tree so far."""
    node = np.ones(len(points), np.int64)
    if not tree:
        return node
    nodes = np.array(sorted(tree), np.int64)
    dims, cuts = (np.array([tree[n][k] for n in nodes], np.int64) for k in (0, 1))
    active = np.arange(len(points))
    while len(active):
        at = np.minimum(np.searchsorted(nodes, node[active]), len(nodes) - 1)
        inner = nodes[at] == node[active]
        active, at = active[inner], at[inner]
        node[active] = 2 * node[active] + (points[active, dims[at]] > cuts[at])
    return node


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([b.column(d).to_numpy(zero_copy_only=False) for d in DIMS], axis=1), b.column("bytes").to_numpy(zero_copy_only=False)


def _node_stats(meta: DataFrame, tree: dict, wanted: set[int]) -> dict[int, dict]:
    """Bytes, rows and extents of each of the ``wanted`` nodes."""
    spark = meta.sparkSession
    shared = spark.sparkContext.broadcast((tree, wanted))
    schema = ", ".join(f"{c} bigint" for c in ("node", "bytes", "n", *_EXTENTS))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, wanted = shared.value
        for b in batches:
            x, w = _arrays(b)
            frame = pd.DataFrame({"node": _descend(x, tree), "bytes": w, "n": 1} | {f"{f}{k}": x[:, k] for k in range(len(DIMS)) for f in ("lo", "hi")})
            frame = frame[frame.node.isin(wanted)]
            how = {"bytes": "sum", "n": "sum"} | {c: "min" if c[:2] == "lo" else "max" for c in _EXTENTS}
            yield pa.RecordBatch.from_pandas(frame.groupby("node", as_index=False).agg(how), preserve_index=False)

    aggs = [F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), *((F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in _EXTENTS)]
    rows = meta.mapInArrow(each, schema).groupBy("node").agg(*aggs).collect()
    shared.unpersist()
    return {r.node: {"bytes": r.bytes, "n": r.n, "lo": [r[f"lo{k}"] for k in range(len(DIMS))], "hi": [r[f"hi{k}"] for k in range(len(DIMS))]} for r in rows}


def _medians(meta: DataFrame, tree: dict, nodes: dict[int, dict], dims: dict[int, int]) -> dict[int, int]:
    """The split value of each node: histograms of its dimension, narrowed to the bin that holds the median."""
    spark = meta.sparkSession
    span = {n: (nodes[n]["lo"][d], nodes[n]["hi"][d]) for n, d in dims.items()}
    below = dict.fromkeys(dims, 0)  # bytes under the span
    under: dict[int, int | None] = dict.fromkeys(dims)  # the greatest value under it
    done: dict[int, int] = {}
    while len(done) < len(dims):
        open_ = {n: (dims[n], *span[n]) for n in dims if n not in done}
        bins = max(8, min(1024, _HISTOGRAM_CELLS // len(open_)))
        shared = spark.sparkContext.broadcast((tree, open_))

        def each(batches: Iterable[pa.RecordBatch], shared=shared, bins=bins) -> Iterator[pa.RecordBatch]:
            tree, open_ = shared.value
            ids = np.array(sorted(open_), np.int64)
            dim, lo, hi = (np.array([open_[n][k] for n in ids], np.int64) for k in range(3))
            step = np.array([(open_[n][2] - open_[n][1]) // bins + 1 for n in ids], np.uint64)
            for b in batches:
                x, w = _arrays(b)
                node = _descend(x, tree)
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                value = x[np.arange(len(x)), dim[at]]
                use = (ids[at] == node) & (value >= lo[at]) & (value <= hi[at])
                at, value, w, node = at[use], value[use], w[use], node[use]
                frame = pd.DataFrame({"node": node, "bin": ((value.astype(np.uint64) - lo[at].astype(np.uint64)) // step[at]).astype(np.int64), "bytes": w, "least": value, "most": value})
                yield pa.RecordBatch.from_pandas(frame.groupby(["node", "bin"], as_index=False).agg({"bytes": "sum", "least": "min", "most": "max"}), preserve_index=False)

        rows = meta.mapInArrow(each, "node bigint, bin bigint, bytes bigint, least bigint, most bigint").groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
        shared.unpersist()
        by_node: dict[int, list] = {}
        for r in rows:
            by_node.setdefault(r.node, []).append(r)
        for n in open_:
            top = nodes[n]["hi"][dims[n]]
            for r in sorted(by_node[n], key=lambda r: r.bin):
                if 2 * (below[n] + r.bytes) >= nodes[n]["bytes"]:
                    if r.least < r.most:
                        span[n] = (r.least, r.most)
                    elif r.least < top:
                        done[n] = r.least
                    else:  # the median is the greatest value, which stays on the right
                        done[n] = under[n]
                    break
                below[n] += r.bytes
                under[n] = r.most
    return done


def shards(docs: DataFrame, target_bytes: int = TARGET_BYTES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(doc_id, bytes, shard), a row for each row of ``docs``: the leaf that it belongs to, as its path from the root in bits
    behind a leading 1 (0 the lesser half).

    Null doc_id: where the least doc_id is (0 where there is none).  Null or empty text: 0 bytes.  Null source or language: less than all
    others.  Ties and repeated rows: rows that are alike in all dimensions share a leaf, which may then exceed the target.
    Empty table: no rows.
    """
    meta = staged(metadata(docs), "metadata")
    meta = meta.withColumn("d0", F.coalesce("d0", F.lit(meta.agg(F.min("d0")).first()[0] or 0).cast("bigint")))
    tree: dict[int, tuple[int, int]] = {}
    stats = _node_stats(meta, tree, {1})
    if not stats:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, bytes bigint, shard bigint")
    root = [max(1, h - low) for low, h in zip(stats[1]["lo"], stats[1]["hi"])]
    local: set[int] = set()  # nodes that a task finishes
    while stats:
        local |= {n for n, s in stats.items() if s["bytes"] > target_bytes and s["n"] <= local_rows}
        dims = {n: d for n, s in stats.items() if s["bytes"] > target_bytes and s["n"] > local_rows and (d := widest(s["lo"], s["hi"], root)) is not None}
        if not dims:
            break
        cuts = _medians(meta, tree, stats, dims)
        tree |= {n: (dims[n], cuts[n]) for n in dims}
        stats = _node_stats(meta, tree, {child for n in dims for child in (2 * n, 2 * n + 1)})
    shared = docs.sparkSession.sparkContext.broadcast((tree, local))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        tree, local = shared.value
        node = _descend(_arrays(b)[0], tree)
        unfinished = np.isin(node, np.array(sorted(local), np.int64))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(node), pa.array(unfinished)], [*b.schema.names, "shard", "unfinished"])

    placed = meta.mapInArrow(lambda batches: (place(b) for b in batches), f"{', '.join(f'{c} bigint' for c in meta.columns)}, shard bigint, unfinished boolean")
    out = placed.where("not unfinished").select("doc_id", "bytes", "shard")
    if local:

        def finish(key: tuple, t: pa.Table) -> pa.Table:
            x = np.stack([t[d].to_numpy() for d in DIMS], axis=1)
            leaf = grow(x, t["bytes"].to_numpy(), root, target_bytes, key[0].as_py())
            return pa.table({"doc_id": t["doc_id"], "bytes": t["bytes"], "shard": leaf})

        inner = placed.where("unfinished").drop("unfinished").groupBy("shard").applyInArrow(finish, "doc_id bigint, bytes bigint, shard bigint")
        out = out.unionByName(inner)
    return out


def oracle(target_bytes: int = TARGET_BYTES) -> str:
    """SQL for the rows of ``shards``: a step splits every open node.  CRC-32 is computed bit by bit, of each distinct string once."""
    dims = range(len(DIMS))
    spread = ", ".join(f"(max(d{k}) OVER n - min(d{k}) OVER n) / CAST(r{k} AS DOUBLE) AS s{k}" for k in dims)
    widest_of = " ".join(f"WHEN s{k} = greatest(s0, s1, s2, s3) THEN {k}" for k in dims)
    value = " ".join(f"WHEN {k} THEN d{k}" for k in dims)
    return f"""
WITH RECURSIVE strings AS (SELECT DISTINCT source AS s FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
bits AS (
  SELECT s, hex(encode(s)) AS h, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS crc FROM strings
  UNION ALL
  SELECT s, h, i + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, CAST('0x' || substr(h, CAST(i // 8 * 2 + 1 AS BIGINT), 2) AS BIGINT)) ELSE crc END AS c FROM bits WHERE i < 4 * len(h))),
crcs AS (SELECT s, xor(crc, 4294967295) AS crc FROM bits WHERE i = 4 * len(h)),
points AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS bytes, coalesce(doc_id, (SELECT min(doc_id) FROM documents), 0) AS d0, coalesce(strlen(text), 0) AS d1, coalesce(a.crc, -1) AS d2, coalesce(b.crc, -1) AS d3
  FROM documents LEFT JOIN crcs a ON source = a.s LEFT JOIN crcs b ON lang = b.s),
root AS (SELECT {', '.join(f'greatest(1, max(d{k}) - min(d{k})) AS r{k}' for k in dims)} FROM points),
tree AS (
  SELECT r, CAST(1 AS BIGINT) AS path, true AS unfinished FROM points
  UNION ALL
  SELECT r, CASE WHEN splits THEN 2 * path + CASE WHEN v > CASE WHEN cut = most THEN below ELSE cut END THEN 1 ELSE 0 END ELSE path END, splits
  FROM (
    SELECT *, max(CASE WHEN v < most THEN v END) OVER (PARTITION BY path) AS below FROM (
      SELECT *, min(CASE WHEN 2 * run >= total THEN v END) OVER (PARTITION BY path) AS cut, max(v) OVER (PARTITION BY path) AS most FROM (
        SELECT *, sum(bytes) OVER (PARTITION BY path ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, total > {target_bytes} AND greatest(s0, s1, s2, s3) > 0 AS splits FROM (
          SELECT *, CASE CASE {widest_of} END {value} END AS v FROM (
            SELECT t.r, t.path, bytes, d0, d1, d2, d3, sum(bytes) OVER n AS total, {spread} FROM tree t JOIN points p ON t.r = p.r, root WHERE unfinished WINDOW n AS (PARTITION BY t.path)))))))
SELECT doc_id, bytes, path AS shard FROM tree JOIN points ON tree.r = points.r WHERE NOT unfinished
"""
