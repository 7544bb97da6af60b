"""SimHash near-duplicates, all of them: pigeonhole blocks searched to the radius that the limit needs.

A document's fingerprint has 256 bits: each distinct word votes on each bit.  Documents are near copies when their
fingerprints differ in at most ``MAX_DISTANCE`` bits.  The fingerprint is a ring of ``BLOCKS`` blocks.  If two differ in at
most ``limit`` bits, there is a block from which on any ``n`` blocks of the ring differ in at most ``n * limit / BLOCKS`` bits
(start behind the block where the sum of what each differs more than the mean is greatest).  So each block in turn is searched
for all pairs that differ in at most ``limit // BLOCKS`` of its bits, 2 of 20, and of these only pairs whose next two blocks
keep to it too, 8 of 60, are compared whole.  No close pair is missed.

Documents with equal fingerprints are one node from the start.  One shuffle brings the fingerprints of a part of a block
together; only pairs that connect what isn't connected yet leave, so a group of thousands costs about as many edges as
members and no pair is capped.  Components of these edges are the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.base import DOCUMENT_COLUMNS, arrow_map, staged, text_input
from logmill.llm.tokens import Tokeniser, mix64, slices

BITS = 256
MAX_DISTANCE = 38
BLOCKS = 13
#: Rows of a block that a task holds, about; they set the number of parts.
PART_ROWS = 1 << 19
#: Pairs of rows from which on two runs of equal keys are compared row by row, without those connected already.
HEAVY = 1 << 14
#: Rows of other parts, and candidates, that are taken at once.
CHUNK = 1 << 18
_U = np.uint64


def _votes(words: np.ndarray) -> np.ndarray:
    """The bit of each of ``words`` (distinct, hashed), as bytes: 32 a word."""
    lanes = [mix64(words + _U(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) for k in range(1, BITS // 64 + 1)]
    return np.stack(lanes, axis=1).view(np.uint8)


def fingerprint_words(words: np.ndarray) -> bytes:
    """The fingerprint of a document's word hashes: the majority of its distinct words on each bit, a tie being 0."""
    words = np.sort(words)
    if len(words) > 1:
        words = words[np.concatenate(([True], words[1:] != words[:-1]))]
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(words), 16_320):
        block = np.unpackbits(_votes(words[a : a + 16_320]), axis=1)
        for b in range(0, len(block), 255):
            total += np.add.reduce(block[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(words)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): 32 bytes for each row with a doc_id and at least one word."""

    def each(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch:  # noqa: B006 - one tokeniser a worker
        tok = state.setdefault("tok", Tokeniser())
        ids, texts, out_ids, fps = b.column(0), b.column(1).to_pylist(), [], []
        for i, j in slices(texts):
            h, off = tok(texts[i:j])
            for k in range(j - i):
                if off[k + 1] > off[k]:
                    out_ids.append(i + k)
                    fps.append(fingerprint_words(h[off[k] : off[k + 1]]))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(out_ids, pa.int64())), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return arrow_map(text_input(docs).where("doc_id is not null"), each, "doc_id bigint, fp binary")


def ring(blocks: int = BLOCKS) -> list[np.ndarray]:
    """Bits of each block."""
    return np.array_split(np.arange(BITS), blocks)


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``radius`` ones, 0 first."""
    return np.array([sum(1 << i for i in c) for n in range(min(radius, bits) + 1) for c in combinations(range(bits), n)], np.int64)


def _keys(bits: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The number that the bits of ``block`` make in each row of ``bits``."""
    return bits[:, block] @ (1 << np.arange(len(block), dtype=np.int64))


def _matrix(fps: pa.Array) -> np.ndarray:
    """Fingerprints as rows of bytes, without a copy."""
    if pa.types.is_large_binary(fps.type):
        fps = fps.cast(pa.binary())
    if not len(fps):
        return np.zeros((0, BITS // 8), np.uint8)
    offsets = np.frombuffer(fps.buffers()[1], np.int32)[fps.offset : fps.offset + len(fps) + 1]
    return np.frombuffer(fps.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, BITS // 8)


def forest(ids: np.ndarray, fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of all pairs of rows of ``fps`` within ``limit`` bits, as pairs of ``ids``.

    Each row that is reached is compared with all rows not yet reached, so every close pair ends up connected.
    """
    edges = []
    left = np.arange(len(ids))
    words = np.ascontiguousarray(fps).view(_U)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(words[left] ^ words[x]).sum(axis=1) <= limit
            if close.any():
                new = left[close]
                edges.extend((ids[x], ids[y]) for y in new)
                queue.extend(new)
                left = left[~close]
    return edges


class Part:
    """The rows of a block whose key has ``part`` as its last ``low`` bits, and a search for rows that are close to them.

    ``root`` leads from each row to the least that it is known to be connected with.  Rows are those of the part, by the rest
    of the key, and behind them those of the chunk that is searched for.
    """

    def __init__(self, block: int, part: int, low: int, ids: np.ndarray, fps: np.ndarray, limit: int, blocks: int, heavy: int):
        self.limit, self.heavy, self.part, self.low = limit, heavy, part, low
        self.block = ring(blocks)[block]
        self.radius = limit // blocks
        # bits of up to three blocks, as many as fit in 64, and what they may differ in
        n = max(min(3, blocks, 64 // -(-BITS // blocks)), 1)
        self.near = np.concatenate([ring(blocks)[(block + k) % blocks] for k in range(n)])[:64]
        self.near_limit = n * limit // blocks
        self.ids, self.fps, self.key, self.near_bits = self._rows(ids, fps)
        self.n = len(self.ids)
        # the rows of a key are at[key]:at[key + 1]
        self.at = np.searchsorted(self.key, np.arange((1 << len(self.block) - low) + 1)).astype(np.int32)
        self.root = np.arange(self.n)

    def _rows(self, ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, near = np.empty(len(ids), np.int64), np.zeros((len(ids), 8), np.uint8)
        for a in range(0, len(ids), 10_000):
            bits = np.unpackbits(fps[a : a + 10_000], axis=1)
            key[a : a + 10_000] = _keys(bits, self.block) >> self.low
            packed = np.packbits(bits[:, self.near], axis=1)
            near[a : a + 10_000, : packed.shape[1]] = packed
        by = np.argsort(key, kind="stable")
        return ids[by], np.ascontiguousarray(fps[by]).view(_U), key[by], near[by].view(_U).ravel()

    def _find(self, rows: np.ndarray) -> np.ndarray:
        least = self.root[rows]
        while ((up := self.root[least]) != least).any():
            least = up
        self.root[rows] = least
        return least

    def _join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Connects rows ``a`` with rows ``b``; those of the pairs that connect what wasn't."""
        used = [np.zeros(0, np.int64)]
        while True:
            x, y = self._find(a), self._find(b)
            apart = np.flatnonzero(x != y)
            if not len(apart):
                used = np.concatenate(used)
                return a[used], b[used]
            great, least = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            great, first = np.unique(great, return_index=True)
            self.root[great] = least[first]
            used.append(apart[first])

    def _light(self, rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs of each of ``rows`` with the ``count`` rows from ``first`` on."""
        ends = np.cumsum(count)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, CHUNK), side="right")
        for i, j in zip(cuts, [*cuts[1:], len(rows)]):
            n = count[i:j]
            a = np.repeat(rows[i:j], n)
            b = np.arange(len(a)) + np.repeat(first[i:j] - (np.cumsum(n) - n), n)
            close = np.flatnonzero(np.bitwise_count(self.near_bits[a] ^ self.near_bits[b]) <= self.near_limit)
            a, b = a[close], b[close]
            new = self._find(a) != self._find(b)
            a, b = a[new], b[new]
            close = np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(axis=1) <= self.limit
            if close.any():
                yield self._join(a[close], b[close])

    def _across(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that connect all close pairs of a row of ``a`` and one of ``b``."""
        label = self._find(np.concatenate((a, b)))
        mine, theirs, was = label[: len(a)], label[len(a) :], label[: len(a)].copy()
        edges = []
        for g in np.unique(was):
            rows = np.flatnonzero(was == g)
            left = np.flatnonzero(theirs != mine[rows[0]])
            for x in rows:
                if not len(left):
                    break
                close = left[np.bitwise_count(self.fps[b[left]] ^ self.fps[a[x]]).sum(axis=1) <= self.limit]
                if len(close):
                    found, k = np.unique(theirs[close], return_index=True)
                    edges.append((np.full(len(k), a[x]), b[close[k]]))
                    label[np.isin(label, found)] = mine[x]
                    left = left[theirs[left] != mine[x]]
        if edges:
            yield self._join(*(np.concatenate(e) for e in zip(*edges)))

    def _runs(self, rows: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close pairs of ``rows``, sorted by key, with rows of this part whose key differs from theirs by ``mask``."""
        other = self.key[rows] ^ mask
        first = self.at[other]
        count = self.at[other + 1] - first
        hit = np.flatnonzero(count)
        if not len(hit):
            return
        rows, first, count = rows[hit], first[hit].astype(np.int64), count[hit].astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        size = np.diff(np.append(start, len(rows)))
        heavy = size * count[start] >= self.heavy
        if heavy.any():
            for k in np.flatnonzero(heavy):
                a = start[k]
                yield from self._across(rows[a : a + size[k]], np.arange(first[a], first[a] + count[a]))
            light = np.repeat(~heavy, size)
            rows, first, count = rows[light], first[light], count[light]
        yield from self._light(rows, first, count)

    def _edges(self, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        found = list(pairs)
        if not found:
            return None
        a, b = (self.ids[np.concatenate(e)] for e in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def within(self) -> Iterator[pa.RecordBatch]:
        """Edges among the part's own rows."""
        rows = np.arange(self.n)
        for mask in masks(len(self.block) - self.low, self.radius).tolist():
            if mask:
                # each pair of keys once: from the one without the mask's first bit
                pairs = self._runs(rows[self.key & (1 << mask.bit_length() - 1) == 0], mask)
            else:
                pairs = self._equal()
            if (out := self._edges(pairs)) is not None:
                yield out

    def _equal(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.diff(self.at))
        first, last = self.at[start].astype(np.int64), self.at[start + 1].astype(np.int64)
        heavy = (last - first) ** 2 >= self.heavy
        for a, b in zip(first[heavy].tolist(), last[heavy].tolist()):
            if edges := forest(np.arange(a, b), self.fps[a:b], self.limit):
                yield self._join(*np.array(edges).T)
        size = (last - first)[~heavy]
        rows = np.repeat(first[~heavy] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        yield from self._light(rows, rows + 1, np.repeat(last[~heavy], size) - rows - 1)

    def visit(self, home: int, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges of rows of the part ``home`` with rows of this part."""
        ids, fps, key, near = self._rows(ids, fps)
        own = self.ids, self.fps, self.key, self.near_bits
        self.ids, self.fps, self.key, self.near_bits = (np.concatenate(x) for x in zip(own, (ids, fps, key, near)))
        self.root = np.concatenate((self.root, np.arange(self.n, len(self.ids))))
        rows = np.arange(self.n, len(self.ids))
        for mask in masks(len(self.block) - self.low, self.radius - (home ^ self.part).bit_count()).tolist():
            if (out := self._edges(self._runs(rows, mask))) is not None:
                yield out
        # rows of the part that visitors connect stay connected, by the least row, which is always one of the part
        self.ids, self.fps, self.key, self.near_bits = own
        self.root = self.root[: self.n]


def close_pairs(nodes: DataFrame, limit: int = MAX_DISTANCE, blocks: int = BLOCKS, part_rows: int = PART_ROWS, heavy: int = HEAVY) -> DataFrame:
    """(a, b) with a < b: pairs of nodes (node, fp) that are within ``limit``, enough of them to connect all such pairs.

    A block's rows are parted by the last ``low`` bits of their keys, as many as keep a part at about ``part_rows``.  A row goes
    to its own part and to those of lesser number that differ from it in at most ``limit // blocks`` bits.  ``blocks`` (11 or
    more, as a task holds a table of all keys of a block), ``part_rows`` and ``heavy`` change the work and not what is connected.
    """
    of, radius = ring(blocks), limit // blocks
    low = min(max(-(-nodes.count() // part_rows) - 1, 0).bit_length(), len(of[-1]))
    parts = 1 << low

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(_matrix(b.column(1)), axis=1)
        at, rows = [], []
        for k, block in enumerate(of):
            home = _keys(bits, block) & parts - 1
            for step in masks(low, radius).tolist():
                to = home ^ step
                r = np.flatnonzero(to <= home)
                at.append(((k << low) + to[r] << low) + home[r])
                rows.append(r)
        rows = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), b.column(0).take(rows), b.column(1).take(rows)], ["at", "node", "fp"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition come sorted: of each part its own rows, which are held, and then those of others, in chunks."""
        part = last = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal part
            if not held:
                return
            ids, fps = (np.concatenate(x) for x in zip(*held))
            held.clear()
            where, home = divmod(last, parts)
            to = where % parts
            if part is None or part[0] != where:
                part = None  # before the next is built
                own = home == to
                none = ids[:0], fps[:0]
                part = where, Part(where >> low, to, low, *((ids, fps) if own else none), limit, blocks, heavy)
                if own:
                    yield from part[1].within()
            if home != to and part[1].n:
                yield from part[1].visit(home, ids, fps)

        for b in batches:
            at, ids, fps = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
            for i, j in zip(cuts, cuts[1:]):
                full = held and last // parts % parts != last % parts and sum(len(h[0]) for h in held) >= CHUNK
                if at[i] != last or full:
                    yield from flush()
                last = int(at[i])
                held.append((ids[i:j].copy(), fps[i:j].copy()))
        yield from flush()

    rows = arrow_map(nodes.select("node", "fp"), place, "at bigint, node bigint, fp binary", rows=500)
    # a partition a part, neither split nor merged
    placed = rows.repartitionById(blocks * parts, (F.shiftright("at", low)).cast("int")).sortWithinPartitions("at")
    return placed.mapInArrow(search, "a bigint, b bigint").where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node of the component of each node of ``edges`` (a, b), nodes that are their own least
    left out.  Alternates stars around least neighbours until nothing moves; a round is a written table."""
    edges = staged(edges.select("a", "b"), "edges")
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = F.min("b").over(Window.partitionBy("a"))
        # each greater neighbour is tied to the least of the node and its neighbours
        large = both.select("a", "b", F.least(F.col("a"), least).alias("m")).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node and its lesser neighbours are tied to the least of these
        smallest = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", smallest.alias("m")).select(F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a")))).alias("e"))
        after = staged(small.select("e.a", "e.b").where("a <> b").distinct(), "edges", after=edges)
        # done when every node hangs on one root that hangs on none
        roots = after.select(F.col("a").alias("b")).distinct()
        if after.join(roots, "b", "left_semi").isEmpty() and after.groupBy("b").count().where("count > 1").isEmpty():
            return after.select(F.col("b").alias("node"), F.col("a").alias("least"))
        edges = after


def near_copies(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, kept_doc_id): each document that goes, with the one that stays for it, the least doc_id of its group.

    Groups are the connected components of near copies.  Rows that repeat a doc_id are one document: it goes if any of
    its texts does.  Null doc_id, null text, no word (empty texts too): never a near copy.  Word order and the number
    of times a word occurs make no difference.  Empty table, or no copies: no rows.
    """
    fps = staged(fingerprints(docs), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    pairs = close_pairs(nodes, limit)
    exact = fps.join(nodes, "fp").where("doc_id > node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return components(pairs.union(exact).distinct()).select(F.col("node").alias("doc_id"), F.col("least").alias("kept_doc_id"))


def drop_near_copies(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` (columns of documents) with one document of each group, the least doc_id; see ``near_copies``.

    Of rows that repeat doc_id and text one stays; rows without a doc_id or a text stay."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    kept = docs.join(near_copies(docs, limit).select("doc_id"), "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy("lang", "source", "n_chars"))
    return kept.withColumn("again", again).where("again = 1 or doc_id is null or text is null").drop("again")
