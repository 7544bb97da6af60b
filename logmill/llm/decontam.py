"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of every test item.  A document's words are streamed through it; after each word the
state gives the longest run ending there that some item has.  A run is removed when it reaches ``max_words``, or
``coverage`` of an item that has it (and ``least_words`` at any rate, or the whole of an item that is shorter).  Where the
longest run doesn't, the longest of its ends that does is removed: a shorter item may have it.

Two neighbouring words that no item has next to each other end every run.  A table of the items' word pairs therefore
leaves only stretches that are long enough to reach a limit, found for whole batches at once; the
automaton runs on these alone.  Results are as if it ran on every word.

Items are broadcast ``CHUNK_WORDS`` words at a time: a benchmark beyond that takes further automata and passes, and
what these find is put together by document.  Nothing else is shuffled, and nothing at all with one automaton.  A Python worker
builds an automaton once and keeps it for its next tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.base import arrow_map, merged, text_input
from logmill.llm.recompress import cut_spans
from logmill.llm.tokens import Tokeniser, mix64, slices

MAX_WORDS = 10
COVERAGE = 0.5
LEAST_WORDS = 8
SHORT_WORDS = 5  # shorter items are phrases that any text may hold
CHUNK_WORDS = 200_000
_PAIR_BITS = 22
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


class Automaton:
    """Generalised suffix automaton of sequences of word hashes, with the shortest item of each state."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words_of: list[int] = [0]  # words of the shortest item that has the state's runs
        self.item_of: list[int | None] = [None]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.edges.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.words_of.append(0)
        self.item_of.append(None)
        return len(self.edges) - 1

    def _extend(self, last: int, word: int) -> int:
        if (q := self.edges[last].get(word)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, word, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.edges[p]:
            self.edges[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.edges[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.edges[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.edges[p].get(word) == q:
            self.edges[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Iterable[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def own(self, item: int | None, words: list[int]) -> None:
        """Marks the states of an item that was added; after all items were."""
        state = 0
        for w in words:
            state = self.edges[state][w]
            s = state
            while s > 0 and (not self.words_of[s] or len(words) < self.words_of[s]):
                self.words_of[s], self.item_of[s] = len(words), item
                s = self.link[s]

    def matches(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest run ending at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.edges[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.edges[state]:
                state, length = self.edges[state][w], length + 1
            yield state, length


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix64(h[:-1] * _A + h[1:] * _B)


def limit_of(item_words: int, max_words: int, coverage: float, least_words: int) -> int:
    """The number of words from which a run of an item of so many words is removed; it grows with the item."""
    return min(item_words, max_words, max(least_words, math.ceil(coverage * item_words - 1e-9)))


def build(items: list[tuple[int | None, list[int]]], max_words: int, coverage: float, least_words: int):
    """(automaton, limit of each state, its longest suffix state that reaches its own limit or 0, table of pairs, least
    limit); the items have SHORT_WORDS words at least."""
    sam = Automaton()
    for _, words in items:
        sam.add(words)
    for item, words in sorted(items, key=lambda x: (len(x[1]), x[0] is None, x[0] or 0)):
        sam.own(item, words)
    limits = [limit_of(n, max_words, coverage, least_words) for n in sam.words_of]
    ends = [0] * len(limits)
    for s in sorted(range(1, len(limits)), key=sam.length.__getitem__):
        t = sam.link[s]
        ends[s] = t if t and sam.length[t] >= limits[t] else ends[t]
    pairs = np.zeros(1 << _PAIR_BITS, bool)
    for _, words in items:
        pairs[pair_hashes(np.array(words, np.uint64)) >> np.uint64(64 - _PAIR_BITS)] = True
    return sam, limits, ends, pairs, min(limit_of(len(w), max_words, coverage, least_words) for _, w in items)


_built: dict = {}


def built_once(key: tuple, items: list[tuple[int | None, list[int]]], max_words: int, coverage: float, least_words: int):
    """``build`` of a query's items, kept by the worker; with the first of another query those before it go."""
    if key not in _built:
        for old in [k for k in _built if k[0] != key[0]]:
            del _built[old]
        _built[key] = build(items, max_words, coverage, least_words)
    return _built[key]


def find(h: np.ndarray, offsets: np.ndarray, built) -> list[tuple[int, int, int, int | None, int, int, int]]:
    """(document, start, end, item, longest match, its start, words of the item) of the runs to remove, merged where they
    meet; a row for each of a span's longest matches."""
    sam, limits, ends, pairs, least = built
    out: list = []
    if len(h) < least:
        return out
    seen = pairs[pair_hashes(h) >> np.uint64(64 - _PAIR_BITS)]
    border = offsets[1:-1]
    seen[border[(border > 0) & (border < len(h))] - 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate(([0], seen.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2] + 1
    long = end - start >= least
    hits: dict[int, list[tuple[int, int, int, int | None, int]]] = {}
    for a, b in zip(start[long].tolist(), end[long].tolist()):
        doc = int(np.searchsorted(offsets, a, "right")) - 1
        base = a - int(offsets[doc])
        own = hits.setdefault(doc, [])
        for k, (s, n) in enumerate(sam.matches(h[a:b].tolist()), base + 1):
            if s and n < limits[s]:
                s = ends[s]
                n = sam.length[s]
            if s:
                own.append((k - n, k, n, sam.item_of[s], sam.words_of[s]))
    for doc, own in hits.items():
        for x, y in merged((p, q) for p, q, *_ in own):
            inside = [hit for hit in own if x <= hit[0] and hit[1] <= y]
            longest = max(n for _, _, n, _, _ in inside)
            out.extend((doc, x, y, item, n, p, size) for p, _, n, item, size in inside if n == longest)
    return out


def joined(rows: Iterable[tuple[int, int, int | None, int, int, int]]) -> list[tuple[int, int, int | None, int]]:
    """(start, end, item, longest match) of a document's spans from the rows of ``find`` for any number of automata: spans that
    meet become one, with the shortest item of each of its longest matches and the least of these items."""
    rows = list(rows)
    out = []
    for x, y in merged((a, b) for a, b, *_ in rows):
        inside = [r for r in rows if x <= r[0] and r[1] <= y]
        longest = max(n for _, _, _, n, _, _ in inside)
        best: dict[int, tuple] = {}
        for _, _, item, n, p, size in inside:
            if n == longest:
                best[p] = min(best.get(p, (size, item is None, item)), (size, item is None, item), key=lambda k: (k[0], k[1], k[2] or 0))
        out.append((x, y, min((k[2] for k in best.values()), key=lambda i: (i is None, i or 0)), longest))
    return out


def across(found: list[DataFrame], schema: str) -> DataFrame:
    """The spans of several automata, put together by document; repeated rows have theirs as often as they are there."""
    rows = found[0].withColumn("part", F.lit(0))
    for k, more in enumerate(found[1:], 1):
        rows = rows.unionByName(more.withColumn("part", F.lit(k)))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    of_row = F.struct("start_word", "end_word", "item_id", "match_words", "match_start", "item_words")
    lists = rows.groupBy("doc_id", "text_hash", "text_key").agg(F.max("times").alias("times"), F.collect_list(of_row).alias("rows"))

    def join(b: pa.RecordBatch) -> pa.RecordBatch:
        at, spans = [], []
        for i, (times, own) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
            new = joined(tuple(r.values()) for r in own) * times
            at.extend([i] * len(new))
            spans.extend(new)
        return span_batch(b.column(0), b.column(1), at, spans)

    return arrow_map(lists, join, schema)


def span_batch(ids: pa.Array, hashes: pa.Array, at: list[int], spans: list[tuple]) -> pa.RecordBatch:
    rows = pa.array(at, pa.int64())
    columns = [ids.take(rows), hashes.take(rows), *(pa.array([s[k] for s in spans], pa.int64()) for k in range(4))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "start_word", "end_word", "item_id", "match_words"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, item_id, match_words): the spans of words to remove, ``end_word`` excluded;
    ``match_words`` is the longest match in it and ``item_id`` the shortest item with that (ties: the least item_id).

    Items under ``least_words`` words are found whole; those under SHORT_WORDS, empty and null ones are not searched for; repeated items count once each, ties
    going to the least item_id, null last.  Null doc_id: searched like any other row.  Null or empty text: no
    spans.  Repeated rows have their spans once each.  Empty documents or benchmark: no rows.
    """
    schema = "doc_id bigint, text_hash bigint, start_word bigint, end_word bigint, item_id bigint, match_words bigint"
    spark, tok = docs.sparkSession, Tokeniser()
    docs = text_input(docs).where("text is not null").withColumn("text_hash", F.expr("xxhash64(text) & 2147483647")).withColumn("text_key", F.xxhash64("text"))

    def chunks() -> Iterator[list[tuple[int | None, list[int]]]]:
        items, total = [], 0
        for row in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
            words = tok([row.text])[0].tolist()
            if len(words) >= SHORT_WORDS:
                items.append((row.item_id, words))
                total += len(words)
            if total >= chunk_words:
                yield items
                items, total = [], 0
        if items:
            yield items

    parts = [spark.sparkContext.broadcast(items) for items in chunks()]
    if not parts:
        return spark.createDataFrame([], schema)
    single, run = len(parts) == 1, uuid.uuid4().hex
    found = []
    for k, shared in enumerate(parts):

        def scan(b: pa.RecordBatch, state: dict = {}, k=k, shared=shared) -> pa.RecordBatch | None:  # noqa: B006 - one tokeniser a task
            tok, built = state.setdefault("tok", Tokeniser()), built_once((run, k), shared.value, max_words, coverage, least_words)
            texts, rows = b.column(1).to_pylist(), []
            for i, j in slices(texts):
                h, off = tok(texts[i:j])
                rows.extend((i + d, *rest) for d, *rest in find(h, off, built))
            if not rows:
                return None
            if single:
                rows = [(d, *span) for d, own in groupby(rows, itemgetter(0)) for span in joined(r[1:] for r in own)]
                return span_batch(b.column(0), b.column(2), [r[0] for r in rows], [r[1:] for r in rows])
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [*(b.column(k).take(at) for k in (0, 2, 3)), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "text_key", "start_word", "end_word", "item_id", "match_words", "match_start", "item_words"])

        raw = "doc_id bigint, text_hash bigint, text_key bigint, start_word bigint, end_word bigint, item_id bigint, match_words bigint, match_start bigint, item_words bigint"
        found.append(arrow_map(docs, scan, schema if single else raw))
    return found[0] if single else across(found, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """Documents without the spans of ``contaminated_spans``; one of which nothing is left goes."""
    return cut_spans(docs, contaminated_spans(docs, benchmark, **limits))


def oracle(max_words: int = MAX_WORDS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS) -> str:
    """SQL for the rows of ``contaminated_spans`` without text_hash: runs of each item's limit are looked up, put together along
    diagonals to whole matches, and matches that meet to spans."""
    words = r"regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}_]+')"
    gram = "md5(array_to_string(w[p:p + lim - 1], ' '))"
    return f"""
WITH items AS (
  SELECT item_id, w, len(w) AS n, CAST(least(len(w), {max_words}, greatest({least_words}, ceil({coverage} * len(w) - 1e-9))) AS BIGINT) AS lim
  FROM (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) >= {SHORT_WORDS}),
docs AS (SELECT doc_id, w, lim FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), (SELECT DISTINCT lim FROM items)),
item_runs AS (SELECT item_id, n, lim, p AS q, {gram} AS g FROM (SELECT *, unnest(generate_series(1, n - lim + 1)) AS p FROM items)),
doc_runs AS (SELECT doc_id, lim, p, {gram} AS g FROM (SELECT *, unnest(generate_series(1, len(w) - lim + 1)) AS p FROM docs WHERE len(w) >= lim)),
hits AS (SELECT DISTINCT doc_id, item_id, n, d.lim, p, p - q AS diagonal FROM doc_runs d JOIN item_runs i ON d.lim = i.lim AND d.g = i.g),
matches AS (
  SELECT doc_id, item_id, n, min(p) - 1 AS a, max(p) - 1 + lim AS z
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM hits) GROUP BY doc_id, item_id, n, lim, diagonal, run),
best AS (SELECT doc_id, a, z, arg_min(item_id, n * 1000000000 + item_id) AS item_id FROM matches GROUP BY doc_id, a, z),
marks AS (SELECT *, coalesce(a > max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM best),
spans AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM marks),
longest AS (SELECT doc_id, k, min(a) AS a, max(z) AS z, max(z - a) AS m FROM spans GROUP BY doc_id, k)
SELECT l.doc_id, l.a AS start_word, l.z AS end_word, (SELECT min(s.item_id) FROM spans s WHERE s.doc_id = l.doc_id AND s.k = l.k AND s.z - s.a = l.m) AS item_id, l.m AS match_words
FROM longest l
"""
