"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Tokens are runs of letters and digits, told apart by being all capitals or not, and runs of one punctuation mark, as a page
of marks reads differently from prose.  The vocabulary is hashed to ``BUCKETS`` words.  Random indexing: each word has a sparse random
index vector, and its word vector is the sum of the index vectors of the words within ``REACH`` places of it, over the whole
corpus.  A document is the mean and the deviation of its words' vectors, and how far neighbours
agree, and the mark of its most toxic word, learnt from ``labels.toxic``; the network gives a logit, which a
temperature fitted on held-out rows turns into a probability.  Toxic counts as bad.

Scale: the word vectors are one table of fixed size (``BUCKETS`` x ``DIMS`` counts), added up on the executors by at most ``TASKS``
tasks, each over many splits, and then in parts; only its sum reaches the driver.  The network is fitted on at most ``SAMPLE`` labelled rows, those whose doc_id hashes lowest.
Scoring is a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.base import DOCUMENT_COLUMNS, arrow_map, staged, text_input
from logmill.llm.tokens import mix64, slices

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
PARTS = 64
TASKS = 4096
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.5
FEATURES = 2 * DIMS + 1
MARKS = 1 << 20  # buckets of the toxic words, whose low bits are those of BUCKETS
LEAST_TOXIC = 5  # labelled toxic documents that must have a word
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


class Words:
    """Splits texts into tokens and hashes them to buckets, a batch at a time."""

    def __init__(self) -> None:
        b = np.arange(256)
        self.upper = (b >= 65) & (b <= 90)
        letter = (b >= 128) | (b >= 48) & (b <= 57) | self.upper | (b >= 97) & (b <= 122)
        # one class for space, one for letters, one for each mark
        self.kind = np.where(letter, 1, np.where(b <= 32, 0, b + 2)).astype(np.uint8)
        self.value = (np.where(self.upper, b + 32, b) + 1).astype(_U)
        self.power = self.inverse = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base & (2**64 - 1), _U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each token, offsets of the texts)."""
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self._powers(len(raw) + 1)
        kind = self.kind[raw]
        edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        stop = np.append(edge[1:], len(raw))
        word = kind[edge] != 0
        edge, stop = edge[word], stop[word]
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=sums[1:])
        capitals = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(self.upper[raw], out=capitals[1:])
        size = stop - edge
        shouted = (size > 1) & (capitals[stop] - capitals[edge] == size)
        h = mix64((sums[stop] - sums[edge]) * self.inverse[edge] + shouted.astype(_U) * _U(0xD6E8FEB86659FD93))
        return (h >> _U(40)).astype(np.int64) & (buckets - 1), np.concatenate(([0], np.searchsorted(edge, ends)))


@lru_cache(1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the ``NONZERO`` entries of each bucket's index vector."""
    rng = np.random.default_rng(9)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_sums(w: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the index vectors of the words within REACH places in the same document."""
    places, signs = index_vectors()
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cells, values = np.empty((2 * REACH * len(w), NONZERO), np.int64), np.empty((2 * REACH * len(w), NONZERO))
    n = 0
    for o in range(1, REACH + 1):
        together = np.flatnonzero(doc[o:] == doc[:-o])
        for a, b in ((w[together], w[together + o]), (w[together + o], w[together])):
            np.add(a[:, None] * DIMS, places[b], out=cells[n : n + len(a)])
            np.take(signs, b, axis=0, out=values[n : n + len(a)])
            n += len(a)
    return np.bincount(cells[:n].ravel(), values[:n].ravel(), BUCKETS * DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (BUCKETS x DIMS) from all documents; zero for a bucket without context."""
    cells = BUCKETS * DIMS // PARTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(BUCKETS * DIMS)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                w, off = words(texts[i:j])
                if len(w) > 1:
                    total += context_sums(w, off)
        if total.any():
            table = total.astype(np.int64).reshape(PARTS, cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), pa.array([x.tobytes() for x in table], pa.binary())], ["part", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(sums, np.int64)
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])

    schema = "part bigint, sums binary"
    out = np.zeros((PARTS, cells))
    # a task sends 4 MB whatever it read, so their number must not grow with the input
    for row in text_input(docs).coalesce(TASKS).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():
        out[row.part] = np.frombuffer(row.sums, np.int64)
    out = out.reshape(BUCKETS, DIMS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(w: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of each document's word vectors, and the mean product of neighbours; zeros without words."""
    size = np.diff(offsets)
    out = np.zeros((len(size), FEATURES))
    full = np.flatnonzero(size)
    if len(full):
        v = vectors[w]
        mean = np.add.reduceat(v, offsets[:-1][full], axis=0) / size[full, None]
        square = np.add.reduceat(v * v, offsets[:-1][full], axis=0) / size[full, None]
        alike = np.append(np.einsum("ij,ij->i", v[1:], v[:-1]), 0)
        alike[offsets[1:][full] - 1] = 0  # the last word has no neighbour behind it
        out[full, :DIMS], out[full, DIMS : 2 * DIMS] = mean, np.sqrt(np.maximum(square - mean.astype(np.float64) ** 2, 0))
        out[full, -1] = np.add.reduceat(alike, offsets[:-1][full]) / np.maximum(size[full] - 1, 1)
    return out


def toxic_mark(toxic: int, clean: int) -> float:
    """A cautious share of toxic documents among the labelled ones that have a word: Wilson's lower bound, three deviations."""
    n, z = toxic + clean, 3.0
    p = toxic / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def featured(w: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """``pooled`` and the greatest mark of a document's words, given by MARKS: a few insults don't show in a mean."""
    worst = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        worst[full] = np.maximum.reduceat(marks[w], offsets[:-1][full])
    return np.column_stack((pooled(w & (BUCKETS - 1), offsets, vectors), worst))


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def gradients(params: list[np.ndarray], a: np.ndarray, t: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean cross-entropy of a batch plus half of ``decay`` times the squared weights, by w1, b1, w2, b2."""
    z = np.tanh(a @ params[0] + params[1])
    g = (1 / (1 + np.exp(-np.clip(z @ params[2] + params[3][0], -40, 40))) - t) / len(a)
    back = np.outer(g, params[2]) * (1 - z * z)
    return [a.T @ back + decay * params[0], back.sum(0), z.T @ g + decay * params[2], np.array([g.sum()])]


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, hidden: int = HIDDEN) -> Network:
    """Two layers by Adam on four fifths of the rows, the temperature on the fifth.  With one class or no rows, a
    network that gives the share of good rows (1 without rows)."""
    n, d = x.shape
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if n else (np.zeros(d), np.ones(d))
    rng = np.random.default_rng(7)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    if n < 10 or y.min() == y.max():
        share = y.mean() if n else 1.0
        net.w2, net.b2 = np.zeros(hidden), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return net
    held = np.arange(n) % 5 == 4
    xs, ys = (x[~held] - mean) / scale, y[~held]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for k in range(0, len(xs), 256):
            a, t = xs[order[k : k + 256]], ys[order[k : k + 256]]
            step += 1
            for i, grad in enumerate(gradients(params, a, t)):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                params[i] = params[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, t = net.logit(x[held]), y[held]
    choices = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    # smoothed targets: a few held-out rows that are all right don't make the network certain
    good = t.sum()
    aim = np.where(t > 0, (good + 1) / (good + 2), 1 / (len(t) - good + 2))
    losses = [np.mean(np.logaddexp(0, logits / c) - aim * logits / c) for c in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


def targets(labels: DataFrame, sample: int) -> dict[int, tuple[int, int]]:
    """(good, toxic) of at most ``sample`` labelled doc_ids: good is quality 1 without a toxic label."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), (F.col("toxic").cast("int").eqNullSafe(1)).cast("int").alias("toxic"))
    chosen = (
        known.where("doc_id is not null and (quality in (0, 1) or toxic = 1)").groupBy("doc_id")
        .agg(F.min(F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality"))).alias("good"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    return {r.doc_id: (r.good, r.toxic) for r in chosen.collect()}


def labelled(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, features, good or not, marks) of at most ``sample`` labelled documents, in the order of doc_id."""
    rows = targets(labels, sample)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, FEATURES + 1)), np.zeros(0), np.zeros(MARKS, np.float32)
    spark = docs.sparkSession
    # bounded by ``sample``, so it may be broadcast at any size of the corpus
    wanted = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(rows), pa.int64()), "toxic": pa.array([rows[i][1] for i in sorted(rows)], pa.int64())}).to_pandas())
    # written once, so that marks and features don't each read the corpus
    texts = staged(text_input(docs).where("text is not null").join(F.broadcast(wanted), "doc_id"), "labelled")

    def count(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch:  # noqa: B006
        words, texts, toxic, cells = state.setdefault("words", Words()), b.column(1).to_pylist(), b.column(2).to_numpy(), []
        for i, j in slices(texts):
            w, off = words(texts[i:j], MARKS)
            pairs = np.unique(np.repeat(np.arange(j - i), np.diff(off)) * MARKS + w)
            cells.append(toxic[i:j][pairs // MARKS] * MARKS + pairs % MARKS)
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cell % MARKS), pa.array(np.where(cell < MARKS, n, 0)), pa.array(np.where(cell < MARKS, 0, n))], ["word", "clean", "toxic"])

    marks = np.zeros(MARKS, np.float32)
    if any(toxic for _, toxic in rows.values()):
        counts = arrow_map(texts, count, "word bigint, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        for r in counts.where(F.col("toxic") >= LEAST_TOXIC).collect():
            marks[r.word] = toxic_mark(r.toxic, r.clean)
    shared = spark.sparkContext.broadcast((vectors, marks))

    def features(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch:  # noqa: B006 - one splitter a worker
        words, texts = state.setdefault("words", Words()), b.column(1).to_pylist()
        rows = [x.astype(np.float32).tobytes() for i, j in slices(texts) for x in featured(*words(texts[i:j], MARKS), *shared.value)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["doc_id", "x"])

    found = {}
    for r in arrow_map(texts, features, "doc_id bigint, x binary").collect():
        found[r.doc_id] = min(found.get(r.doc_id, bytes(r.x)), bytes(r.x))
    ids = sorted(found)
    x = np.array([np.frombuffer(found[i], np.float32) for i in ids], np.float64).reshape(len(ids), FEATURES + 1)
    return np.array(ids, np.int64), x, np.array([rows[i][0] for i in ids], float), marks


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, Network]:
    vectors = word_vectors(docs)
    _, x, y, marks = labelled(docs, labels, vectors, sample)
    return vectors, marks, fit(x, y)


def _scorer(model):
    def score(texts: list[str | None], state: dict) -> np.ndarray:
        words, (vectors, marks, net) = state.setdefault("words", Words()), model.value
        out = np.zeros(len(texts))
        for i, j in slices(texts):
            w, off = words(texts[i:j], MARKS)
            out[i:j] = np.where(np.diff(off) > 0, net.probability(featured(w, off, vectors, marks)), 0)
        return out

    return score


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, probability, keep), a row for each row of ``docs``: the calibrated probability of good quality
    and no toxicity.

    Null and empty texts and those without a token: probability 0, so they are rejected.  Null doc_id: scored like any
    other row, not learnt from.  Repeated rows score alike; of a doc_id with several texts one is learnt from.  A doc_id with
    both labels, or with toxic = 1, counts as bad; null or other labels are ignored.  No labels: probability 1 (keep everything that
    has a token).  Empty table: no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    score = _scorer(model)

    def each(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch:  # noqa: B006
        p = score(b.column(1).to_pylist(), state)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "probability", "keep"])

    return arrow_map(text_input(docs), each, "doc_id bigint, probability double, keep boolean")


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Documents (their columns) that the classifier accepts; see ``scores``."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    score = _scorer(docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)))

    def each(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch:  # noqa: B006
        return b.filter(pa.array(score(b.column(1).cast(pa.string()).to_pylist(), state) >= threshold))

    return arrow_map(docs, each, docs.schema)
