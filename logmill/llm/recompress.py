"""Substring deduplication by recompression.

Words get 64-bit names.  Rounds then rename the text: the first names runs of one word (in chunks of at most ``RUN``
words); every round splits the alphabet in two by a bit of the name and names each pair "left, right".  A name
is a hash of the names below it, so it is the same for the same words in every document and on
every executor: no round has to hand out numbers.  A pair depends on its two members alone, a symbol that stays on
one neighbour; ``lo`` and ``hi`` bound the words that a symbol's existence depends on.  Equal substrings therefore have
equal symbols wherever those bounds lie within them, whatever surrounds them.

1. ``LEVELS`` rounds, then one shuffle brings equal high-level symbols together and finds those that two documents share.
2. A window of ``min_words`` words can only repeat if every symbol bound within it is shared.  Such windows - few outside
   repeated passages - are hashed whole, to 128 bits, and a second shuffle finds, for each, the least doc_id that has it.
3. A window that a lesser doc_id has too is repeated; the union of a document's repeated windows is removed.

The test in 2 is a necessary condition, so the result is that of comparing all windows of all documents.
Shuffled are the symbols (about a tenth of the words), the texts once, and the windows that pass.

A passage may stand in a third of all documents.  Where many rows of a batch have a window, the one of the least doc_id stands for them in
the shuffle; the others go under a key of their batch and learn from it, by a join with unique keys, what it has learnt.  No
task gets more rows of a window than there are batches, and some ``HOT`` from each where it is rarer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.llm.base import DOCUMENT_COLUMNS, arrow_map, cut_words, merged, text_input
from logmill.llm.tokens import Tokeniser, mix64, slices

MIN_WORDS = 50
LEVELS = 7
RUN = 16
LEAST_SPAN = 3
HOT = 16
_MOST = (1 << 63) - 1
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def _runs(name, doc, start, end, lo, hi, first, last):
    """Names runs of equal words, in chunks of RUN from where the run begins."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    place = np.arange(n) - at[run]
    length = np.diff(np.append(at, n))[run]
    head = np.flatnonzero(place % RUN == 0)
    size = np.minimum(RUN, length[head] - place[head])
    full = size == RUN
    tail = head + size - 1
    named = np.where(size > 1, mix64(name[head] * _A + size.astype(_U) * _B + _C), name[head])
    # that the run begins here depends on the word before it, that a chunk is short on the word behind it
    return named, doc[head], start[head], end[tail], start[at[run[head]]] - 1, np.where(full, end[tail], end[tail] + 1)


def symbols(h: np.ndarray, doc: np.ndarray, offsets: np.ndarray, levels: int = LEVELS):
    """(name, doc, start, end, lo, hi) of the symbols after ``levels`` rounds, in the order of the text.

    ``h``: the words' names; ``doc``: each word's document, ``offsets`` of documents in words.  Words are counted through
    all documents.  A symbol that depends on a document's begin or end has bounds beyond it.
    """
    first, last = offsets[:-1], offsets[1:]
    start = np.arange(len(h), dtype=np.int64)
    name, doc, start, end, lo, hi = _runs(h, doc, start, start + 1, start, start + 1, first, last)
    for r in range(levels):
        n = len(name)
        if n < 2:
            break
        right = (mix64(name + _U(r + 1) * _C) >> _U(17)) & _U(1) == 1
        near = doc[1:] == doc[:-1]
        pair = ~right[:-1] & right[1:] & near
        joined = np.flatnonzero(pair)
        second = np.zeros(n, bool)
        second[joined + 1] = True
        # what stays as it is depends on a neighbour: a left one on the one behind it, a right one on the one before
        before, behind = start - 1, end + 1
        before[1:] = np.where(near, lo[:-1], before[1:])
        behind[:-1] = np.where(near, hi[1:], behind[:-1])
        new_lo = np.where(right, np.minimum(lo, before), lo)
        new_hi = np.where(right, hi, np.maximum(hi, behind))
        new_lo[joined] = np.minimum(lo[joined], lo[joined + 1])
        new_hi[joined] = np.maximum(hi[joined], hi[joined + 1])
        end = end.copy()
        end[joined] = end[joined + 1]
        name = name.copy()
        name[joined] = mix64(name[joined] * _A + name[joined + 1] * _B + _U(r + 1))
        keep = ~second
        name, doc, start, end, lo, hi = name[keep], doc[keep], start[keep], end[keep], new_lo[keep], new_hi[keep]
    return name, doc, start, end, lo, hi


def _parsed(texts: list[str | None], min_words: int, levels: int, tokeniser: Tokeniser):
    """For slices of the texts: (i, words, offsets, document of each symbol, symbol's place in it, name, lo, hi) of the
    symbols that have LEAST_SPAN words and bounds within the document and within a window."""
    for i, j in slices(texts):
        h, offsets = tokeniser(texts[i:j])
        if not len(h):
            continue
        doc = np.repeat(np.arange(j - i), np.diff(offsets))
        name, d, start, end, lo, hi = symbols(h, doc, offsets, levels)
        place = np.arange(len(name)) - np.searchsorted(d, np.arange(j - i))[d]
        use = (end - start >= LEAST_SPAN) & (hi - lo <= min_words) & (lo >= offsets[d]) & (hi <= offsets[d + 1])
        use &= (np.diff(offsets) >= min_words)[d]
        yield i, h, offsets, d[use], place[use], name[use], lo[use], hi[use]


def _combined(name: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows (name, doc_id, place, known) for the shuffle, in which no name is hot.

    A symbol that two documents of the batch have is known to be shared.  Its occurrences go under keys of their own, and two
    rows without a place, of its least and greatest doc_id, tell other batches of it.
    """
    order = np.argsort(name, kind="stable")
    name, owner, place = name[order], owner[order], place[order]
    new = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    least, most = np.minimum.reduceat(owner, new), np.maximum.reduceat(owner, new)
    known = np.repeat(least < most, np.diff(np.append(new, len(name))))
    own = mix64(name ^ mix64(owner.astype(np.uint64) * _A + place.astype(np.uint64) * _B))
    told = np.flatnonzero(least < most)
    columns = (
        np.concatenate((np.where(known, own, name), name[new][told], name[new][told])).view(np.int64),
        np.concatenate((owner, least[told], most[told])),
        np.concatenate((place, np.full(2 * len(told), -1))).astype(np.int32),
        np.concatenate((known, np.ones(2 * len(told), bool))),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "doc_id", "place", "known"])


def _parted(window: np.ndarray, check: np.ndarray, owner: np.ndarray, at: np.ndarray, hot: int) -> pa.RecordBatch:
    """Rows (window, check, doc_id, at, batch_key) for the shuffle.  Of ``hot`` or more rows of a window the least one has its
    batch_key, a key for it in this batch; the others have it for both."""
    order = np.lexsort((at, owner, check, window))
    window, check, owner, at = window[order], check[order], owner[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1]) | (check[1:] != check[:-1]))))
    size = np.diff(np.append(new, len(window)))
    many = np.repeat(size >= hot, size)
    first = np.repeat(owner[new], size).astype(_U)
    own = mix64(window.view(_U) ^ mix64(first * _A + _C)).view(np.int64)
    follows = many.copy()
    follows[new] = False
    columns = [pa.array(np.where(follows, own, window)), pa.array(check), pa.array(owner), pa.array(at), pa.array(own, mask=~many)]
    return pa.RecordBatch.from_arrays(columns, ["window", "check", "doc_id", "at", "batch_key"])


_W = _U(0xD6E8FEB86659FD93)


class _Windows:
    """128-bit hashes of all windows of n words, by prefix sums: two sums over independently mixed words."""

    def __init__(self, n: int) -> None:
        self.n, self.power, self.inverse = n, np.ones(1, _U), np.ones(1, _U)

    def __call__(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the hash of each window that begins at one of ``at``."""
        if len(self.power) < len(h):
            m = 1 << (len(h) - 1).bit_length()
            for name, base in (("power", int(_W)), ("inverse", pow(int(_W), -1, 1 << 64))):
                p = np.full(m, base, _U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        out = []
        for words in (h, mix64(h ^ _C)):
            sums = np.zeros(len(h) + 1, _U)
            np.cumsum(words * self.power[: len(h)], out=sums[1:])
            out.append(mix64((sums[at + self.n] - sums[at]) * self.inverse[at]))
        return out[0], out[1]


def _comparable(docs: DataFrame, min_words: int) -> DataFrame:
    """Documents that can hold a window: n words take 2n-1 characters of ASCII at least; beyond ASCII a character may be several."""
    long = (F.length("text") >= 2 * min_words - 1) | (F.octet_length("text") > F.length("text"))
    return text_input(docs).where(F.col("doc_id").isNotNull() & long)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, levels: int = LEVELS, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, first_doc_id): maximal spans of words, ``end_word`` excluded, in which every
    window of ``min_words`` words also occurs in a document with a lesser doc_id; ``first_doc_id`` is the least such.

    The least doc_id that has a passage keeps it, so one copy always stays.  Passages that repeat within one document
    alone stay.  Null doc_id or null text: neither searched nor cut.  Texts under ``min_words`` words, empty ones
    among them, have no spans.  Rows that repeat a doc_id count as one document; where their texts differ,
    ``text_hash`` (31 bits of xxhash64) tells which has the span.  Empty table: no rows.
    """
    base = _comparable(docs, min_words)

    def emit(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch | None:  # noqa: B006 - one tokeniser a worker
        tok = state.setdefault("tok", Tokeniser())
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        names, owners, places = [], [], []
        for i, _, _, d, place, name, _, _ in _parsed(b.column(1).to_pylist(), min_words, levels, tok):
            names.append(name)
            owners.append(ids[i + d])
            places.append(place.astype(np.int64))
        if not any(map(len, names)):
            return None
        return _combined(*map(np.concatenate, (names, owners, places)))

    found = arrow_map(base, emit, "name bigint, doc_id bigint, place int, known boolean")
    by_name = Window.partitionBy("name")
    shared = (
        found.withColumn("least", F.min("doc_id").over(by_name)).withColumn("most", F.max("doc_id").over(by_name))
        .where("place >= 0 and (known or least < most)").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    )
    marked = base.join(shared, "doc_id", "left").select("doc_id", "text", F.expr("cast(xxhash64(text) & 2147483647 as bigint)").alias("v"), "places")

    def windows(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch | None:  # noqa: B006
        tok = state.setdefault("tok", Tokeniser())
        hashed = state.setdefault("windows", _Windows(min_words))
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        versions = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = b.column(3)
        flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        hashes, checks, owners, at = [], [], [], []
        for i, h, offsets, d, place, _, lo, hi in _parsed(b.column(1).to_pylist(), min_words, levels, tok):
            n = len(h)
            if n < min_words:
                continue
            k = len(offsets) - 1
            # a symbol is shared when its place is in its document's list
            listed = flat[bounds[i] : bounds[i + k]].astype(np.int64)
            of = np.repeat(np.arange(k), np.diff(bounds[i : i + k + 1]))
            alone = ~np.isin((d << 32) | place, (of << 32) | listed)
            # an unshared symbol rules out the windows that hold it: those from hi - min_words to lo
            delta = np.zeros(n + 2, np.int32)
            np.add.at(delta, np.maximum(hi[alone] - min_words, 0), 1)
            np.add.at(delta, lo[alone] + 1, -1)
            starts = np.flatnonzero(np.cumsum(delta[: n - min_words + 1]) == 0)
            owner = np.searchsorted(offsets, starts, "right") - 1
            inside = starts + min_words <= offsets[owner + 1]
            starts, owner = starts[inside], owner[inside]
            if not len(starts):
                continue
            for column, half in zip((hashes, checks), hashed(h, starts)):
                column.append(half.view(np.int64))
            owners.append(ids[i + owner])
            at.append((versions[i + owner] << 32) | (starts - offsets[owner]))
        if not hashes:
            return None
        return _parted(*map(np.concatenate, (hashes, checks, owners, at)), hot)

    # sorted, so that a task that runs again has the same batches and the same keys of batches
    ordered = marked.sortWithinPartitions("doc_id", "v")
    passed = arrow_map(ordered, windows, "window bigint not null, check bigint not null, doc_id bigint not null, at bigint not null, batch_key bigint").repartition("window", "check")
    # a condition isn't taken below a column of random numbers: with it, and with all columns named, branches share one shuffle
    passed = passed.withColumn("random", F.rand(1))

    def branch(condition: str) -> DataFrame:
        return passed.where(f"({condition}) and at >= 0 and check <= {_MOST} and doc_id <= {_MOST} and random >= 0").drop("random")

    of_window = ["window", "check"]
    plain = branch("batch_key is null or batch_key <> window")
    least = plain.groupBy(*of_window).agg(F.min("doc_id").alias("first_doc_id"), F.max("batch_key").alias("told")).where("told is not null").drop("told")
    told = branch("batch_key <> window").join(least, of_window).groupBy(F.col("batch_key").alias("window"), "check").agg(F.min("first_doc_id").alias("first_doc_id"))
    others = branch("batch_key = window").join(told, of_window).select("doc_id", "at", "first_doc_id")
    plain = plain.select("doc_id", "at", F.min("doc_id").over(Window.partitionBy(*of_window)).alias("first_doc_id"))
    repeated = (
        plain.unionByName(others).where("first_doc_id < doc_id").groupBy("doc_id", F.expr("at >> 32").alias("text_hash"))
        .agg(F.collect_list(F.expr("cast(at & 4294967295 as int)")).alias("at"), F.collect_list("first_doc_id").alias("firsts"))
    )

    def islands(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, versions = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        at, firsts = b.column(2), b.column(3)
        bounds = at.offsets.to_numpy()
        at, firsts = at.values.to_numpy(zero_copy_only=False).astype(np.int64), firsts.values.to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for i in range(b.num_rows):
            place, first = at[bounds[i] : bounds[i + 1]], firsts[bounds[i] : bounds[i + 1]]
            order = np.argsort(place, kind="stable")
            place, first = place[order], first[order]
            new = np.flatnonzero(np.concatenate(([True], np.diff(place) > min_words)))
            last = np.append(new[1:] - 1, len(place) - 1)
            for column, x in zip(out, (np.full(len(new), ids[i]), np.full(len(new), versions[i]), place[new], place[last] + min_words, np.minimum.reduceat(first, new))):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "text_hash", "start_word", "end_word", "first_doc_id"])

    return arrow_map(repeated, islands, "doc_id bigint, text_hash bigint, start_word bigint, end_word bigint, first_doc_id bigint", rows=1 << 30)


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (columns of documents) without the words of ``spans`` (doc_id, text_hash, start_word, end_word), which may overlap; n_chars is
    that of the new text.  A document of which no word is left goes; what has no span stays as it is."""
    lists = spans.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("spans"))
    docs = docs.select(*DOCUMENT_COLUMNS)
    keyed = docs.withColumn("text_hash", F.expr("xxhash64(cast(text as string)) & 2147483647"))
    names = [f.name for f in docs.schema.fields]
    joined = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left").select(*names, "spans")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        spans_of = b.column(len(names))
        if spans_of.null_count == b.num_rows:
            return b.select(names)
        columns = {n: b.column(n) for n in names}
        texts, counts, keep = columns["text"].to_pylist(), columns["n_chars"].to_pylist(), np.ones(b.num_rows, bool)
        for i, spans_i in enumerate(spans_of.to_pylist()):
            if spans_i and texts[i]:
                texts[i] = cut_words(texts[i], merged((x["start_word"], x["end_word"]) for x in spans_i))
                counts[i] = len(texts[i])
                keep[i] = any(c.isalnum() for c in texts[i])
        columns["text"], columns["n_chars"] = pa.array(texts, columns["text"].type), pa.array(counts, columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep))

    return joined.mapInArrow(lambda batches: (cut(b) for b in batches), docs.schema)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the passages that a document with a lesser doc_id has too; see ``repeated_spans``."""
    return cut_spans(docs, repeated_spans(docs, min_words))


def oracle(min_words: int = MIN_WORDS) -> str:
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {min_words} + 1)) AS p FROM words WHERE len(w) >= {min_words}),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {min_words - 1}], ' ')) AS h FROM places),
firsts AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS f FROM windows),
repeated AS (SELECT DISTINCT doc_id, p, f FROM firsts WHERE f < doc_id),
marks AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {min_words} THEN 0 ELSE 1 END AS new FROM repeated),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM marks)
SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS start_word, CAST(max(p) - 1 + {min_words} AS BIGINT) AS end_word, min(f) AS first_doc_id
FROM islands GROUP BY doc_id, k
"""
