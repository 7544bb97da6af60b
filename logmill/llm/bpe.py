"""Byte-level BPE encoding and decoding.

A text is split into pieces by the vocabulary's pattern; a piece starts as one token a byte, and the pair of neighbours
whose union has the lowest rank, the leftmost of equals, is merged until no pair is in the vocabulary.  A segment
tree over the byte positions holds, in each leaf, rank and position of the pair that begins there; the root is the leftmost
minimum.  A merge updates the leaves of the merged token, of its live neighbour before it and of the one
that vanished, each in logarithmic time.

Pieces of up to ``SHORT`` bytes are encoded many at a time, their trees being the rows of one array; longer ones have a tree
each.  Equal pieces are encoded once: a worker keeps the ids of ``CACHE`` pieces (memory, not a limit on the input).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 32
CACHE = 400_000
NONE = 1 << 62
_SHIFT = 40


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a line "base64 rank" for each token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        if len(self.bytes_of) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes and a rank for each token alone")
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to put a token together from two: (left << 32 | right) to the token
        pairs = [((x << 32) | y, i) for t, i in ranks.items() for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        pairs.sort()
        self.keys, self.merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.pair = dict(pairs)
        self.slots, self.slot_bits = self._hash_table()
        self.cache: dict[str, bytes] = {}

    def _hash_table(self):
        """Open addressing over ``keys``: the position of a key is found by few probes on whole arrays."""
        bits = max(4, (2 * max(1, len(self.keys)) - 1).bit_length() + 1)
        slots = np.full(1 << bits, -1, np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys, bits)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of several for one slot the last stays
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << bits) - 1)
        return slots, bits

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair, NONE without one (also where a side is negative)."""
        out = np.full(len(left), NONE, np.int64)
        if not len(self.keys):
            return out
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[todo] << 32) | right[todo]
        at = self._slot(key, self.slot_bits)
        while len(todo):
            found = self.slots[at]
            hit = (found >= 0) & (self.keys[found] == key)
            out[todo[hit]] = self.merged[found[hit]]
            more = (found >= 0) & ~hit
            todo, key, at = todo[more], key[more], (at[more] + 1) & ((1 << self.slot_bits) - 1)
        return out

    def encode_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of up to SHORT bytes, their trees side by side."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        width = 1 << max(1, int(size.max() - 1).bit_length()) if n else 2
        token = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < size[:, None]
        token[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        place = np.arange(width + 1)
        behind, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.rank_of(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < NONE, (rank << _SHIFT) | place[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)

        def update(r: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            node = leaf + width
            tree[r, node] = value
            while node[0] > 1 if len(node) else False:  # all leaves are at one depth
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while len(rows):
            root = tree[rows, 1]
            at, new = root & ((1 << _SHIFT) - 1), root >> _SHIFT
            gone = behind[rows, at]
            after = behind[rows, gone]
            token[rows, at] = new
            token[rows, gone] = -1
            behind[rows, at] = after
            before[rows, np.minimum(after, width)] = at
            update(rows, gone, NONE)
            right = self.rank_of(new, np.where(after <= width, token[rows, np.minimum(after, width)], -1))
            update(rows, at, np.where(right < NONE, (right << _SHIFT) | at, NONE))
            prior = before[rows, at]
            has = prior >= 0
            r, p = rows[has], prior[has]
            left = self.rank_of(token[r, p], new[has])
            update(r, p, np.where(left < NONE, (left << _SHIFT) | p, NONE))
            rows = rows[tree[rows, 1] < NONE]
        ids = token[token >= 0]
        return np.split(ids.astype(np.uint32), np.cumsum((token >= 0).sum(axis=1))[:-1]) if n else []

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length, with a tree of its own."""
        n, pair = len(piece), self.pair
        width = 1 << max(1, (n - 1).bit_length())
        token = self.first[np.frombuffer(piece, np.uint8)].tolist()
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank_of(np.array(token[:-1], np.int64), np.array(token[1:], np.int64))
        levels = np.full(2 * width, NONE, np.int64)
        levels[width : width + n - 1] = np.where(rank < NONE, (rank << _SHIFT) | np.arange(n - 1), NONE)
        level = width
        while level > 1:
            levels[level // 2 : level] = np.minimum(levels[level : 2 * level : 2], levels[level + 1 : 2 * level : 2])
            level //= 2
        tree = levels.tolist()

        def update(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                least = value if value < other else other
                if tree[node] == least:
                    return
                tree[node] = value = least

        mask = (1 << _SHIFT) - 1
        while (root := tree[1]) < NONE:
            at, new = root & mask, root >> _SHIFT
            gone = behind[at]
            after = behind[gone]
            token[at], token[gone], behind[at] = new, -1, after
            update(gone, NONE)
            if after < n:
                before[after] = at
                r = pair.get((new << 32) | token[after])
                update(at, NONE if r is None else (r << _SHIFT) | at)
            else:
                update(at, NONE)
            if (p := before[at]) >= 0:
                r = pair.get((token[p] << 32) | new)
                update(p, NONE if r is None else (r << _SHIFT) | p)
        return np.array([t for t in token if t >= 0], np.uint32)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces that the cache lacks."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            if len(raw) == 1 or raw in self.ranks:
                self.cache[p] = np.uint32(self.ranks[raw]).tobytes()  # a token of its own can't be cut otherwise: see encode
            elif len(raw) <= SHORT:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
            else:
                self.cache[p] = self.encode_long(raw).tobytes()
        for group in by_width.values():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                for (p, _), ids in zip(part, self.encode_rows([raw for _, raw in part])):
                    self.cache[p] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text.  A piece that is a token is that token, as in the public encoders of these vocabularies."""
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            pieces, total = [], 0
            while k < len(texts) and total < 500_000:
                pieces.append(self.split(texts[k]))
                total += len(pieces[-1])
                k += 1
            wanted = set().union(*pieces)
            missing = [p for p in wanted if p not in self.cache]
            if missing and len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
                missing = list(wanted)
            self.learn(missing)
            get = self.cache.__getitem__
            out.extend(np.frombuffer(b"".join(map(get, p)), np.uint32) for p in pieces)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    """The codec of a vocabulary file, made once in a process."""
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path))
    return _codecs[path]


def id_lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    """Token ids as an Arrow array of lists of int32."""
    sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.uint32)]).astype(np.int32)
    mask = pa.array([x is None for x in ids]) if any(x is None for x in ids) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, *keep: str) -> DataFrame:
    """(doc_id, keep..., token_ids, n_tokens, round_trip), a row for each row of ``docs``.

    ``round_trip`` tells that decoding ``token_ids`` gives the text again.  Null text: token_ids, n_tokens and
    round_trip null.  Empty text: no tokens, true.  Null doc_id, repeated rows: like any other row.  Empty table: no rows.
    The vocabulary file must be readable at ``vocabulary`` on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    schema = docs.drop("text").schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("round_trip", T.BooleanType())
    names = ["doc_id", *keep]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                texts = b.column(b.num_columns - 1).to_pylist()
                found = iter(c.encode([t for t in texts if t is not None]))
                ids = [None if t is None else next(found) for t in texts]
                trip = [None if t is None else c.decode(x.tolist()) == t for t, x in zip(texts, ids)]
                columns = [b.column(k) for k in range(len(names))]
                columns += [id_lists(ids), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(trip, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(each, schema)


def decode_documents(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids give a null text, no ids an empty one."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            texts = [None if ids is None else c.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "token_ids").mapInArrow(each, "doc_id bigint, text string")
