import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from logmill.llm import bpe

RANKS = bpe.load_ranks()
CODEC = bpe.Codec(RANKS)
PUBLIC = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def plain_merge(ranks, piece):
    """Byte-pair merging by scanning for the leftmost least rank."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_as_the_public_encoder_and_back(text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = CODEC.encode([text])
    assert ids.tolist() == PUBLIC.encode_ordinary(text)
    assert CODEC.decode(ids.tolist()) == text


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=2, max_size=bpe.SHORT))
def test_both_trees_merge_like_a_plain_scan(piece):
    expected = plain_merge(RANKS, piece)
    assert CODEC.encode_rows([piece])[0].tolist() == expected == CODEC.encode_long(piece).tolist()


def test_ties_go_to_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaaa": 257, b"ab": 258}
    codec = bpe.Codec(ranks)
    for piece in (b"aaaaa", b"aab", b"aaab", b"abab" * 20 + b"aaa"):
        assert codec.encode_long(piece).tolist() == plain_merge(ranks, piece)
        if len(piece) <= bpe.SHORT:
            assert codec.encode_rows([piece, b"ba", piece])[0].tolist() == plain_merge(ranks, piece)


def test_very_long_pieces():
    rng = random.Random(1)
    for text in ("x" * 30_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), " " * 20_000, "日本語" * 5_000):
        (ids,) = CODEC.encode([text])
        assert CODEC.decode(ids.tolist()) == text
        if len(text) < 25_000:
            assert ids.tolist() == PUBLIC.encode_ordinary(text)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    codec = bpe.Codec(RANKS)
    texts = [f"word{i} other{i % 7} text" for i in range(200)]
    assert [x.tolist() for x in codec.encode(texts)] == [PUBLIC.encode_ordinary(t) for t in texts]


def test_vocabulary_must_be_byte_level():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0, b"b": 1})


def test_documents_and_round_trip(make_docs):
    rows = [(1, "Hello world"), (2, ""), (3, None), (None, "ñandú ☃ <|endoftext|>"), (1, "Hello world"), (4, "long " * 60_000)]
    got = bpe.encode_documents(make_docs(rows, token_ids="x", n_tokens="y"), bpe.VOCABULARY, "lang")
    assert got.columns == ["doc_id", "lang", "token_ids", "n_tokens", "round_trip"]
    expected = [(i, None if t is None else PUBLIC.encode_ordinary(t), None if t is None else True) for i, t in rows]
    out = got.collect()
    assert sorted(((r.doc_id, r.token_ids, r.round_trip) for r in out), key=repr) == sorted(expected, key=repr)
    back = bpe.decode_documents(got.where("doc_id is not null")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t) for i, t in rows if i is not None), key=repr)
    assert bpe.encode_documents(make_docs([])).count() == 0
