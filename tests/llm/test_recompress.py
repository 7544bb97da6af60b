import random
from collections import defaultdict

import numpy as np
import pytest

from logmill.llm import recompress
from logmill.llm.base import merged
from logmill.llm.tokens import Tokeniser, words_of

from .conftest import words


def brute(rows, n):
    first = {}
    texts = [(d, words_of(t)) for d, t in rows if d is not None and t is not None]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = set()
    for d, w in texts:
        out |= {(d, a, b) for a, b in merged((i, i + n) for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d)}
    return sorted(out)


def corpus(seed, vocabulary, docs=60):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(20, 120), vocabulary) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [words(rng, rng.randrange(0, 80), vocabulary)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(len(p))
            parts += [" ".join(p[a : a + rng.randrange(10, 120)]), words(rng, rng.randrange(0, 30), vocabulary)]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed, vocabulary, n", [(1, 4000, 50), (2, 30, 50), (3, 4000, 20), (4, 3, 50), (5, 8, 12)])
def test_spans_against_brute_force(make_docs, seed, vocabulary, n):
    rows = corpus(seed, vocabulary)
    got = recompress.repeated_spans(make_docs(rows), min_words=n)
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got.collect()) == brute(rows, n)


def test_runs_nulls_repeats_and_long_texts(make_docs):
    rng = random.Random(7)
    long = words(rng, 60_000)
    passage = words(rng, 55)
    rows = [
        (1, "and " * 70), (2, "the and " + "and " * 60), (3, "x " + "ab cd " * 40), (4, "y y " + "ab cd " * 33), (5, None), (6, ""), (None, passage), (7, passage), (8, "a b. " + passage.upper() + "; c"),
        (8, "a b. " + passage.upper() + "; c"), (9, long), (10, long[200:]), (11, passage + " tail"), (11, "other " + passage), (12, words(rng, 50)),
    ]
    docs = make_docs(rows, name="n", place="p", window="w", at="a")
    got = recompress.repeated_spans(docs)
    assert sorted({(r.doc_id, r.start_word, r.end_word) for r in got.collect()}) == brute(rows, 50)
    assert {r.doc_id for r in got.collect() if r.first_doc_id == 7} == {8, 11}
    cut = defaultdict(list)
    for r in recompress.drop_repeats(docs).collect():
        cut[r.doc_id].append(r.text)
    assert cut[8] == ["a b. c"] * 2 and sorted(cut[11]) == ["other ", "tail"] and cut[7] == [passage] and cut[None] == [passage]
    assert cut[5] == [None] and cut[6] == [""] and cut[12] == [rows[-1][1]]
    assert 10 not in cut or len(cut[10][0].split()) < 50


def test_equal_runs_have_equal_symbols_within_their_bounds():
    rng = random.Random(9)
    tok = Tokeniser()
    shared = words(rng, 200, 50)
    found = []
    for _ in range(2):
        text = words(rng, rng.randrange(30, 60), 50) + " " + shared + " " + words(rng, 40, 50)
        h, off = tok([text])
        at = len(words_of(text)) - 240
        name, _, start, end, lo, hi = recompress.symbols(h, np.zeros(len(h), np.int64), off)
        inside = (lo >= at) & (hi <= at + 200)
        found.append(set(zip(name[inside].tolist(), (start[inside] - at).tolist(), (end[inside] - at).tolist())))
    assert found[0] == found[1] and len(found[0]) > 5


def test_symbols_partition_the_words():
    h, off = Tokeniser()(["a b c d e f g h i j " * 9, "", "k k k k l m n", "z"])
    doc = np.repeat(np.arange(4), np.diff(off))
    _, d, start, end, lo, hi = recompress.symbols(h, doc, off)
    assert start[0] == 0 and end[-1] == len(h) and (start[1:] == end[:-1]).all()
    assert (doc[start] == d).all() and (doc[end - 1] == d).all() and (lo <= start).all() and (hi >= end).all()


def test_empty_table(make_docs):
    assert recompress.repeated_spans(make_docs([])).count() == 0
    assert recompress.drop_repeats(make_docs([])).count() == 0


def test_combining_a_batch_leaves_no_hot_name():
    rng = np.random.default_rng(4)
    name = rng.integers(0, 40, 3000).astype(np.uint64)
    name[:1000] = 99
    owner, place = rng.integers(0, 50, 3000), np.arange(3000)
    name[-3:], owner[-3:] = 1000, 7  # one document alone has it
    out = recompress._combined(name, owner, place).to_pandas()
    assert out.name.value_counts().iloc[0] <= 3
    kept = out[out.place >= 0]
    assert sorted(kept.place) == list(range(3000)) and (kept.set_index("place").doc_id.sort_index().to_numpy() == owner).all()
    known = kept.set_index("place").known.sort_index().to_numpy()
    assert known.tolist() == [len(set(owner[name == n])) > 1 for n in name]
    told = out[out.place < 0]
    for n in set(name[known].tolist()):
        rows = told[told.name == n]
        assert sorted(rows.doc_id) == [owner[name == n].min(), owner[name == n].max()]


def test_characters_that_fold_to_several_words(make_docs):
    sallallahou = "\ufdfa"  # four words
    rows = [(1, " ".join([sallallahou] * 20)), (2, " ".join([sallallahou] * 20) + " tail"), (3, "½ " * 30), (4, "½ " * 30), (5, " ".join([sallallahou] * 12))]
    got = recompress.repeated_spans(make_docs(rows))
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got.collect()) == brute(rows, 50) == [(2, 0, 80), (4, 0, 60)]
    assert sorted((r.doc_id, r.text) for r in recompress.drop_repeats(make_docs(rows)).collect()) == [(1, rows[0][1]), (2, "tail"), (3, rows[2][1]), (5, rows[4][1])]


def test_window_hashes_have_two_independent_halves():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    h[200:260] = h[20:80]
    at = np.arange(len(h) - 50 + 1)
    one, two = recompress._Windows(50)(h, at)
    assert (one[200:211] == one[20:31]).all() and (two[200:211] == two[20:31]).all() and len(set(one.tolist())) == len(set(two.tolist())) == len(at) - 11
    assert not (one == two).any()


def firsts(rows, n):
    """The least doc_id of any window of each span of ``brute``."""
    first, out = {}, {}
    texts = [(d, words_of(t)) for d, t in rows if d is not None and t is not None]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            first[tuple(w[i : i + n])] = min(first.get(tuple(w[i : i + n]), d), d)
    for d, w in texts:
        for a, b in merged((i, i + n) for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d):
            out[d, a, b] = min(f for i in range(a, b - n + 1) if (f := first[tuple(w[i : i + n])]) < d)
    return out


@pytest.mark.parametrize("hot", [2, 5, 16])
def test_passages_of_very_many_documents(spark, make_docs, hot):
    rng = random.Random(31)
    passages = [words(rng, 70) for _ in range(3)]
    rows = [(i, words(rng, rng.randrange(30)) + " " + passages[0 if i % 3 else rng.randrange(3)] + " " + words(rng, 10)) for i in rng.sample(range(5000), 400)]
    rows += [rows[5], rows[6], (rows[7][0], rows[7][1] + " more " + passages[1])]
    for parts in (1, 6):
        got = recompress.repeated_spans(make_docs(rows).repartition(parts), min_words=20, hot=hot)
        assert {(r.doc_id, r.start_word, r.end_word): r.first_doc_id for r in got.collect() if r.doc_id != rows[7][0]} == {k: v for k, v in firsts(rows, 20).items() if k[0] != rows[7][0]}
        assert sorted({(r.doc_id, r.start_word, r.end_word) for r in got.collect()}) == sorted(set(brute(rows, 20)))
    # the texts are joined and searched for windows once, whatever reads them
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin [doc_id") <= 1 and final.count("ReusedExchange") + final.count("ResultQueryStage") >= 4, final


def test_few_rows_of_a_window_share_a_key():
    rng = np.random.default_rng(8)
    window, owner = rng.integers(0, 30, 3000), rng.integers(0, 900, 3000)
    window[:1500] = 77
    out = recompress._parted(window, window * 3, owner, np.arange(3000), 16).to_pandas()
    plain = out[out.batch_key.isna() | (out.batch_key != out.window)]
    assert plain.groupby(["window", "check"]).size().max() < 16 and sorted(out["at"]) == list(range(3000))
    stands = plain[plain.batch_key.notna()].set_index("batch_key")
    for key, rows in out[out.batch_key == out.window].groupby("window"):
        rep = stands.loc[key]
        members = np.append(rows["at"].to_numpy(), rep["at"])
        assert set(window[members]) == {rep["window"]} and rep["doc_id"] == owner[members].min() and len(members) == (window == rep["window"]).sum()
