from hypothesis import given, settings
from hypothesis import strategies as st

from logmill.llm.base import cut_words, merged
from logmill.llm.tokens import Tokeniser, slices, words_of

TOK = Tokeniser()
text = st.text(st.characters(codec="utf-8") | st.sampled_from("aB1_ \n.é,ßﬁ日"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(text | st.none(), max_size=6))
def test_hashes_stand_for_words(texts):
    h, offsets = TOK(texts)
    assert offsets[0] == 0 and offsets[-1] == len(h) and len(offsets) == len(texts) + 1
    hash_of = {}
    for i, t in enumerate(texts):
        own = h[offsets[i] : offsets[i + 1]].tolist()
        assert len(own) == len(words_of(t))
        for w, x in zip(words_of(t), own):
            assert hash_of.setdefault(w, x) == x
    assert len(set(hash_of.values())) == len(hash_of)


@given(st.lists(text, max_size=8), st.integers(1, 40))
def test_slices_cover_all_texts_in_order(texts, limit):
    parts = list(slices(texts, limit))
    assert [k for i, j in parts for k in range(i, j)] == list(range(len(texts)))
    assert all(sum(map(len, texts[i:j])) <= limit or j == i + 1 or sum(map(len, texts[i : j - 1])) == 0 for i, j in parts)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)).map(lambda x: (x[0], x[0] + x[1])), max_size=8))
def test_merged_spans(spans):
    out = merged(spans)
    assert {k for a, b in out for k in range(a, b)} == {k for a, b in spans for k in range(a, b)}
    assert all(x[1] < y[0] for x, y in zip(out, out[1:]))


def test_cutting():
    assert cut_words("One, two; three. Four!", [(1, 3)]) == "One, Four!"
    assert cut_words("One, two; three. Four!", [(0, 1), (3, 4)]) == "two; three. "
    assert cut_words("a b", [(5, 9)]) == "a b" and cut_words("", [(0, 1)]) == ""
    # a letter that folds to several words: the folded text is cut
    assert len(words_of("x ﷺ y")) == 6
    assert words_of(cut_words("x ﷺ y", [(0, 5)])) == ["y"]


@settings(max_examples=200, deadline=None)
@given(text, st.integers(0, 6), st.integers(1, 4))
def test_cutting_removes_the_words_counted(t, a, n):
    w = words_of(t)
    assert words_of(cut_words(t, [(a, a + n)])) == w[:a] + w[a + n :]
