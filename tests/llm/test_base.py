import random
import re

import pytest

from logmill.llm.base import cut_words, shared_dir, staged, word_starts
from logmill.llm.tokens import words_of

PIECES = ["a", "B", "ß", "É", "e\u0301", "\u0301", "½", "™", "ﬁ", "\ufdfa", "\u0345", "İ", "ǆ", "가", "\u1100\u1161", "中", "-", ".", "'", " ", "\u00a0", "\u2003", "\n", "⑴", "㎧", "_", "7", "²", "\u00b4", "\u093f", "क", "\u200d"]


def test_a_word_has_a_place_each():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        at = word_starts(text)
        assert len(at) == len(words_of(text)), ascii(text)
        assert at == sorted(at) and all(0 <= x < len(text) for x in at)


def test_cutting_keeps_case_and_marks():
    assert cut_words("The CAT, sat. On THE mat ½ cup; and More.", [(0, 2)]) == "sat. On THE mat ½ cup; and More."
    assert words_of("½ cup") == ["1", "2", "cup"]
    assert cut_words("Mix ½ Cup™ of ™ Milk, ½ Spoon!", [(1, 3)]) == "Mix Cup™ of ™ Milk, ½ Spoon!"
    assert cut_words("Mix ½ Cup™ of ™ Milk", [(2, 3)]) == "Mix 1 Cup™ of ™ Milk"
    assert cut_words("Mix ½ Cup™ of ™ Milk", [(0, 1)]) == "½ Cup™ of ™ Milk"
    w = words_of("\ufdfa")
    assert cut_words("Ein GROẞES Haus; \ufdfa End", [(3, 5)]) == f"Ein GROẞES Haus; {w[2]} {w[3]} End"
    assert cut_words("Ein GROẞES Haus; \ufdfa End", [(3, 4), (5, 6)]) == f"Ein GROẞES Haus; {w[1]} {w[3]} End"
    assert cut_words("Ein GROẞES Haus; \ufdfa End", [(1, 3), (7, 8)]) == "Ein \ufdfa "


def test_what_is_left_has_the_words_that_were_not_cut():
    rng = random.Random(8)
    plain = ["Alpha", "beta,", "GAMMA.", "naïve", "Straße", "Quote”", "Ångström", "中文", "e\u0301t\u00e9"]
    for _ in range(500):
        text = " ".join(rng.choice(plain) for _ in range(rng.randrange(1, 12)))
        w = words_of(text)
        a = rng.randrange(len(w))
        b = rng.randrange(a, len(w)) + 1
        left = cut_words(text, [(a, b)])
        assert words_of(left) == w[:a] + w[b:] and all(x in text for x in re.split(r"\s+", left) if x)


def test_exactly_the_words_of_the_spans_go():
    rng = random.Random(5)
    for _ in range(10000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(10)))
        spans, k = [], 0
        while rng.random() < 0.7:
            a = k + rng.randrange(1 if spans else 0, 3)
            k = a + rng.randrange(1, 4)
            spans.append((a, k))
        gone = {i for a, b in spans for i in range(a, b)}
        assert words_of(cut_words(text, spans)) == [x for i, x in enumerate(words_of(text)) if i not in gone], ascii(text)


def test_a_staged_table_goes_once_the_next_one_stands(spark):
    first = staged(spark.range(10), "first")
    again = staged(first.where("id > 4"), "again", after=first)
    assert again.count() == 5
    with pytest.raises(Exception, match="(?i)exist|no such file|not found"):
        first.count()


class _Elsewhere:
    """A session on a cluster that names no shared folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, *_):
        return None

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, place):
        self.place = place


def test_only_a_local_session_gets_a_folder_of_its_own():
    for master in ("local", "local[4]", "local[*]"):
        assert shared_dir(_Elsewhere(master))
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            shared_dir(_Elsewhere(master))
