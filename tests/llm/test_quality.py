import math
import random
import re

import numpy as np

from logmill.llm import quality
from logmill.llm.quality import Words

from .conftest import words


def corpus(n=700, seed=1, vocabulary=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = words(rng, rng.randrange(30, 120), vocabulary).split()
        if not good:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "###" for x in w] if kind == 1 else [x for x in w[:6] for _ in range(15)]
        text = " ".join(w)
        rows.append((i, text if not good else text.replace(" ", ", ", 3) + "."))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark, make_docs):
    rows, labels = corpus()
    known = spark.createDataFrame(labels[:400], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scores(make_docs(rows, probability="x", keep="y"), known).collect()}
    truth = {i: q for i, q, _ in labels[400:]}
    right = [got[i].keep == bool(q) for i, q in truth.items()]
    assert np.mean(right) > 0.95
    kept_good = [got[i].keep for i, q in truth.items() if q]
    assert np.mean(kept_good) > 0.97
    assert all(0 <= r.probability <= 1 for r in got.values())
    loss = np.mean([-np.log(max(1e-9, got[i].probability if q else 1 - got[i].probability)) for i, q in truth.items()])
    assert loss < 0.25


def test_defined_results(spark, make_docs):
    rows, labels = corpus(200)
    extra = [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (0, rows[0][1]), (1003, "w1 " * 100_000)]
    odd = [(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 0, 0), (5, 1, 0), (99_999, 1, 0)]
    known = spark.createDataFrame(labels[:100] + odd, "doc_id bigint, quality int, toxic int")
    docs = make_docs(rows + extra)
    got = quality.scores(docs, known).collect()
    assert len(got) == len(rows) + len(extra)
    empty = {r.doc_id: (r.probability, r.keep) for r in got if r.doc_id in (1000, 1001, 1002)}
    assert set(empty.values()) == {(0.0, False)}
    first = {r.probability for r in got if r.doc_id in (0, None)}
    assert len(first) == 1
    kept = quality.drop_rejected(docs, known)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in got if r.keep), key=repr)


def test_no_labels_keeps_what_has_words(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.scores(make_docs([(1, "a b c"), (2, "")]), none).collect()}
    assert got == {1: True, 2: False}
    assert quality.scores(make_docs([]), none).count() == 0
    assert quality.drop_rejected(make_docs([]), none).count() == 0
    one = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert [r.keep for r in quality.scores(make_docs([(1, "a b c")]), one).collect()] == [False]


def test_sample_is_bounded_and_does_not_depend_on_order(spark, make_docs):
    rows, labels = corpus(120)
    vectors = np.ones((quality.BUCKETS, quality.DIMS), np.float32)
    docs = make_docs(rows)
    a = quality.labelled(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), vectors, 50)
    b = quality.labelled(docs.orderBy("text"), spark.createDataFrame(labels[::-1], "doc_id bigint, quality int, toxic int").repartition(3), vectors, 50)
    assert len(a[0]) == 50 and (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_word_vectors_are_sums_of_index_vectors_over_the_whole_corpus(make_docs):
    texts = ["The cat sat, the CAT ran!!", "", "one", "a b a b a b c"]
    splitter, (places, signs) = Words(), quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        w, _ = splitter([t])
        for i in range(len(w)):
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if i != j:
                    np.add.at(total[w[i]], places[w[j]], signs[w[j]])
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    expected = total / np.where(norm > 0, norm, 1)
    got = quality.word_vectors(make_docs([(k, t) for k, t in enumerate(texts)] + [(9, None)]))
    assert np.allclose(got, expected, atol=1e-6) and got.any()


def test_tokens():
    split = Words()
    same = lambda *texts: len({split([t])[0].tolist().__repr__() for t in texts}) == 1
    assert same("The cat", "the Cat") and not same("the cat", "THE CAT")
    assert len(split(["a,b!! c-d"])[0]) == 7 and split(["", "x y"])[1].tolist() == [0, 0, 2]


def test_pooling_is_mean_deviation_and_agreement():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    w, off = np.array([5, 5, 7, 9, 1]), np.array([0, 4, 4, 5])
    got = quality.pooled(w, off, vectors)
    v = vectors[w[:4]].astype(float)
    assert np.allclose(got[0], np.concatenate((v.mean(0), v.std(0), [np.mean([v[i] @ v[i + 1] for i in range(3)])])), atol=1e-4)
    assert not got[1].any() and np.allclose(got[2, -1], 0) and np.allclose(got[2, : quality.DIMS], vectors[1], atol=1e-6)


def test_toxic_documents_are_rejected(spark, make_docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        w, toxic = words(rng, rng.randrange(60, 200), 300).split(), int(rng.random() < 0.15)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, toxic))
    known = spark.createDataFrame(labels[:800], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.scores(make_docs(rows), known).collect() if r.keep}
    assert np.mean([i in kept for i, _, toxic in labels[800:] if toxic]) < 0.1
    assert np.mean([i in kept for i, _, toxic in labels[800:] if not toxic]) > 0.97


def plain_tokens(text):
    """(token, whether it is all capitals) by a regular expression."""
    return [(m.group().lower(), len(m.group()) > 1 and m.group().isupper() and m.group().isalpha()) for m in re.finditer(r"[A-Za-z0-9]+|([^A-Za-z0-9\s])\1*", text)]


def plain_score(text, vectors, marks, net):
    """A document's probability by loops over its words."""
    w = [int(x) for x in Words()([text], quality.MARKS)[0]]
    if not w:
        return 0.0
    v = [[float(c) for c in vectors[x % quality.BUCKETS]] for x in w]
    mean = [sum(row[k] for row in v) / len(v) for k in range(quality.DIMS)]
    deviation = [math.sqrt(max(0.0, sum(row[k] ** 2 for row in v) / len(v) - mean[k] ** 2)) for k in range(quality.DIMS)]
    alike = sum(sum(p * q for p, q in zip(a, b)) for a, b in zip(v, v[1:])) / max(1, len(v) - 1)
    x = [*mean, *deviation, alike, max(float(marks[k]) for k in w)]
    x = [(a - m) / s for a, m, s in zip(x, net.mean, net.scale)]
    hidden = [math.tanh(sum(a * net.w1[i, j] for i, a in enumerate(x)) + net.b1[j]) for j in range(len(net.b1))]
    return 1 / (1 + math.exp(-(sum(h * c for h, c in zip(hidden, net.w2)) + net.b2) / net.temperature))


def test_equal_tokens_have_equal_buckets_and_others_do_not():
    text = "The CAT's 3 cats, the cat!! ran... A B cat CAT !! ! 3"
    seen = {}
    for token, bucket in zip(plain_tokens(text), Words()([text], quality.MARKS)[0].tolist(), strict=True):
        assert seen.setdefault(token, bucket) == bucket
    assert len(set(seen.values())) == len(seen)


def test_the_whole_operator_against_loops(spark, make_docs):
    rows, labels = corpus(250, 9, 200)
    for k in range(0, 250, 4):
        rows[k], labels[k] = (k, rows[k][1] + " scum idiot"), (k, 1, 1)
    rows += [(900, ""), (901, None), (902, "one")]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = make_docs(rows)
    vectors, marks, net = quality.train(docs, known)
    got = {r.doc_id: r for r in quality.scores(docs, known).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert math.isclose(got[i].probability, plain_score(t or "", vectors, marks, net), abs_tol=2e-3), i
        assert got[i].keep == (got[i].probability >= quality.THRESHOLD)
    # the marks are Wilson bounds of counts over the labelled documents
    truth = {i: int(toxic) for i, _, toxic in labels}
    for word in ("scum", "idiot", "w7", "."):
        (bucket,) = Words()([word], quality.MARKS)[0].tolist()
        holders = [truth[i] for i, t in rows if i in truth and bucket in Words()([t], quality.MARKS)[0].tolist()]
        expected = quality.toxic_mark(sum(holders), len(holders) - sum(holders)) if sum(holders) >= quality.LEAST_TOXIC else 0
        assert math.isclose(marks[bucket], expected, abs_tol=1e-6)


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    params = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    a, t = rng.normal(size=(9, 6)), (rng.random(9) < 0.5).astype(float)

    def loss(p):
        total = 0.0
        for row, good in zip(a, t):
            hidden = [math.tanh(sum(row[i] * p[0][i, j] for i in range(6)) + p[1][j]) for j in range(4)]
            q = 1 / (1 + math.exp(-(sum(h * c for h, c in zip(hidden, p[2])) + p[3][0])))
            total -= math.log(q if good else 1 - q)
        return total / len(a) + 0.05 * (sum(x * x for x in p[0].ravel()) + sum(x * x for x in p[2]))

    for k, grad in enumerate(quality.gradients(params, a, t, decay=0.1)):
        for at in np.ndindex(grad.shape):
            up, down = [p.copy() for p in params], [p.copy() for p in params]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert math.isclose(grad[at], (loss(up) - loss(down)) / 2e-5, rel_tol=1e-5, abs_tol=1e-8)


def test_the_temperature_is_that_of_least_loss():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 5))
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit(x, y)
    held = np.arange(600) % 5 == 4
    t, logits = y[held], net.logit(x[held])
    good, bad = t.sum(), len(t) - t.sum()
    aim = [(good + 1) / (good + 2) if v else 1 / (bad + 2) for v in t]
    loss = lambda c: sum(math.log1p(math.exp(-abs(z / c))) + max(z / c, 0) - g * z / c for z, g in zip(logits, aim))
    assert all(loss(net.temperature) <= loss(c) + 1e-9 for c in np.exp(np.linspace(np.log(0.05), np.log(20), 241)))
