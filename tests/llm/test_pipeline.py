import random

import corpus_pipeline
from logmill.llm import bpe
from logmill.llm.base import cut_words
from logmill.llm.tokens import words_of

from . import test_decontam, test_quality, test_recompress, test_simhash
from .conftest import words

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def build(spark, folder):
    rng = random.Random(6)
    rows, labels = test_quality.corpus(300, 5, 5000)
    items = [(k, words(rng, 30, 5000)) for k in range(5)]
    passage = words(rng, 70)
    copied = [words(rng, 150) for _ in range(5)]
    rows += [(1000 + k, t) for k, t in enumerate(copied)] + [(1100 + k, t) for k, t in enumerate(copied)] + [(1200 + k, test_simhash.edited(rng, t, 0.03)) for k, t in enumerate(copied)]
    rows += [(1300 + k, words(rng, 90) + ". " + passage + ". " + words(rng, 90)) for k in range(4)]
    rows += [(1400 + k, words(rng, 60) + ". " + t + ". " + words(rng, 20)) for k, (_, t) in enumerate(items)]
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KINDS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items, passage


def cut_all(rows, spans):
    out = []
    for i, t in rows:
        own = [(a, b) for d, a, b in spans if d == i]
        new = cut_words(t, own) if own else t
        if not own or words_of(new):
            out.append((i, new))
    return out


def test_each_stage_against_plain_python(spark, tmp_path):
    rows, labels, items, passage = build(spark, tmp_path)
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_level_bpe"]
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    kept = stages["quality_classifier"](spark, docs, folder)
    assert kept.columns == docs.columns
    after = texts(kept)
    truth = {i: q for i, q, _ in labels}
    assert sum(truth.get(i, 1) for i, _ in after) / sum(truth.get(i, 1) for i, t in rows if t) > 0.97
    assert sum(not truth.get(i, 1) for i, _ in after) < 0.05 * sum(not q for q in truth.values())

    one = stages["simhash_near_dedup"](spark, kept, folder)
    gone = {d for d, _ in test_simhash.brute(after)}
    assert one.columns == docs.columns and texts(one) == sorted((i, t) for i, t in after if i not in gone)
    assert gone >= {1100 + k for k in range(5)} | {1200 + k for k in range(5)}

    before = texts(one)
    cut = stages["substring_dedup"](spark, one, folder)
    expected = sorted(cut_all(before, test_recompress.brute(before, 50)))
    assert cut.columns == docs.columns and texts(cut) == expected and all(r.n_chars == len(r.text) for r in cut.collect())
    assert sum(passage in t for _, t in expected) == 1

    clean = stages["benchmark_decontamination"](spark, cut, folder)
    last = sorted(cut_all(expected, test_decontam.brute(expected, items)))
    assert clean.columns == docs.columns and texts(clean) == last
    assert not any(t in text for _, text in last for _, t in items)

    ids = stages["byte_level_bpe"](spark, clean, folder)
    codec = bpe.codec()
    assert sorted((r.doc_id, codec.decode(r.token_ids)) for r in ids.collect()) == last and all(r.round_trip for r in ids.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.token_ids) for r in whole.collect()) == sorted((r.doc_id, r.token_ids) for r in ids.collect())


def test_an_empty_corpus(spark, tmp_path):
    for name, kinds in (("documents", KINDS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_have_defined_results_in_every_stage(spark, tmp_path):
    rng = random.Random(15)
    build(spark, tmp_path)
    folder = str(tmp_path)
    long = words(rng, 40_000, 5000)
    odd = [(None, words(rng, 80)), (None, words(rng, 80)), (5001, None), (5002, ""), (5003, " \n "), (5004, long), (5004, long), (5005, "again " + words(rng, 70)), (5006, words(rng, 9) + " ½ ™ Ünïcode " + words(rng, 60))]
    odd += [(5007, odd[7][1]), (5008, odd[7][1])]
    kinds = KINDS + ", spans string, node bigint, at string, probability double, of_doc bigint"
    docs = spark.createDataFrame([(i, t, "en", None, None, "x", 1, "y", 0.5, 2) for i, t in odd], kinds)
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def after(name, given):
        got = stages[name](spark, given, folder)
        assert got.columns == columns
        return sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)

    kept = after("quality_classifier", docs)
    assert set(kept) <= set(odd) and not {5001, 5002, 5003} & {i for i, _ in kept}
    assert sum(i == 5004 for i, _ in kept) in (0, 2) and [i for i, _ in kept].count(None) in (0, 1, 2)
    # one of the repeated row and of the three copies; what has no id, text or word stays
    assert after("simhash_near_dedup", docs) == sorted([r for k, r in enumerate(odd) if r[0] not in (5007, 5008) and k != 6], key=repr)
    # the copies' whole text is a repeated passage; both rows of 5004 are one document
    assert after("substring_dedup", docs) == sorted([r for r in odd if r[0] not in (5007, 5008)], key=repr)
    assert after("benchmark_decontamination", docs) == sorted(odd, key=repr)
    ids = stages["byte_level_bpe"](spark, docs, folder)
    assert ids.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip"] and ids.count() == len(odd)
    assert all(r.round_trip is (None if r.doc_id == 5001 else True) for r in ids.collect())
    for name in stages:
        assert stages[name](spark, docs.limit(0), folder).count() == 0


def test_no_labels_and_no_benchmark(spark, tmp_path):
    spark.createDataFrame([(1, "some words here", "en", "s", 15), (2, "", "en", "s", 0)], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.round_trip) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(1, True)]
