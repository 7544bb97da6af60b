import random

from logmill.llm import decontam
from logmill.llm.base import merged
from logmill.llm.recompress import cut_spans
from logmill.llm.tokens import words_of

from .conftest import words


def brute(rows, items, max_words=decontam.MAX_WORDS, coverage=decontam.COVERAGE, least=decontam.LEAST_WORDS):
    """Spans by trying every run of every document in every item."""
    grams = {}
    for item, text in items:
        w = words_of(text)
        if len(w) < decontam.SHORT_WORDS:
            continue
        limit = decontam.limit_of(len(w), max_words, coverage, least)
        for i in range(len(w) - limit + 1):
            grams.setdefault(limit, set()).add(tuple(w[i : i + limit]))
    out = []
    for doc, text in rows:
        w = words_of(text)
        hits = [(i, i + n) for n, known in grams.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in known]
        out += [(doc, a, b) for a, b in merged(hits)]
    return sorted(out, key=repr)


def test_spans_against_brute_force(spark, make_docs):
    rng = random.Random(3)
    items = [(k, words(rng, rng.randrange(5, 40), 60)) for k in range(25)] + [(90, None), (91, ""), (None, words(rng, 12, 60)), (3, items_text := words(rng, 20, 60)), (4, items_text)]
    rows = []
    for i in range(120):
        text = words(rng, rng.randrange(0, 60), 60)
        if i % 3 == 0:
            source = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(source))
            text += " ; " + " ".join(source[a : a + rng.randrange(1, 30)]).upper() + ". " + words(rng, 5, 60)
        rows.append((i, text))
    rows += [(None, items[0][1] + " " + items[20][1]), (500, None), (501, ""), (502, words(rng, 40_000, 60)), (1, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contaminated_spans(make_docs(rows, item_id="x", text_hash="y"), benchmark)
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got.collect()), key=repr) == brute(rows, items)
    # several automata find the same
    parts = decontam.contaminated_spans(make_docs(rows), benchmark, chunk_words=60)
    union = {}
    for r in parts.collect():
        union.setdefault((r.doc_id, r.text_hash), set()).add((r.start_word, r.end_word))
    assert sorted(((d, a, b) for (d, _), s in union.items() for a, b in merged(s)), key=repr) == sorted(set(brute(rows, items)), key=repr)


def test_automaton_gives_longest_matches():
    rng = random.Random(5)
    items = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(12)]
    sam = decontam.Automaton()
    for w in items:
        sam.add(w)
    for k, w in enumerate(items):
        sam.own(k, w)
    runs = {tuple(w[i:j]) for w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    text = [rng.randrange(5) for _ in range(400)]
    for end, (state, n) in enumerate(sam.matches(text)):
        best = max((k for k in range(end + 2) if k == 0 or tuple(text[end + 1 - k : end + 1]) in runs), default=0)
        assert n == best
        if n:
            run = tuple(text[end + 1 - n : end + 1])
            holders = [len(w) for w in items if any(tuple(w[i : i + n]) == run for i in range(len(w)))]
            assert sam.words_of[state] == min(holders)


def test_removal_leaves_the_rest_of_the_text(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = make_docs([(1, f"Before it. {item.title()}! After, all."), (2, "clean text stays  as it is "), (3, item), (None, f"No id; {item}"), (4, None), (5, "")], spans="clash", of_doc="clash")
    got = {(r.doc_id, r.text, r.n_chars) for r in decontam.decontaminate(docs, benchmark).collect()}
    assert got == {(1, "Before it. After, all.", 22), (2, "clean text stays  as it is ", 27), (None, "No id; ", 7), (4, None, None), (5, "", 0)}


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = make_docs([(1, "some text")])
    assert decontam.contaminated_spans(docs, none).count() == 0
    assert decontam.decontaminate(docs, none).count() == 1
    assert decontam.contaminated_spans(make_docs([]), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")).count() == 0


def test_several_automata_give_the_rows_and_texts_of_one(spark, make_docs):
    rng = random.Random(11)
    w = [f"w{i}" for i in range(400)]
    # neighbouring items share runs of 10 to 15 words and fall in different chunks
    items = [(40 - k, " ".join(w[20 * k : 20 * k + 30 + k % 6])) for k in range(12)] + [(7, " ".join(w[300:325])), (3, " ".join(w[295:330])), (None, " ".join(w[300:325]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, "Before it. " + " ".join(w[0:200]) + ". After it."), (2, " ".join(w[15:33]) + " x " + " ".join(w[300:325]) + " y"), (3, "clean text"), (None, "a " + " ".join(w[40:75]) + " b"), (4, " ".join(w[20:60]))]
    rows += [(10 + i, " ".join(words(rng, 4, 50) + " " + " ".join(w[(a := rng.randrange(380)) : a + rng.randrange(5, 60)]) for _ in range(3))) for i in range(40)]
    rows.append(rows[0])
    docs = make_docs(rows)
    one = sorted(map(tuple, decontam.contaminated_spans(docs, benchmark).collect()), key=repr)
    texts = sorted(((r.doc_id, r.text) for r in decontam.decontaminate(docs, benchmark).collect()), key=repr)
    assert (1, "Before it. After it.") in texts and len(one) > 40
    for n in (25, 60):
        assert sorted(map(tuple, decontam.contaminated_spans(docs, benchmark, chunk_words=n).collect()), key=repr) == one
        assert sorted(((r.doc_id, r.text) for r in decontam.decontaminate(docs, benchmark, chunk_words=n).collect()), key=repr) == texts


def test_overlapping_spans_are_cut_once(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(25))
    docs = make_docs([(1, text)])
    spans = docs.selectExpr("doc_id", "xxhash64(text) & 2147483647 AS text_hash", "explode(array(struct(0L AS a, 20L AS b), struct(5L AS a, 15L AS b))) AS s").selectExpr("doc_id", "text_hash", "s.a AS start_word", "s.b AS end_word")
    assert [r.text for r in cut_spans(docs, spans).collect()] == ["w20 w21 w22 w23 w24"]


def test_a_run_of_a_short_item_within_a_longer_match(spark, make_docs):
    w = [f"w{i}" for i in range(60)]
    # nine words of the long item (limit 10), the last eight of which are half of the short one (limit 8)
    items = [(1, " ".join(w[:30])), (2, " ".join(w[11:19] + w[40:48]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make_docs([(1, "x " + " ".join(w[10:19]) + " y"), (2, "x " + " ".join(w[12:21]) + " y")])
    for n in (decontam.CHUNK_WORDS, 16):
        assert [tuple(r) for r in decontam.contaminated_spans(docs, benchmark, chunk_words=n).drop("text_hash").collect()] == [(1, 2, 10, 2, 8)]


def test_items_that_share_runs_against_brute_force(spark, make_docs):
    rng = random.Random(21)
    pieces = [" ".join(f"p{k}w{i}" for i in range(8)) for k in range(4)]
    text = lambda n: " ".join(rng.choice([*pieces, words(rng, 1, 4), words(rng, 2, 4)]) for _ in range(n))
    items = [(k, text(rng.randrange(1, 6))) for k in range(40)]
    rows = [(i, text(rng.randrange(1, 8))) for i in range(150)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted((tuple(r) for r in decontam.contaminated_spans(make_docs(rows), benchmark).collect()), key=repr)
    assert sorted(((r[0], r[2], r[3]) for r in one), key=repr) == brute(rows, items)
    assert sorted((tuple(r) for r in decontam.contaminated_spans(make_docs(rows), benchmark, chunk_words=100).collect()), key=repr) == one


def test_short_items_are_found_whole(spark, make_docs):
    items = [(1, "who wrote the first letter"), (2, "one two three four"), (3, "a b c d e f g"), (4, " ".join(f"w{i}" for i in range(20)))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, "Q: Who wrote the first letter? A."), (2, "who wrote the first note; one two three four"), (3, "x a b c d e f"), (4, "a b c d e f g who wrote the first letter"), (5, " ".join(f"w{i}" for i in range(9)))]
    got = decontam.contaminated_spans(make_docs(rows), benchmark)
    assert sorted((r.doc_id, r.start_word, r.end_word, r.item_id, r.match_words) for r in got.collect()) == [(1, 1, 6, 1, 5), (4, 0, 12, 3, 7)]
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got.collect()) == brute(rows, items)


def test_a_worker_keeps_only_the_automata_of_one_query():
    items = [(1, list(range(8)))]
    first = decontam.built_once(("a", 0), items, 10, 0.5, 8)
    assert decontam.built_once(("a", 0), None, 10, 0.5, 8) is first
    decontam.built_once(("a", 1), items, 10, 0.5, 8)
    decontam.built_once(("b", 0), items, 10, 0.5, 8)
    assert list(decontam._built) == [("b", 0)]
