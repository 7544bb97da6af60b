import unicodedata
from collections import defaultdict

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from logmill.llm import fingerprint


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        if t is not None:
            folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
            groups[" ".join(folded.split())].append(k)
    out = {}
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[k] = (rows[k][0], min(ids, default=None), len(members))
    for k, (i, t) in enumerate(rows):
        out.setdefault(k, (i, i, 1))
    return sorted(out.values(), key=repr)


@given(st.text(max_size=40))
def test_canonical_form_is_stable(text):
    once = fingerprint.canonical(text)
    assert fingerprint.canonical(once) == once


def test_ascii_short_cut_agrees_with_the_general_way():
    assert fingerprint.canonical("  A\tB \x1c c\n") == " ".join("  A\tB \x1c c\n".casefold().split())


ROWS = [(5, "Hello  World"), (2, "hello world "), (9, "HELLO\nWORLD"), (3, "ﬁne ＡＢ"), (4, "fine ab"), (7, None), (8, None), (10, ""), (11, " \n"), (None, "hello world"), (12, "Straße"), (13, "STRASSE"), (14, "alone"), (2, "hello world "), (20, "x" * 300_000), (21, "X" * 300_000)]


def test_groups_against_brute_force(make_docs):
    got = fingerprint.duplicate_groups(make_docs(ROWS, digest="d", first_doc_id="x", keep="y"))
    rows = got.collect()
    assert sorted(((r.doc_id, r.first_doc_id, r.copies) for r in rows), key=repr) == brute(ROWS)
    kept = [r for r in rows if r.keep]
    # one of each group, and every null text
    assert len(kept) == len({fingerprint.canonical(t) for _, t in ROWS if t is not None}) + 2
    assert {r.doc_id for r in kept if r.copies > 1} == {2, 3, 10, 12, 20}


def test_bytes_are_compared_inside_equal_buckets(make_docs, monkeypatch):
    docs = make_docs([(1, "a"), (2, "b"), (3, "B"), (4, "c")])
    # a digest that is the same for all texts leaves the grouping to the comparison; workers fork before the patch, so in the driver
    canon, digest = fingerprint._digests(["a", "b", "B", "c", None])
    assert [d is None for d in digest] == [False] * 4 + [True]
    assert digest[1] == digest[2] == xxhash.xxh3_128_digest(b"b") and canon[1] == canon[2]
    rows = {r.doc_id: (r.first_doc_id, r.copies) for r in fingerprint.duplicate_groups(docs).collect()}
    assert rows == {1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (4, 1)}


def test_filter_has_every_repeated_digest_and_a_bounded_size(make_docs):
    bits = fingerprint.repeated_filter(make_docs(ROWS))
    assert len(bits) == fingerprint.LEAST_BITS // 8
    slot = int.from_bytes(fingerprint._digests(["hello world"])[1][0][:8], "little") % (8 * len(bits))
    assert bits[slot >> 3] >> (slot & 7) & 1
    assert fingerprint.repeated_filter(make_docs([(1, "a")])) == bytes(fingerprint.LEAST_BITS // 8)
    many = make_docs([(k, f"t{k // 2}") for k in range(200)])
    assert len(fingerprint.repeated_filter(many, 1 << 16)) == 1 << 13 and sum(map(int.bit_count, fingerprint.repeated_filter(many))) == 100


def test_a_full_filter_changes_no_group(make_docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "repeated_filter", lambda docs: b"\xff" * 4096)
    got = fingerprint.duplicate_groups(make_docs(ROWS)).collect()
    assert sorted(((r.doc_id, r.first_doc_id, r.copies) for r in got), key=repr) == brute(ROWS)


def test_empty_table(make_docs):
    assert fingerprint.duplicate_groups(make_docs([])).count() == 0
    assert fingerprint.fingerprints(make_docs([])).count() == 0


def test_digest_is_null_for_a_null_text(make_docs):
    got = {r.doc_id: r.digest for r in fingerprint.fingerprints(make_docs([(1, None), (2, "a"), (3, "A ")])).collect()}
    assert got[1] is None and bytes(got[2]) == bytes(got[3]) and len(got[2]) == 16
