import glob
import random

import pyarrow.parquet as pq
import regex
import tiktoken

from logmill.llm import bpe, tokenids

from .conftest import words

ROWS = [(3, "Hello world"), (1, ""), (2, None), (None, "naïve <|endoftext|> text"), (3, "Hello world"), (4, "a " * 50_000)]


def test_ids_are_those_of_the_public_encoder(make_docs):
    enc = tiktoken.Encoding("t", pat_str=tokenids.PATTERN, mergeable_ranks=tokenids.load_ranks(), special_tokens={})
    got = tokenids.token_table(make_docs(ROWS, token_ids="x", n_tokens="y"))
    expected = [(i, None if t is None else enc.encode_ordinary(t)) for i, t in ROWS]
    assert sorted(((r.doc_id, r.token_ids) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert all(r.n_tokens == (None if r.token_ids is None else len(r.token_ids)) for r in got.collect())


def test_layout_and_selective_reads(spark, make_docs, tmp_path):
    rng = random.Random(2)
    docs = make_docs([(i, words(rng, 60)) for i in range(3000)]).coalesce(1)
    path = str(tmp_path / "tokens")
    tokenids.write_tokens(tokenids.tokenised(docs), path, row_group_bytes=200_000, page_bytes=8_000, page_rows=200)
    (file,) = glob.glob(f"{path}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and not columns["doc_id"].has_dictionary_page
    assert columns["token_ids.list.element"].has_dictionary_page
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    some = tokenids.read_tokens(spark, path, ["doc_id", "n_tokens"], 100, 119)
    assert some.count() == 20
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "token_ids" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_empty_table(make_docs):
    assert tokenids.token_table(make_docs([])).count() == 0


def plain_ids(text, ranks):
    """Ids by scanning each piece for the leftmost least rank."""
    out = []
    for piece in regex.findall(tokenids.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_ids_are_those_of_plain_merging_and_decode_to_the_text(make_docs):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["naïve", "Straße", "日本語", "don't", "12345", "...", "\n\n", "hello", "Überraschungen", "x" * 40, "🙂"]) for _ in range(rng.randrange(30)))) for k in range(60)] + ROWS[:5]
    ranks, codec = tokenids.load_ranks(), bpe.codec()
    got = tokenids.token_table(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.token_ids) for r in got), key=repr) == sorted(((i, None if t is None else plain_ids(t, ranks)) for i, t in rows), key=repr)
    assert sorted((codec.decode(r.token_ids) for r in got if r.token_ids is not None)) == sorted(t for _, t in rows if t is not None)
    decoded = bpe.decode_documents(tokenids.token_table(make_docs(rows)))
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=repr) == sorted(rows, key=repr)
