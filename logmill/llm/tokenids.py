"""Token ids as Parquet: list columns, encodings by column, row groups and page indexes of chosen size.

``token_ids`` (a list of 32-bit ids) and the short strings are dictionary encoded: a row group holds at most one vocabulary of
distinct ids, whose positions pack in some 16 bits.  ``doc_id`` and ``n_tokens`` are delta encoded (format version 2).
Within a file rows are sorted by doc_id, so that the page index lets a reader skip the pages of other documents; a
column chunk is read only if asked for, so metadata costs nothing of the tokens.

Nothing is shuffled: each task sorts and writes what it tokenised.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.base import staged_path
from logmill.llm.bpe import PATTERN, VOCABULARY, id_lists, load_ranks

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2_000
COLUMNS = ("doc_id", "lang", "source", "n_tokens", "token_ids")
_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=load_ranks(vocabulary), special_tokens={})
    return _encoders[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids), a row for each row of ``docs``.

    Null text: n_tokens and token_ids null.  Empty text: no tokens.  Null ids, languages and sources stay null; repeated rows
    stay; other columns are left out; empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                ids = [None if t is None else enc.encode_to_numpy(t, disallowed_special=()) for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array([None if x is None else len(x) for x in ids], pa.int64()), id_lists(ids)], list(COLUMNS))

    return docs.mapInArrow(each, "doc_id bigint, lang string, source string, n_tokens bigint, token_ids array<int>")


def write_tokens(tokens: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, mode: str = "errorifexists") -> None:
    """Writes the columns of ``tokenised`` to ``path`` in the layout described above."""
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.columnindex.truncate.length": 64,
        "compression": "zstd",
    }
    tokens.select(*COLUMNS).sortWithinPartitions("doc_id").write.mode(mode).options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = COLUMNS, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """``columns`` of a token table, of the documents with ``first_id <= doc_id <= last_id`` where given; both choices
    reach the scan."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows.select(*columns)


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token table of ``docs``, written to the shared folder and read back; see ``tokenised`` for the rows."""
    path = staged_path(docs.sparkSession, "tokens")
    write_tokens(tokenised(docs, vocabulary), path)
    return read_tokens(docs.sparkSession, path)
