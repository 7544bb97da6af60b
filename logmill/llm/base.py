"""What the text operators share: tables, the cluster's shared folder, Arrow maps, cutting of word spans."""

from __future__ import annotations

import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.llm.tokens import fold

_WORD = re.compile(r"\w+")
_PIECE = re.compile(r"[^\x00-\x20\x7f]+")
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session, as in tests, gets one of
    its own; a cluster must name one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="logmill-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, after: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and survives lost executors.  ``after`` is a staged
    table that nothing needs once this one stands; its files go."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    if after is not None:
        for old in {os.path.dirname(f) for f in after.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(df.schema).parquet(path)


def text_input(df: DataFrame, *others: str) -> DataFrame:
    """(doc_id, text, others...) of any table of documents, whatever else it holds."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 2000) -> DataFrame:
    """``fn`` over pieces of at most ``rows`` rows of each Arrow batch, which bounds a worker's memory; None means no rows."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(a, rows))) is not None:
                    yield out

    return df.mapInArrow(each, schema)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _clusters(piece: str) -> list[str]:
    """``piece`` cut before each character that starts a combining sequence."""
    cuts = [i for i, c in enumerate(piece) if not i or not unicodedata.combining(c)]
    return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)])]


def _places(text: str) -> tuple[list[int], dict[int, tuple[str, int, int]]]:
    """Where in ``text`` each word of its folded form begins, and of those that begin within a character, after another word of
    it: (the character folded, where the word begins in that, where the character ends).

    Blanks never compose, so what stands between them folds by itself.  In a piece whose folded form has other words than the
    piece, each character with its marks is folded by itself.
    """
    if text.isascii():
        return [m.start() for m in _WORD.finditer(text)], {}
    out: list[int] = []
    inside: dict[int, tuple[str, int, int]] = {}
    for m in _PIECE.finditer(text):
        piece, at = m.group(), m.start()
        if piece.isascii():
            out.extend(at + w.start() for w in _WORD.finditer(piece))
            continue
        folded = fold(piece)
        # folding may turn a mark into a letter, so words are looked for in the folded characters
        lower = piece.casefold()
        n, plain = len(_WORD.findall(folded)), [w.start() for w in _WORD.finditer(lower)]
        if n == len(plain) and len(lower) == len(piece) and unicodedata.is_normalized("NFKC", piece):
            out.extend(at + w for w in plain)
            continue
        parts = [(c, fold(c)) for c in _clusters(piece)]
        words = [w.start() for w in _WORD.finditer("".join(f for _, f in parts))]
        if len(words) != n:  # compositions across characters don't add or remove words; if they did, the piece would count as one character
            parts, words = [(piece, folded)], [w.start() for w in _WORD.finditer(folded)]
        k = begin = 0
        for c, f in parts:
            while k < n and words[k] < begin + len(f):
                if _WORD.search(f, 0, words[k] - begin):
                    inside[len(out)] = (f, words[k] - begin, at + len(c))
                out.append(at)
                k += 1
            begin, at = begin + len(f), at + len(c)
    return out, inside


def word_starts(text: str) -> list[int]:
    """Where in ``text`` each word of its folded form begins; the words of a character that gives several begin where it does."""
    return _places(text)[0]


def _joined(left: str, right: str) -> str:
    """``left`` and ``right``, with a space where a word would run on."""
    i = len(left) - 1
    while i > 0 and unicodedata.combining(left[i]):
        i -= 1
    last = fold(left[i:]) if left else ""
    return f"{left} {right}" if right and last and _WORD.match(last[-1]) else left + right


def cut_words(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """``text`` without the words of the spans ``[a, b)``, sorted and disjoint; what follows the last word
    of a span up to the next word goes with it.

    Words are counted in the folded text and cut from the text itself, whose case and marks stay.  Of a character that
    folds to several words, some of which go, the others stay in folded form: no word goes that no span holds.
    """
    at, inside = _places(text)
    whole = len(text)
    kept, here, behind = "", 0, None
    for a, b in [*spans, (len(at), len(at))]:
        a = min(a, len(at))
        stop, before = at[a] if a < len(at) else whole, inside.get(a)
        if behind and before and here == stop:
            part = behind[0][behind[1] : before[1]]
        else:
            part = (behind[0][behind[1] :] + text[behind[2] : stop] if behind else text[here:stop]) + (before[0][: before[1]] if before else "")
        kept = _joined(kept, part)
        if b >= len(at):
            break
        here, behind = at[b], inside.get(b)
    return kept


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals, sorted; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
