"""Folds in order within keys, where what an event does hangs on all events before it.

Rows are shuffled by key and sorted on the JVM; Python sees them as a stream of Arrow batches and holds the state of one key,
never its history, so a key with very many events costs time in one task but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.types as kinds
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def values_of(column: pa.Array) -> list:
    """What ``column.to_pylist()`` gives, several times as fast: whole columns are converted, lists and maps cut from their flat values."""
    t = column.type
    if kinds.is_list(t) or kinds.is_map(t):
        flat = list(zip(values_of(column.keys), values_of(column.items))) if kinds.is_map(t) else values_of(column.values)
        at = column.offsets.to_numpy().tolist()
        out = [flat[a:b] for a, b in zip(at, at[1:])]
    elif kinds.is_integer(t):
        out = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    elif kinds.is_string(t) or kinds.is_binary(t):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[k] = None
    return out


def fold_sorted(events: DataFrame, keys: Sequence[str], order: str, start: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """A row of ``schema`` for each row of ``events``: what ``step`` makes of the key's state, which it changes, and of the
    row.  Rows of a key come in the order of ``order``; ties in any order.  Null keys are a key."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: object = None
        for b in batches:
            out, names = [], b.schema.names
            for row in zip(*map(values_of, b.columns)):
                e = dict(zip(names, row))
                own = tuple(e[k] for k in keys)
                if own != key:
                    key, state = own, start()
                out.append(step(state, e))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return events.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(each, schema)
