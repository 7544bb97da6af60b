"""Segment files as a Spark source: ``spark.read.format("log_segments").load(root)`` and the same as a stream.

Below ``root``, on any file system that Arrow knows, stands ``topics/<topic>/partitions/<n>/*.log``.  A partition's file is read in splits of
``SPLIT_BYTES``, or of more where there would be over ``SPLITS`` of them, that begin where its sparse index has an entry; equalities on topic and partition choose the files, and a lower
bound of the offset is looked up in the index, so earlier batches aren't read.  Both are found by binary search in the index
file.  A torn tail is left out; damage before it is for recovery to cut.  As a stream the position is the next offset of each
partition; the driver learns only the ends, executors read the records.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logmill.functions import codec

SCHEMA = "topic string, partition int, offset bigint, timestamp_ms bigint, producer_id bigint, producer_epoch int, sequence int, key binary, value binary, headers string"
ARROW = pa.schema([
    ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp_ms", pa.int64()), ("producer_id", pa.int64()), ("producer_epoch", pa.int32()), ("sequence", pa.int32()),
    ("key", pa.binary()), ("value", pa.binary()), ("headers", pa.string()),
])
SEGMENT = "00000000000000000000"
SPLIT_BYTES = 64 << 20
SPLITS = 1024
ROWS = 4096
FIELDS = ["offset", "timestamp_ms", "producer_id", "producer_epoch", "sequence", "key", "value", "headers"]
_ENTRY = struct.Struct("<qq")


class Ranged:
    """Bytes of a file, fetched a stretch at a time."""

    def __init__(self, file: pa.NativeFile, size: int, stretch: int = 1 << 20) -> None:
        self.file, self.size, self.stretch, self.at, self.data = file, size, stretch, 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, s: slice) -> bytes:
        a, b, _ = s.indices(self.size)
        if a < self.at or b > self.at + len(self.data):
            self.at, self.data = a, self.file.read_at(max(b - a, min(self.stretch, self.size - a)), a)
        return self.data[a - self.at : b - self.at]


class Split(InputPartition):
    def __init__(self, topic: str, partition: int, path: str, begin: int, stop: int, start: int, end: int | None = None) -> None:
        super().__init__((topic, partition, begin))
        self.topic, self.partition, self.path, self.begin, self.stop, self.start, self.end = topic, partition, path, begin, stop, start, end


def storage(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or an address, and the path there."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))


def folders(root: str) -> list[tuple[str, int, str]]:
    """(topic, partition, folder), sorted; folders whose name is no number aren't partitions."""
    files, base = storage(root)
    inside = lambda path: files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    found = []
    for topic in inside(f"{base}/topics"):
        for place in inside(f"{topic.path}/partitions"):
            if place.base_name.isdigit():
                found.append((topic.base_name, int(place.base_name), place.path))
    return sorted(found)


def _size(files: fs.FileSystem, path: str) -> int:
    info = files.get_file_info(path)
    return info.size if info.type == fs.FileType.File else 0


class Index:
    """A sparse index file, searched without being read whole."""

    def __init__(self, files: fs.FileSystem, folder: str) -> None:
        path = f"{folder}/{SEGMENT}.index"
        size = _size(files, path)
        self.entries = size // _ENTRY.size
        self.data = Ranged(files.open_input_file(path), size, 1 << 16) if self.entries else b""

    def __getitem__(self, k: int) -> tuple[int, int]:
        return _ENTRY.unpack(self.data[k * _ENTRY.size : (k + 1) * _ENTRY.size])

    def before(self, limit: int, field: int) -> int:
        """How many entries have a base offset (field 0) or a position (1) of at most ``limit``."""
        low, high = 0, self.entries
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self[middle][field] <= limit else (low, middle)
        return low

    def position(self, start: int) -> int:
        """Where the last batch with an entry begins that isn't behind offset ``start``."""
        k = self.before(start, 0)
        return self[k - 1][1] if k else 0


def _stretch(files: fs.FileSystem, index: Index, path: str, start: int, end: int | None) -> tuple[int, int]:
    """Where the records from ``start`` up to ``end`` begin and stop in a partition's file."""
    stop = _size(files, path)
    if not stop:
        return 0, 0
    if end is not None and (k := index.before(end - 1, 0)) < index.entries:
        stop = index[k][1]
    return index.position(start) if start else 0, stop


def splits(files: fs.FileSystem, topic: str, partition: int, folder: str, start: int = 0, end: int | None = None, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Stretches of a partition's file with the records from ``start`` up to ``end``."""
    path = f"{folder}/{SEGMENT}.log"
    index = Index(files, folder)
    begin, stop = _stretch(files, index, path, start, end)
    if not stop:
        return []
    cuts = [begin]
    while cuts[-1] + split_bytes < stop:
        k = index.before(cuts[-1] + split_bytes - 1, 1)
        if k >= index.entries or not cuts[-1] < index[k][1] < stop:
            break
        cuts.append(index[k][1])
    return [Split(topic, partition, path, a, b, start, end) for a, b in zip(cuts, [*cuts[1:], stop])]


def plan(root: str, wanted: list[tuple[str, int, str, int, int | None]], split_bytes: int) -> list[Split]:
    """The splits of (topic, partition, folder, start, end).  Each is a task, so where ``split_bytes`` would make more than some
    ``SPLITS`` of them they are longer; a split is streamed, its length costs no memory."""
    files, _ = storage(root)
    total = 0
    for _, _, folder, start, end in wanted:
        begin, stop = _stretch(files, Index(files, folder), f"{folder}/{SEGMENT}.log", start, end)
        total += max(0, stop - begin)
    split_bytes = max(split_bytes, -(-total // SPLITS))
    return [s for p in wanted for s in splits(files, *p, split_bytes=split_bytes)]


def read_split(root: str, split: Split) -> Iterator[pa.RecordBatch]:
    if not split.path:
        return
    files, _ = storage(root)
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    with files.open_input_file(split.path) as f:
        for _, records in codec.read_segment(Ranged(f, f.size()), split.start, split.begin, split.stop):
            for r in records:
                if r.offset >= split.start and (split.end is None or r.offset < split.end):
                    rows.append((split.topic, split.partition, r.offset, r.timestamp_ms, r.producer_id, r.producer_epoch, r.sequence, r.key, r.value, r.headers.decode("utf-8", "replace")))
            if len(rows) >= ROWS:
                yield batch()
                rows = []
    if rows:
        yield batch()


def end_of(files: fs.FileSystem, folder: str) -> int:
    """The offset behind the last whole batch: what follows the last index entry is read."""
    path = f"{folder}/{SEGMENT}.log"
    size = _size(files, path)
    if not size:
        return 0
    index, end = Index(files, folder), 0
    at = index[index.entries - 1][1] if index.entries else 0
    with files.open_input_file(path) as f:
        for _, records in codec.read_segment(Ranged(f, size), 0, at if at < size else 0):
            end = max(end, records[-1].offset + 1) if records else end
    return end


def write_segment(root: str, topic: str, partition: int, batches: list[list[codec.Record]]) -> None:
    """Appends batches to a partition's segment and the entries that they get to its index and time index."""
    folder = f"{root}/topics/{topic}/partitions/{partition}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{SEGMENT}.log", "ab") as log, open(f"{folder}/{SEGMENT}.index", "ab") as index, open(f"{folder}/{SEGMENT}.timeindex", "ab") as times:
        for records in batches:
            if records and codec.indexed(records[0].offset):
                index.write(codec.encode_index([(records[0].offset, log.tell())]))
                times.write(codec.encode_index([(max(r.timestamp_ms for r in records), records[0].offset)]))
            log.write(codec.encode_batch(records))


def runs(frame: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((topic, partition), rows) of the stretches of sorted rows that have them in common."""
    at = 0
    while at < frame.num_rows:
        own = tuple(frame.column(c)[at].as_py() for c in ("topic", "partition"))
        low, high = at + 1, frame.num_rows
        while low < high:  # rows are sorted, so equal ones stand together
            middle = (low + high) // 2
            same = tuple(frame.column(c)[middle].as_py() for c in ("topic", "partition")) == own
            low, high = (middle + 1, high) if same else (low, middle)
        yield own, frame.slice(at, low - at)
        at = low


def write_log(log: DataFrame, root: str, batch: int = 16) -> DataFrame:
    """(topic, partition, records, batches, bytes) of the segments that a log is written to, in batches of aligned offsets.

    A segment is one file in the order of offsets, so a partition is one task's, which streams it, encodes many batches at once and
    holds a stretch of rows.  Files are written aside and then put in place: a task that runs again replaces what it wrote.  Null
    headers are stored as none.
    """
    columns = [F.col(c) for c in ("topic", "partition", "offset", "timestamp_ms", "producer_id", "producer_epoch", "sequence", "key", "value")]
    headers = F.col("headers").cast("string") if "headers" in log.columns else F.lit("[]")
    rows = log.select(*columns, F.coalesce(headers, F.lit("[]")).alias("headers")).repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    schema = "topic string, partition int, records bigint, batches bigint, bytes bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    absent = {"timestamp_ms": 0, "producer_id": -1, "producer_epoch": -1, "sequence": -1}

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = storage(root)
        done: list[dict] = []
        key, sinks = None, {}
        waiting: pa.Table | None = None  # of a batch that may go on

        def put(table: pa.Table, whole: bool) -> pa.Table:
            """Writes the batches of a stretch, without the last unless it is ``whole``, and gives the rows left."""
            number = table.column("offset").to_numpy() // batch
            starts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1))
            upto = table.num_rows
            if not whole:
                starts, upto = starts[:-1], int(starts[-1])
            if upto:
                body, at, greatest = codec.encode_batches(table.slice(0, upto), starts)
                first = table.column("offset").to_numpy()[starts]
                kept = codec.indexed(first)
                sinks["index"].write(np.stack([first, done[-1]["bytes"] + at], 1)[kept].astype("<i8").tobytes())
                sinks["timeindex"].write(np.stack([greatest, first], 1)[kept].astype("<i8").tobytes())
                sinks["log"].write(body)
                for k, v in (("records", upto), ("batches", len(starts)), ("bytes", body.size)):
                    done[-1][k] += v
            return table.slice(upto)

        def close() -> None:
            nonlocal waiting
            if waiting is not None:
                put(waiting, True)
                waiting = None
            for kind, sink in sinks.items():
                sink.close()
                path = f"{base}/topics/{key[0]}/partitions/{key[1]}/{SEGMENT}.{kind}"
                files.move(f"{path}.{tag}", path)
            sinks.clear()

        tag = f"{os.getpid()}-{os.urandom(8).hex()}"
        for frame in frames:
            for own, rows in runs(frame):
                if own != key:
                    close()
                    key = own
                    done.append({"topic": key[0], "partition": key[1], "records": 0, "batches": 0, "bytes": 0})
                    folder = f"{base}/topics/{key[0]}/partitions/{key[1]}"
                    files.create_dir(folder, recursive=True)
                    sinks.update({kind: files.open_output_stream(f"{folder}/{SEGMENT}.{kind}.{tag}") for kind in ("log", "index", "timeindex")})
                rows = pa.Table.from_batches([rows]).select(FIELDS)
                for name, value in absent.items():
                    rows = rows.set_column(rows.column_names.index(name), name, rows.column(name).fill_null(value))
                waiting = put(rows if waiting is None else pa.concat_tables([waiting, rows]), False)
        close()
        yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return rows.mapInArrow(each, schema)


def read_index(spark: SparkSession, root: str, kind: str = "index") -> DataFrame:
    """(topic, partition, first, second) of the entries of the index files: base offset and position, of the time index greatest
    timestamp and base offset."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(f"{root}/topics").select("path", "content")

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, content in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                *_, topic, _, partition, _ = path.split("/")
                entries = codec.decode_index(content)
                columns = [pa.array([topic] * len(entries), pa.string()), pa.array([int(partition)] * len(entries), pa.int32()), *(pa.array([e[k] for e in entries], pa.int64()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["topic", "partition", "first", "second"])

    return files.mapInArrow(each, "topic string, partition int, first bigint, second bigint")


class SegmentReader(DataSourceReader):
    def __init__(self, root: str, split_bytes: int = SPLIT_BYTES) -> None:
        self.root, self.split_bytes, self.topic, self.number, self.start = root, split_bytes, None, None, 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name == "topic" and self.topic in (None, f.value):
                self.topic = f.value
            elif isinstance(f, EqualTo) and name == "partition" and self.number in (None, f.value):
                self.number = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "offset":
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            else:
                yield f

    def partitions(self) -> list[Split]:
        chosen = [(*p, self.start, None) for p in folders(self.root) if self.topic in (None, p[0]) and self.number in (None, p[1])]
        return plan(self.root, chosen, self.split_bytes) or [Split("", -1, "", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.root, split)


class SegmentStream(DataSourceStreamReader):
    def __init__(self, root: str, split_bytes: int = SPLIT_BYTES) -> None:
        self.root, self.split_bytes = root, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _ = storage(self.root)
        ends = {json.dumps([topic, partition]): end_of(files, folder) for topic, partition, folder in folders(self.root)}
        return {k: n for k, n in ends.items() if n}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        wanted = []
        for topic, partition, folder in folders(self.root):
            key = json.dumps([topic, partition])
            if start.get(key, 0) < end.get(key, 0):
                wanted.append((topic, partition, folder, start.get(key, 0), end[key]))
        return plan(self.root, wanted, self.split_bytes)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.root, split)


class LogSegments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def streamReader(self, schema) -> SegmentStream:
        return SegmentStream(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters are only pushed to Python sources when this setting is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSegments)
