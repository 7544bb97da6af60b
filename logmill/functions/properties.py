"""Server properties: ``key=value`` lines with ``#`` comments; of a repeated key the last value counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULTS = {"node.id": "1", "num.partitions": "1", "log.dirs": "data", "listeners": "PLAINTEXT://127.0.0.1:9092"}


@dataclass(frozen=True)
class Config:
    node_id: int
    partitions: int
    log_dir: str
    listeners: dict[str, tuple[str, int]]
    voters: dict[int, tuple[str, int]]
    roles: tuple[str, ...]


def parse(text: str) -> dict[str, str]:
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, mark, value = line.partition("=")
        if not mark or not key.strip():
            raise ValueError(f"line {number} is no key=value")
        out[key.strip()] = value.strip()
    return out


def address(text: str, what: str) -> tuple[str, int]:
    host, mark, port = text.rpartition(":")
    if not mark or not port.isdigit() or not 0 < int(port) < 65536:
        raise ValueError(f"{what} needs host:port, not {text!r}")
    return host or "0.0.0.0", int(port)


def load(text: str) -> Config:
    """The configuration, or ValueError: one log directory, at least one partition, known listeners and voters."""
    p = DEFAULTS | parse(text)
    items = lambda key: [x.strip() for x in p.get(key, "").split(",") if x.strip()]
    listeners = {}
    for item in items("listeners"):
        name, mark, rest = item.partition("://")
        if not mark or not name:
            raise ValueError(f"listener {item!r} is no NAME://host:port")
        listeners[name.upper()] = address(rest, "a listener")
    voters = {}
    for item in items("controller.quorum.voters"):
        node, mark, rest = item.partition("@")
        if not mark or not node.isdigit():
            raise ValueError(f"voter {item!r} is no id@host:port")
        voters[int(node)] = address(rest, "a voter")
    dirs = items("log.dirs")
    if len(dirs) != 1:
        raise ValueError("log.dirs must name one directory")
    try:
        node_id, partitions = int(p["node.id"]), int(p["num.partitions"])
    except ValueError as e:
        raise ValueError("node.id and num.partitions must be whole numbers") from e
    if partitions < 1:
        raise ValueError("num.partitions must be at least 1")
    roles = tuple(items("process.roles")) or ("broker", "controller")
    if set(roles) - {"broker", "controller"}:
        raise ValueError(f"unknown role in {roles}")
    return Config(node_id, partitions, dirs[0], listeners, voters, roles)


LOADED = "id bigint, node_id bigint, partitions bigint, log_dir string, listeners string, voters string, roles string, error string"


def load_all(files: DataFrame) -> DataFrame:
    """``load`` of each of ``files`` (id, text), or the error that it gives; listeners and voters as "name=host:port, ..."."""
    names = [c.split()[0] for c in LOADED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    c = load(text or "")
                    told = [", ".join(f"{n}={h}:{p}" for n, (h, p) in x.items()) for x in (c.listeners, c.voters)]
                    out.append((k, c.node_id, c.partitions, c.log_dir, *told, ",".join(c.roles), None))
                except ValueError as e:
                    out.append((k, *[None] * 6, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return files.select("id", "text").mapInArrow(each, LOADED)
