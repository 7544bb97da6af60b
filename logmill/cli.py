"""python -m logmill.cli topic-summary ROOT TOPIC | storage-summary ROOT | rebuild-indexes ROOT: a segment folder's administration."""

from __future__ import annotations

import argparse
import json
import os

from logmill.functions import codec
from logmill.sources.segments import SEGMENT, folders


def _segment(folder: str) -> bytes:
    path = f"{folder}/{SEGMENT}.log"
    if not os.path.exists(path):
        return b""
    with open(path, "rb") as f:
        return f.read()


def topic_summary(root: str, topic: str) -> dict:
    """Next, first and segment base offset of each partition; the end is that of the last whole batch."""
    found = []
    for name, partition, folder in folders(root):
        if name == topic:
            end = max((records[-1].offset + 1 for _, records in codec.read_segment(_segment(folder)) if records), default=0)
            found.append({"partition": partition, "next_offset": end, "log_start_offset": 0, "active_segment_base_offset": 0})
    return {"topic": topic, "partitions": found}


def storage_summary(root: str) -> dict:
    sizes = {"log": 0, "index": 0, "timeindex": 0, "journal": 0, "total": 0}
    for place, _, names in os.walk(root):
        for name in names:
            size = os.path.getsize(f"{place}/{name}")
            sizes["total"] += size
            kind = name.rpartition(".")[2]
            if kind in sizes and kind != "total":
                sizes[kind] += size
    return {"topics": len({t for t, _, _ in folders(root)})} | {f"{k}_bytes": v for k, v in sizes.items()}


def rebuild_indexes(root: str) -> dict:
    """Cuts torn tails and writes an index entry for each batch."""
    cut = entries = 0
    for _, _, folder in folders(root):
        data = _segment(folder)
        end = codec.valid_length(data)
        if end < len(data):
            os.truncate(f"{folder}/{SEGMENT}.log", end)
            cut += len(data) - end
        batches = list(codec.read_segment(data[:end]))
        with open(f"{folder}/{SEGMENT}.index", "wb") as f:
            f.write(codec.encode_index((r[0].offset, p) for p, r in batches if r))
        with open(f"{folder}/{SEGMENT}.timeindex", "wb") as f:
            f.write(codec.encode_index((max(x.timestamp_ms for x in r), r[0].offset) for _, r in batches if r))
        entries += len(batches)
    return {"entries": entries, "bytes_cut": cut}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="logmill", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("topic-summary", "storage-summary", "rebuild-indexes"):
        p = sub.add_parser(name)
        p.add_argument("root")
        if name == "topic-summary":
            p.add_argument("topic")
    a = parser.parse_args(args)
    said = topic_summary(a.root, a.topic) if a.command == "topic-summary" else storage_summary(a.root) if a.command == "storage-summary" else rebuild_indexes(a.root)
    print(json.dumps(said))


if __name__ == "__main__":
    main()
