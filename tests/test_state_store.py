import json
import os

import pytest

from logmill import cli
from logmill.functions.codec import Record
from logmill.operators.cluster import may_auto_create, may_write
from logmill.sources import segments
from logmill.sources.state_store import MetadataStore, StateJournal, with_retry


def test_metadata_is_compared_appended_and_recovered(tmp_path):
    root = str(tmp_path)
    s = MetadataStore(root)
    s.LEAST_LOG = 1
    assert s.append(-1, ["a"]) and not s.append(-1, ["b"]) and s.offset == 0
    s.append_with_retry(["b", "c"])
    assert MetadataStore(root).records == ["a", "b", "c"]
    # a crash between the snapshot and the log's end, and in the middle of a line
    with open(f"{root}/cluster/metadata.log", "ab") as f:
        f.write(b'{"metadata_offset": 2, "record": "c"}\n{"metadata_offset": 3, "record": "d"}\n{"metadata_offset": 4, "rec')
    again = MetadataStore(root)
    assert again.records == ["a", "b", "c", "d"] and os.path.getsize(f"{root}/cluster/metadata.log") < 200
    assert again.append(3, ["e"]) and MetadataStore(root).offset == 4


def test_a_writer_that_was_overtaken_tries_again(tmp_path):
    root = str(tmp_path)
    one, two = MetadataStore(root), MetadataStore(root)
    assert two.append(-1, ["x"]) and one.offset == -1
    assert not one.append(-1, ["y"]) and one.offset == 0
    assert two.append(0, ["z"])
    one.append_with_retry(["y"])
    assert MetadataStore(root).records == ["x", "z", "y"] == one.records
    two.append_with_retry(["w"], attempts=2)
    with pytest.raises(RuntimeError):
        assert one.append(3, ["v"])
        two.append_with_retry(["u"], attempts=1)
    assert MetadataStore(root).records == ["x", "z", "y", "w", "v"]


def test_attempts_are_counted():
    said = iter([False, False, True])
    assert with_retry(lambda: next(said)) == 3
    tried = []
    with pytest.raises(RuntimeError):
        with_retry(lambda: bool(tried.append(1)))
    assert len(tried) == 3


def test_snapshots_are_few_and_recovered(tmp_path):
    s = MetadataStore(str(tmp_path))
    for k in range(300):
        assert s.append(k - 1, [k])
    again = MetadataStore(str(tmp_path))
    assert again.records == list(range(300)) and again.in_snapshot == 256


def test_journal_survives_a_torn_end(tmp_path):
    root = str(tmp_path)
    j = StateJournal(root)
    j.append("Offsets", {"g:t:0": 1})
    j.append("Groups", {"g": 1})
    j.append("Offsets", {"g:t:0": 2}, durable=False)
    with open(f"{root}/state/Producers.snapshot", "w") as f:
        json.dump({"next": 3}, f)
    with open(f"{root}/state/state.journal", "ab") as f:
        f.write(b"KFSJ\xff\xff")
    assert StateJournal(root).state == {"Offsets": {"g:t:0": 2}, "Producers": {"next": 3}}


def test_administration(tmp_path, capsys):
    root = str(tmp_path)
    segments.write_segment(root, "t", 0, [[Record(o, o, value=b"v")] for o in range(20)])
    path = f"{root}/topics/t/partitions/0/{segments.SEGMENT}"
    whole = os.path.getsize(f"{path}.log")
    with open(f"{path}.log", "ab") as f:
        f.write(b"partial-tail")
    cli.main(["topic-summary", root, "t"])
    assert json.loads(capsys.readouterr().out)["partitions"] == [{"partition": 0, "next_offset": 20, "log_start_offset": 0, "active_segment_base_offset": 0}]
    cli.main(["rebuild-indexes", root])
    assert json.loads(capsys.readouterr().out) == {"entries": 20, "bytes_cut": 12} and os.path.getsize(f"{path}.log") == whole and os.path.getsize(f"{path}.index") == 320
    cli.main(["storage-summary", root])
    assert json.loads(capsys.readouterr().out) == {"topics": 1, "log_bytes": whole, "index_bytes": 320, "timeindex_bytes": 320, "journal_bytes": 0, "total_bytes": whole + 640}


def test_topics_may_be_created_by_a_single_controller_or_the_leader():
    assert may_auto_create([], 1, None, []) and may_auto_create([1], 1, None, ["controller"]) and may_auto_create([1, 2], 1, 1, ["controller"])
    assert not may_auto_create([1, 2], 1, 2, ["controller"]) and not may_auto_create([1], 1, 1, ["broker"])


def test_write_authority():
    assert may_write([], 1, None, []) and may_write([1, 2], 1, 1, ["controller"]) and not may_write([1, 2], 1, 2, ["controller"]) and not may_write([1], 1, 1, ["broker"])
