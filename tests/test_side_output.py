import json

import pytest

from tidewell.functions import lsn
from tidewell.operators import changelog
from tidewell.sources import changefiles
from tidewell.sources.tablelog import Catalog
from tidewell.streaming.apply import Applier, SourceTable

SOURCE = "123e4567-e89b-12d3-a456-426614174009"
TABLE = ("public", "goods")


def change(commit, key, n=0):
    return {"schema": "public", "table": "goods", "op": "insert", "before": None, "after": {"id": key}, "position": lsn.show(commit - 5 + n), "commit_position": lsn.show(commit), "commit_timestamp_us": 0}


def add(folder, name, *items):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{name}.jsonl", "a", encoding="utf-8") as f:
        for x in items:
            f.write((x if isinstance(x, str) else json.dumps({"progress": lsn.show(x)} if isinstance(x, int) else x)) + "\n")


@pytest.fixture
def applier(spark, tmp_path):
    return Applier(Catalog(spark, f"file://{tmp_path}/lake"), SOURCE, {TABLE: SourceTable([("id", "integer")], ["id"])}, dead_letters=True)


def deliver(spark, applier, tmp_path, checkpoint="c", cap=2):
    changefiles.register(spark)
    stream = spark.readStream.format("changefiles").option("cap", cap).option("split", 1).load(str(tmp_path / "log"))
    query = stream.writeStream.foreachBatch(applier.foreach_batch).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_good_rows_refused_rows_and_decode_errors(spark, applier, tmp_path):
    log = tmp_path / "log"
    add(log, "1", change(10, "1"), '{"schema": "public", ', 11, change(20, "no number"), change(20, "2", 1), 21, {"error": "truncated message"}, 22, '{"schema": "public"}', change(30, "3"), 31)
    deliver(spark, applier, tmp_path)
    rows = lambda: sorted(r.id for r in applier.table(*TABLE).scan().collect())
    letters = lambda: sorted((r.kind, r.line, r.columns or "") for r in applier.letters().scan().collect())
    assert rows() == [1, 2, 3]
    want = [("decode", 1, ""), ("decode", 6, ""), ("decode", 8, ""), ("refused", 3, "id")]
    assert letters() == want
    texts = [r.content for r in applier.letters().scan().where("kind = 'decode'").orderBy("line").collect()]
    assert texts[0].endswith(': {"schema": "public", \n') and texts[1].startswith("truncated message") and texts[2].startswith("no change: ")
    # all of it once more, in other batches: nothing is added
    deliver(spark, applier, tmp_path, "lost", cap=100)
    assert rows() == [1, 2, 3] and letters() == want
    add(log, "2", change(40, "bad"), "oops", 41)
    deliver(spark, applier, tmp_path)
    assert letters() == [*want[:3], ("decode", 12, ""), ("refused", 3, "id"), ("refused", 11, "id")] and rows() == [1, 2, 3]


def test_batches_cost_what_they_hold(tmp_path, monkeypatch):
    log = tmp_path / "log"
    for n in range(40):
        add(log, f"{n:03}", *[x for k in range(5) for x in (change(100 * n + 10 * k + 10, str(k)), 100 * n + 10 * k + 11)])
    opened = []
    monkeypatch.setattr(changefiles, "open", lambda p, *a, **k: opened.append(p) or open(p, *a, **k), raising=False)
    reader = changefiles._Reader({"path": str(log), "cap": "7", "split": "3"})
    at, seen, calls = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != at:
        opened.clear()
        parts = reader.partitions(at, end)
        rows = [r for p in parts for r in reader.read(p)]
        assert len(opened) <= 3 * (len(parts) + 1) and sum(r[2] == "insert" for r in rows) <= 7
        assert len(parts) >= 2 or end["line"] == 400
        assert all(list(reader.read(p))[-1][2] == "progress" for p in parts)
        seen += rows
        at, calls = end, calls + 1
    assert [r[8] for r in seen] == list(range(400)) and calls == -(-200 // 7)
    # a restart goes on from an offset, in a new reader
    again = changefiles._Reader({"path": str(log), "cap": "7"})
    again.partitions(at, at)
    assert again.latestOffset() == at
    add(log, "040", 9999)
    moved = again.latestOffset()
    assert moved["line"] == 401 and [r[2] for p in again.partitions(at, moved) for r in again.read(p)] == ["progress"]


def test_a_line_that_is_still_written_waits(tmp_path):
    log = tmp_path / "log"
    add(log, "1", change(10, "1"), 11)
    with open(log / "1.jsonl", "a") as f:
        f.write('{"progress": "0/')
    reader = changefiles._Reader({"path": str(log)})
    assert reader.latestOffset()["line"] == 2
    with open(log / "1.jsonl", "a") as f:
        f.write('FF"}')
    assert reader.latestOffset()["line"] == 3


def test_a_large_transaction_is_whole(tmp_path):
    add(tmp_path / "log", "1", *[change(10, str(k)) for k in range(9)], 11, change(20, "x"), 21)
    reader = changefiles._Reader({"path": str(tmp_path / "log"), "cap": "4"})
    assert reader.latestOffset()["line"] == 10 and reader.latestOffset()["line"] == 12


def test_decoded(spark):
    good = json.dumps(change(10, "1"))
    lines = spark.createDataFrame([(good,), (good[:-1],), ("",), (None,), ("[]",), ('{"schema": "s"}',), ("7",)], "line string")
    got = changelog.decoded(lines).collect()
    assert sorted(str(r.error) for r in got) == sorted(["None", good[:-1], "", "", "[]", '{"schema": "s"}', "7"])
    assert [r.after for r in got if r.error is None] == [{"id": "1"}] and all(r.op is None for r in got if r.error is not None)
