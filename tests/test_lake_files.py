import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import lsn
from tidewell.operators import changelog, maintenance
from tidewell.operators.maintenance import Policy
from tidewell.sources.tablelog import Catalog, File, NoSuchTable, State

COLUMNS = [("id", "bigint"), ("name", "text"), ("ratio", "double precision")]
OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}


def rows_of(commit):
    return [("insert", "s", lsn.show(0x100 * commit + 7 * k), commit * 1000 + k, 10 * commit + k, ["é", "b" * 200, None, f"n{commit}"][k % 4], 0.5) for k in range(8)]


@pytest.fixture
def table(spark, tmp_path):
    made = Catalog(spark, f"file://{tmp_path}").create("ns", "t", changelog.schema(COLUMNS), ["id", "name"])
    for n in range(10):
        made.append(spark.createDataFrame(rows_of(n), changelog.schema(COLUMNS)).coalesce(1), lsn.show(0x100 * n + 0xFF), "s")
    return made


def opened(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_range_scans_open_few_files(table):
    every = [r for n in range(10) for r in rows_of(n)]
    at = dict(zip(("_position", "_commit_timestamp_us", "id", "name"), (2, 3, 4, 5)))
    asked = [
        ([("_position", ">=", "0/300"), ("_position", "<", "0/500")], 2),
        ([("_position", "=", "0/20E")], 1),
        ([("_position", ">", "0/931")], 0),
        ([("_position", ">=", "0/A00")], 0),
        ([("_commit_timestamp_us", "<=", 1003)], 2),
        ([("id", "=", 35), ("_commit_timestamp_us", ">", 0)], 1),
        ([("id", ">", 35), ("id", "<", 60)], 3),
        ([("id", "<", 0)], 0),
        ([("name", ">", "zzzz")], 10),  # é is above it
        ([("name", "<", "b")], 0),
        ([("name", "=", "n4")], 10),
    ]
    for where, files in asked:
        got = table.scan(where=where)
        value = lambda c, x: lsn.parse(x) if c == "_position" else x
        want = [r for r in every if all(r[at[c]] is not None and OPS[op](value(c, r[at[c]]), value(c, v)) for c, op, v in where)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert len(opened(got)) == len(table.files(where)) == files, where
    with pytest.raises(ValueError, match="comparison"):
        table.scan(where=[("id", "~", 1)])


def test_bounds_of_long_texts_and_of_nulls():
    f = File("x", 1, 1, 1, (("name", "b" * 64, None), ("id", None, None)))
    assert f.may_have([("name", ">", "zz")]) and not f.may_have([("name", "<", "a")]) and f.may_have([("id", "=", 3)]) and f.may_have([("other", "=", 3)])


def test_entries_without_bounds_are_read(table):
    _, state = table.load()
    text = state.to_json()
    assert State.from_json(text) == state
    import json

    old = json.loads(text)
    for s in old["snapshots"]:
        for f in s["files"]:
            del f["bounds"]
    again = State.from_json(json.dumps(old))
    assert len(table.files([("id", "=", 35)], state=again)) == 10 and len(table.files([("id", "=", 35)], state=state)) == 1


def test_travel_by_time(table):
    _, state = table.load()
    for n, s in enumerate(state.snapshots):
        later = [t.timestamp_ms for t in state.snapshots if t.timestamp_ms > s.timestamp_ms]
        if not later or later[0] > s.timestamp_ms:
            same = max(k for k, t in enumerate(state.snapshots) if t.timestamp_ms <= s.timestamp_ms)
            assert table.scan(as_of_ms=s.timestamp_ms).count() == 8 * (same + 1)
    assert table.scan(as_of_ms=state.snapshots[0].timestamp_ms - 1).count() == 0
    assert table.scan(state.snapshots[2].id, [("id", ">=", 10)]).count() == 16
    with pytest.raises(NoSuchTable):
        table.scan(5)


def test_ten_bins_are_rewritten_in_one_job(spark, tmp_path):
    """Thirty files to ten, with the rows and their order as before, and bounds that stay narrow."""
    table = Catalog(spark, f"file://{tmp_path}").create("ns", "t", changelog.schema(COLUMNS), ["id"])
    rng = random.Random(3)
    for n in range(30):
        rows = [(*r[:4], rng.randrange(10**6), *r[5:]) for r in rows_of(n)]
        table.append(spark.createDataFrame(rows, changelog.schema(COLUMNS)).coalesce(1), None, "s")
    before = [f for f in table.load()[1].current.files]
    order = [tuple(r) for f in sorted(before, key=lambda f: f.sequence) for r in spark.read.schema(table.schema()).parquet(f.path).collect()]
    size = max(f.size for f in before)
    bins = maintenance.plan(before, Policy(target=3 * size, small=3 * size, least_files=3))
    assert len(bins) == 10 and all(len(b) == 3 for b in bins)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("rewrite", "rewrite")
    made = maintenance.rewrite(table, bins)
    jobs = len(tracker.getJobIdsForGroup("rewrite"))
    sc.setJobGroup("rest", "rest")
    assert [len(b) for b in made] == [1] * 10 and [b[0].rows for b in made] == [24] * 10 and jobs < 10
    assert maintenance.compact(table, Policy(target=3 * size, small=3 * size, least_files=3))["bins"] == 10
    after = sorted(table.load()[1].current.files, key=lambda f: f.sequence)
    assert [tuple(r) for f in after for r in spark.read.schema(table.schema()).parquet(f.path).collect()] == order
    assert all(a.bounds[0][2] < b.bounds[0][1] for a, b in zip(after, after[1:]))
    got = table.scan(where=[("_position", "<", "0/300")])
    assert len(opened(got)) == 1 and got.count() == 24 and got.agg(F.max("_commit_timestamp_us")).first()[0] == 2007
    assert maintenance.rewrite(table, []) == []
