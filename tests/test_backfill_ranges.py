import pytest

from test_side_output import add, change

from tidewell.functions import lsn
from tidewell.operators import changelog
from tidewell.operators.current import current_rows
from tidewell.sources import changefiles
from tidewell.sources.tablelog import Catalog
from tidewell.streaming import backfill
from tidewell.streaming.apply import Applier, SourceTable

SOURCE = "123e4567-e89b-12d3-a456-426614174010"
COLUMNS = [("a", "integer"), ("b", "text"), ("n", "integer")]


@pytest.fixture
def table(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/lake").create("ns", "public__t", changelog.schema(COLUMNS), ["a", "b"])


def rows_of(spark, count=500):
    data = [(i % 7 if i % 3 else 3, f"k{i:04}\u00e9" if i % 2 else f"K{i}", i) for i in range(count)]  # a first column with a hot value
    return spark.createDataFrame(data, "a int, b string, n int"), data


def landed(table):
    return sorted(tuple(r) for r in table.scan().select("a", "b", "n").collect())


def test_ranges_are_even_apart_and_whole(spark, table):
    rows, data = rows_of(spark)
    assert backfill.fill(table, SOURCE, rows, ["a", "b"], size=50) == {"state": "done"}
    assert landed(table) == sorted(data) and len(table.load()[1].snapshots) == 1
    ends = []
    for f in table.files():
        own = [(r.a, r.b.encode()) for r in spark.read.parquet(f.path).collect()]
        assert own == sorted(own) and len(own) == 50
        ends.append((own[0], own[-1]))
    ends.sort()
    assert len(ends) == 10 and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    assert backfill.fill(table, SOURCE, rows, ["a", "b"]) == {"state": "done"} and table.scan().count() == 500


def test_large_ranges_are_parted(spark, table, monkeypatch):
    """What one task sorts and writes does not grow with the range that was asked for."""
    monkeypatch.setattr(backfill, "RANGE", 50)
    rows, data = rows_of(spark)
    assert backfill.fill(table, SOURCE, rows, ["a", "b"], size=250) == {"state": "done"}
    assert landed(table) == sorted(data) and [f.rows for f in table.files()] == [50] * 10


def test_bounds_of_files_without_sorting_the_rows(spark, table, monkeypatch):
    kind = type(table.scan())
    plans, own = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1])
    rows, data = rows_of(spark)
    backfill.fill(table, SOURCE, rows, ["a", "b"], size=250)
    bounds = [p for p in plans if "file_name" in p]
    assert bounds and not any("SortAggregate" in p for p in bounds)
    assert sum(f.rows for f in table.files()) == len(data)


def test_ranges_as_compared_one_by_one(spark):
    data = [(a, b) for a in (None, 1, 2, 3, 4) for b in (None, "", "k", "l", "m\u00e9")]
    rows, bounds = spark.createDataFrame(data, "`a.0` int, b string"), [["1", "k"], ["2", ""], ["2", "l"], ["3", "k"], ["3", "m"]]
    for n in range(len(bounds) + 1):
        for r in rows.withColumn("n", backfill.range_of(rows, ["a.0", "b"], bounds[:n])).collect():
            behind = [r[0] is not None and (r[0] > int(x) or (r[0] == int(x) and r[1] is not None and r[1] > y)) for x, y in bounds[:n]]
            assert r.n == sum(behind)


def test_goes_on_behind_the_last_wave(spark, table, monkeypatch):
    rows, data = rows_of(spark)
    calls = []
    write = table.write_files

    def failing(df, prefix, sequence=0):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return write(df, prefix, sequence)

    monkeypatch.setattr(table, "write_files", failing)
    with pytest.raises(OSError):
        backfill.fill(table, SOURCE, rows, ["a", "b"], size=50, at_once=3)
    assert backfill.state_of(table)["next"] == 6 and table.scan().count() == 300
    assert backfill.fill(table, SOURCE, rows, ["a", "b"], size=7, at_once=3) == {"state": "done"}  # the cuts stay those of the first call
    assert landed(table) == sorted(data) and len(calls) == 5


def test_a_wave_asks_the_source_for_its_keys_only(spark, tmp_path):
    spark.range(1000).selectExpr("id AS a", "id AS n").write.parquet(str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    plan = backfill.wave(rows, ["a"], [["100"], ["200"], ["300"]], 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,100)" in plan and "LessThanOrEqual(a,200)" in plan and plan.count("Scan parquet") == 1


def test_nulls_repeats_and_no_rows(spark, table):
    data = [(None, "x", 1), (3, None, 2), (3, None, 2), (None, None, 3)] + [(i, "y", i) for i in range(10)] * 2
    rows = spark.createDataFrame(data, "a int, b string, n int")
    assert backfill.fill(table, SOURCE, rows, ["a", "b"], size=4, at_once=2)["state"] == "done"
    order = lambda t: tuple((x is not None, x) for x in t)
    got = sorted((tuple(r) for r in table.scan().select("a", "b", "n").collect()), key=order)
    assert got == sorted(data, key=order)
    catalog = Catalog(spark, table.store.root)
    empty = catalog.create("ns", "empty", table.schema(), ["a", "b"])
    assert backfill.fill(empty, SOURCE, rows.limit(0), ["a", "b"]) == {"state": "done"} and empty.scan().count() == 0
    keyless = catalog.create("ns", "keyless", table.schema(), [])
    assert backfill.fill(keyless, SOURCE, rows, [])["state"] == "skipped"


def test_of_two_backfills_one_goes_on(spark, table):
    rows, data = rows_of(spark, 100)
    with pytest.raises(backfill.Overtaken):
        inner = []

        def other() -> bool:
            if not inner:
                inner.append(backfill.fill(table, SOURCE, rows, ["a", "b"], at_once=1))
            return False

        backfill.fill(table, SOURCE, rows, ["a", "b"], size=30, at_once=1, stop=other)
    assert inner == [{"state": "done"}] and landed(table) == sorted(data)
    named = {f.path.split(":", 1)[-1].lstrip("/") for f in table.files()}
    assert {p.split(":", 1)[-1].lstrip("/") for p, _, _ in table.store.list(f"{table.root}/data") if p.endswith(".parquet")} == named


def test_beside_a_running_stream(spark, tmp_path):
    """Both commit to one table in one session; what is current in the end is what the source has."""
    applier = Applier(Catalog(spark, f"file://{tmp_path}/lake"), SOURCE, {("public", "goods"): SourceTable([("id", "integer")], ["id"])})
    table, log = applier.table("public", "goods"), tmp_path / "log"
    add(log, "0", 1)
    changefiles.register(spark)
    stream = spark.readStream.format("changefiles").option("cap", 2).load(str(log))
    query = stream.writeStream.foreachBatch(applier.foreach_batch).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    source = spark.range(200).selectExpr("CAST(id AS int) AS id")
    turns = iter(range(100))

    def more() -> bool:
        n = next(turns)
        add(log, f"{n + 1}", {**change(10 * n + 10, str(n * 10)), "op": "delete", "before": {"id": str(n * 10)}, "after": None}, 10 * n + 11)
        add(log, f"{n + 1}", change(10 * n + 15, str(1000 + n)), 10 * n + 16)
        return False

    try:
        state = backfill.fill(table, SOURCE, source, ["id"], size=25, at_once=2, stop=more)
        query.processAllAvailable()
    finally:
        query.stop()
    assert state == {"state": "done"} and next(turns) == 4
    want = sorted({*range(200), 1000, 1001, 1002, 1003} - {0, 10, 20, 30})
    assert sorted(r.id for r in current_rows(table.scan(), ["id"]).collect()) == want
    kinds = {s.operation for s in table.load()[1].snapshots}
    assert kinds == {"append"} and table.checkpoint() == (lsn.show(45), False)
