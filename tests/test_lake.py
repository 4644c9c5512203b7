import datetime as dt
import json
import threading
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import lsn, naming
from tidewell.operators import changelog, maintenance, ownership
from tidewell.operators.maintenance import Policy
from tidewell.plans.cache import Cache
from tidewell.plans.saved import SavedQueries, Source, Sources, checked_query, may
from tidewell.plans.service import CatalogError, ExecutionError, QueryService, envelope, failure, is_metadata, to_json
from tidewell.sources import tablelog
from tidewell.sources.tablelog import Catalog, Conflict, File, NoSuchTable
from tidewell.streaming import backfill

SOURCE = "123e4567-e89b-12d3-a456-426614174000"
NS = naming.namespace_of(SOURCE)
COLUMNS = [("id", "integer"), ("name", "text")]


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}")


def batch(spark, n):
    rows = [("insert", SOURCE, f"0/{16 * n + k:X}", 0, 3 * n + k, f"n{k}") for k in range(3)]
    return spark.createDataFrame(rows, changelog.schema(COLUMNS))


def mark(n):
    return f"0/{16 * n + 15:X}"


@pytest.fixture
def filled(spark, catalog):
    table = catalog.create(NS, "public__t", changelog.schema(COLUMNS), ["id"])
    for n in range(4):
        table.append(batch(spark, n).coalesce(1), mark(n), SOURCE)
    return table


def test_rows_and_checkpoint_land_together(spark, filled):
    assert filled.scan().count() == 12 and filled.checkpoint() == (mark(3), False) and filled.keys() == ["id"]
    summary = filled.load()[1].current.summary
    assert summary["total-records"] == "12" and summary["added-records"] == "3"
    before = filled.version()
    filled.append(batch(spark, 0).limit(0), None, SOURCE)
    assert filled.version() == before
    filled.append(None, None, SOURCE, properties={"a": "b"})
    _, state = filled.load()
    assert state.properties["a"] == "b" and len(state.snapshots) == 4 and filled.checkpoint() == (mark(3), False)


def test_racing_writers_lose_nothing(spark, filled, monkeypatch):
    monkeypatch.setattr(tablelog, "PAUSE", 0.01)
    monkeypatch.setattr(tablelog, "ATTEMPTS", 12)
    errors = []

    def work(n):
        try:
            files = filled.write_files(batch(spark, n).coalesce(1), "cdc")
            filled.commit(lambda s: tablelog.replace(s, sequence=s.sequence + 1, snapshots=(*s.snapshots, tablelog.snapshot(s, "append", {}, s.current.files + files, ()))), attempts=20)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(10, 14)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and filled.scan().count() == 12 + 12


def test_time_travel_and_metadata_tables(filled):
    _, state = filled.load()
    assert filled.scan(state.snapshots[0].id).count() == 3
    with pytest.raises(NoSuchTable):
        filled.scan(-1)
    assert filled.metadata("snapshots").count() == 4 and filled.metadata("history").where("is_current_ancestor").count() == 4
    assert filled.metadata("manifests").where(F.col("snapshot_id") == state.current.id).count() == 4


def test_legacy_checkpoint_and_unreadable_keys(spark, catalog):
    table = catalog.create(NS, "x", changelog.schema(COLUMNS))
    assert table.keys() is None and table.checkpoint() == (None, False)
    table.commit(lambda s: tablelog.replace(s, properties={tablelog.KEYS: "not json"}, snapshots=(tablelog.snapshot(s, "append", {tablelog.LEGACY_CHECKPOINT: "0/9"}, (), ()),)))
    assert table.keys() is None and table.checkpoint() == ("0/9", True)
    table.set_property(tablelog.KEYS, '["id"]', only_if_absent=True)
    assert table.keys() is None
    table.set_property(tablelog.KEYS, '["id"]')
    assert table.keys() == ["id"]


def small(policy=None, **changes):
    return tablelog.replace(policy or Policy(target=100, small=75, least_files=3, most_bytes=1000), **changes)


def plan_of(sizes, **policy):
    """Numbers of the files in each bin, of files of these sizes in the order of their commits."""
    files = [File(f"{n:02}", size, 1, n) for n, size in enumerate(sizes)]
    return [[int(f.path) for f in b] for b in maintenance.plan(files[::-1], small(**policy))]


def test_plans():
    # the target is 100, files from 75 on are large, three files are worth it, and so are two that hold 75
    assert plan_of([20, 20, 20, 20, 20, 1, 1, 1]) == [[0, 1, 2, 3, 4], [5, 6, 7]]
    assert plan_of([5, 5, 5, 200, 74, 1, 80, 74, 2]) == [[0, 1, 2], [4, 5], [7, 8]]
    assert plan_of([5, 5, 75, 5, 74]) == [[3, 4]]
    assert plan_of([75, 99, 74]) == plan_of([40, 34]) == plan_of([]) == []
    assert plan_of([60, 41, 60, 40, 3, 3, 3], most_bytes=99) == plan_of([30, 35, 36, 3, 3], most_bytes=41) == []
    assert plan_of([60, 41, 60, 40, 3, 3, 3], most_bytes=109) == [[2, 3], [4, 5, 6]]
    assert plan_of([0, 0, 100, 0, 0, 0]) == [[3, 4, 5]]


@settings(max_examples=100)
@given(st.lists(st.integers(1, 120), max_size=30))
def test_plan_properties(sizes):
    files = [File(f"f{n:03}", s, 1, n) for n, s in enumerate(sizes)]
    bins = maintenance.plan(files, small())
    flat = [f for b in bins for f in b]
    assert flat == sorted(flat, key=lambda f: f.sequence) and len(set(flat)) == len(flat)
    for b in bins:
        assert len(b) >= 2 and sum(f.size for f in b) <= 100 and all(f.size < 75 for f in b)
        assert [f.sequence for f in b] == list(range(b[0].sequence, b[-1].sequence + 1))


def test_compaction_keeps_rows_order_and_checkpoint(spark, filled):
    before = [tuple(r) for r in filled.scan().orderBy("id").collect()]
    report = maintenance.compact(filled, Policy(least_files=2))
    _, state = filled.load()
    assert report["bins"] == 1 and report["files_in"] == 4 and len(state.current.files) == 1
    assert [tuple(r) for r in spark.read.parquet(state.current.files[0].path).collect()] == before
    assert filled.checkpoint() == (mark(3), False) and state.current.summary[tablelog.MAINTENANCE] == "compaction"


def test_compaction_races(spark, filled):
    done = []

    def append_meanwhile():
        if not done:
            done.append(filled.append(batch(spark, 9), mark(9), SOURCE))

    maintenance.compact(filled, Policy(least_files=2), append_meanwhile)
    assert filled.scan().count() == 15 and filled.checkpoint() == (mark(9), False)

    def take_inputs_away():
        filled.commit(lambda s: tablelog.replace(s, sequence=s.sequence + 1, snapshots=(*s.snapshots, tablelog.snapshot(s, "delete", {}, (), ()))))

    filled.append(batch(spark, 10), mark(10), SOURCE)
    assert maintenance.compact(filled, Policy(least_files=2), take_inputs_away)["bins"] == 0
    assert filled.scan().count() == 0


def test_expiry_and_sweep(spark, filled):
    maintenance.compact(filled, Policy(least_files=2))
    far = dt.datetime(2100, 1, 1).timestamp()
    assert maintenance.expire(filled, Policy(), far) == {"snapshots": 0, "files": 0}
    got = maintenance.expire(filled, Policy(snapshots_kept=1), far)
    assert got == {"snapshots": 4, "files": 4} and filled.scan().count() == 12 and filled.checkpoint() == (mark(3), False)
    assert maintenance.expire(filled, Policy(snapshots_kept=1), far) == {"snapshots": 0, "files": 0}
    filled.write_files(batch(spark, 5), "cdc")
    assert maintenance.sweep(filled, Policy(sweep_every=0))["orphans"] == 0
    assert maintenance.sweep(filled, Policy(), far)["orphans"] >= 1 and filled.scan().count() == 12
    assert maintenance.sweep(filled, Policy(orphan_age=None), far)["orphans"] == 0


def test_one_broken_table_does_not_stop_others(spark, catalog, filled):
    broken = catalog.create(NS, "a_broken", changelog.schema(COLUMNS))
    broken.store.create(broken._entry(1), "{")
    total = maintenance.maintain(catalog, Policy(least_files=2))
    assert total["tables"] == 2 and total["failed"] >= 1 and total["bins"] == 1


def test_backfill_in_pages(spark, catalog):
    table = catalog.create(NS, "public__customers", changelog.schema([("id", "integer"), ("email", "text")]), ["id"])
    rows = spark.createDataFrame([(n, f"{n}@x") for n in range(25)], "id int, email string")
    assert backfill.step(table, SOURCE, rows, ["id"], 10)["after"] == ["9"]
    assert backfill.run(table, SOURCE, rows, ["id"], 10) == {"state": "done"}
    landed = table.scan()
    assert landed.count() == 25 and landed.where("_op = 'read' and _position = '0/0'").count() == 25
    assert backfill.run(table, SOURCE, rows, ["id"], 10) == {"state": "done"} and table.scan().count() == 25
    changes = [("update", SOURCE, "0/10", 0, 3, "new"), ("delete", SOURCE, "0/11", 0, 4, None)]
    table.append(spark.createDataFrame(changes, table.schema()), "0/12", SOURCE)
    service = QueryService(spark, catalog)
    got = json.loads(service.read_table(NS, "public__customers"))
    assert len(got) == 24 and got[3] == {"id": 3, "email": "new"}
    keyless = catalog.create(NS, "public__audit", changelog.schema([("kind", "text")]), [])
    assert backfill.run(keyless, SOURCE, spark.createDataFrame([("a",)], "kind string"), [])["state"] == "skipped"


# queries


@pytest.fixture
def service(spark, catalog, filled):
    other = catalog.create("cdc_other", "public__t", changelog.schema(COLUMNS), ["id"])
    other.append(batch(spark, 7), mark(7), SOURCE)
    return QueryService(spark, catalog)


def test_free_sql(service):
    assert json.loads(service.query("SELECT 1 + 1 AS two, 'x' AS s", [NS])) == [{"two": 2, "s": "x"}]
    sql = f"WITH t AS (SELECT _op, id FROM lake.{NS}.public__t) SELECT _op, count(*) AS n, (SELECT max(id) FROM lake.{NS}.public__t) AS top FROM t GROUP BY _op"
    assert json.loads(service.query(sql, [NS])) == [{"_op": "insert", "n": 12, "top": 11}]
    assert json.loads(service.query(f'SELECT count(*) AS n FROM lake.{NS}."public__t$snapshots"', [NS])) == [{"n": 4}]
    assert json.loads(service.query(f"""SELECT a.id FROM lake.{NS}.public__t a JOIN lake.{NS}.public__t AS b ON a.id = b.id WHERE a.name = 'from lake.{NS}.public__t' OR b.id IN (SELECT 3) ORDER BY 1""", [NS])) == [{"id": 3}]


REJECTED = [
    "CREATE TABLE x (a int)",
    "DROP TABLE lake.a.b",
    "INSERT INTO lake.a.b VALUES (1)",
    "DELETE FROM lake.a.b",
    "UPDATE lake.a.b SET x = 1",
    "SET spark.sql.ansi.enabled = false",
    "USE lake",
    "CACHE TABLE x",
    "CREATE FUNCTION f AS 'x'",
    "CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1",
    "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1",
    "SELECT TRANSFORM (a) USING 'cat' AS b FROM VALUES (1) t(a)",
    "SELECT java_method('java.lang.System', 'exit', '0')",
    "SELECT (SELECT reflect('java.lang.System', 'getenv', 'PATH'))",
    "SELECT * FROM parquet.`/tmp`",
    "SELECT * FROM IDENTIFIER('lake.a.b')",
    "BEGIN SELECT 1; END",
    "EXPLAIN SELECT 1",
    "SHOW TABLES",
    "DESCRIBE lake.a.b",
    "SELEC 1",
    "SELECT no_such FROM VALUES (1) t(a)",
    "SELECT no_such_function(1)",
    "SELECT 1; SELECT 2",
    "",
]


@pytest.mark.parametrize("sql", REJECTED)
def test_everything_else_is_refused(service, sql):
    with pytest.raises(ExecutionError):
        service.query(sql, [NS])


def test_scope(service):
    for sql in ("SELECT * FROM lake.cdc_other.public__t", "SELECT (SELECT max(id) FROM lake.cdc_other.public__t)", f"WITH x AS (SELECT * FROM lake.cdc_other.public__t) SELECT * FROM x", f"SELECT * FROM lake.{NS}.nothing"):
        with pytest.raises(ExecutionError, match="table not found"):
            service.query(sql, [NS])
    assert json.loads(service.query("SELECT count(*) AS n FROM lake.cdc_other.public__t", ["cdc_other"])) == [{"n": 3}]
    assert json.loads(service.list_tables([NS], {NS: "shop"})) == [{"namespace": NS, "table": "public__t", "source": "shop"}]


def test_names_of_one_part_stay_inside(spark, service):
    spark.range(3).createOrReplaceGlobalTempView("private_view")
    spark.sql("CREATE TABLE IF NOT EXISTS private_stuff USING parquet AS SELECT 1 AS id")
    try:
        for sql in ("SELECT * FROM private_stuff", "SELECT * FROM default.private_stuff", "SELECT * FROM global_temp.private_view", "SELECT * FROM (WITH private_stuff AS (SELECT 2 AS id) SELECT * FROM private_stuff) a, private_stuff b"):
            with pytest.raises(ExecutionError, match="table not found"):
                service.query(sql, [])
        assert json.loads(service.query("WITH x AS (SELECT 2 AS id), y AS (SELECT id + 1 AS id FROM x) SELECT * FROM y", [])) == [{"id": 3}]
    finally:
        spark.sql("DROP TABLE private_stuff")
        spark.catalog.dropGlobalTempView("private_view")


def test_files_are_whole_or_absent(catalog, filled):
    """What a writer leaves that died before it was done is no entry of the log."""
    store = filled.store
    store._at(f"{store.root}/_new/torn")[1].create(store._at(f"{store.root}/_new/torn")[0]).close()
    assert filled.load()[0] >= 0
    store.create(f"{store.root}/x/one.json", "a")
    with pytest.raises(Conflict):
        store.create(f"{store.root}/x/one.json", "b")
    assert store.read(f"{store.root}/x/one.json") == "a"
    store.replace(f"{store.root}/x/one.json", "c")
    store.replace(f"{store.root}/x/one.json", "d")
    assert store.read(f"{store.root}/x/one.json") == "d"


def test_pages_and_errors(spark, catalog, service):
    assert [r["id"] for r in json.loads(service.read_table(NS, "public__t", 2, 3))] == [2, 3, 4]
    assert service.read_table(NS, "public__t", 100) == "[]"
    for name in ("public__t$snapshots", "none"):
        with pytest.raises(ExecutionError):
            service.read_table(NS, name)
    with pytest.raises(ExecutionError, match="more than 5"):
        QueryService(spark, catalog, most_rows=5).query(f"SELECT * FROM lake.{NS}.public__t", [NS])
    assert is_metadata("a$snapshots") and not is_metadata("a$b") and not is_metadata("snapshots") and is_metadata("a$b$history")
    assert (ExecutionError.code, CatalogError.code) == (400, 502)


def test_json(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "m", "b")], "zeta int, mid string, alpha string")
    assert to_json(df.orderBy("zeta")) == '[{"zeta":1,"mid":null,"alpha":"a"},{"zeta":2,"mid":"m","alpha":"b"}]'
    assert to_json(df.limit(0)) == "[]"
    assert envelope("[1]") == '{"response_code":1000,"response_message":"OK","rows":[1]}'
    status, answer = failure(CatalogError("away"))
    assert status == 502 and json.loads(answer) == {"response_code": 2004, "response_message": "Upstream Error", "error": "away"}
    assert json.loads(failure(ExecutionError("x"))[1])["response_code"] == 2000


def test_cache():
    now, count = [0.0], []
    cache = Cache(ttl=30, most_bytes=20, entries=2, clock=lambda: now[0])
    ask = lambda sql, scope="a", text="[]": cache.through("query", scope, sql, lambda: count.append(sql) or text)
    ask("1"), ask("1"), ask("1", "b")
    assert count == ["1", "1"]
    now[0] = 31
    ask("1")
    assert count == ["1"] * 3
    ask("big", text="x" * 21), ask("big", text="x" * 21)
    assert count.count("big") == 2
    ask("2"), ask("3")
    assert len(cache.held) == 2
    with pytest.raises(ZeroDivisionError):
        cache.through("query", "a", "bad", lambda: 1 / 0)
    assert not any("bad" in k for k in cache.held)
    off = Cache(ttl=0)
    off.through("q", "", "", lambda: "[]")
    assert not off.held
    none = Cache(entries=0)
    none.put("k", "[]")
    assert none.get("k") is None
    none.held["k"] = (1e18, "{")
    assert none.get("k") is None


def test_records(spark, catalog):
    saved = SavedQueries(catalog.store)
    one = saved.save(checked_query("p", "  Zebra ", "SELECT 1"))
    saved.save(checked_query("p", "apple", "SELECT\n 2"))
    assert [q.name for q in saved.all("p")] == ["apple", "Zebra"] and saved.all("p")[0].sql == "SELECT\n 2"
    with pytest.raises(ValueError):
        saved.save(checked_query("p", "ZEBRA", "SELECT 3"))
    saved.save(checked_query("p", "zebra", "SELECT 4", one.id))
    saved.delete("p", one.id)
    assert [q.name for q in saved.all("p")] == ["apple"]
    for name, sql in (("", "x"), ("x" * 101, "x"), ("x", ""), ("x", "y" * 65537)):
        with pytest.raises(ValueError):
            checked_query("p", name, sql)
    sources = Sources(catalog.store)
    source = Source(SOURCE, "shop", "postgres", "h", 5432, "d", "u")
    sources.put(source.choosing([("public", "orders"), ("public", "orders")]))
    assert sources.all()[0].tables == (("public", "orders"),)
    for bad in (dict(port=0), dict(name=" "), dict(engine="x")):
        with pytest.raises(ValueError):
            tablelog.replace(source, **bad).checked()
    with pytest.raises(ValueError):
        source.choosing([("", "x")])
    assert may("admin", "query", False) and may("developer", "query", True) and not may("developer", "query", False) and not may("user", "query", True) and may("user", "browse", True)
    catalog.store.create(f"{sources.root}/bad.json", "{")
    with pytest.raises(ValueError):
        sources.all()


def test_ownership():
    ids = [str(uuid.UUID(int=n * 7919 + 13)) for n in range(4000)]
    members = {"a", "b", "c", "d"}
    owned = {i: ownership.owner_of(members, i) for i in ids}
    for m in members:
        assert 800 <= sum(o == m for o in owned.values()) <= 1200
    after = {i: ownership.owner_of(members - {"c"}, i) for i in ids}
    assert all(after[i] == owned[i] for i in ids if owned[i] != "c")
    assert ownership.owner_of(set(), ids[0]) is None
    assert sum(ownership.owns(ids[0], n, 5) for n in range(5)) == 1
    with pytest.raises(ValueError):
        ownership.owns(ids[0], 2, 2)
    assert ownership.reconcile({"x", "y"}, {"y", "z"}) == ({"z"}, {"x"})
