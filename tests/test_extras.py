import json


from tidewell.functions import lsn
from tidewell.operators import joins
from tidewell.operators.leases import Leases
from tidewell.sources import catalogs, changefiles
from tidewell.sources.tablelog import Store
from tidewell.streaming import windows

S = [f"123e4567-e89b-12d3-a456-42661417400{n}" for n in range(8)]


def test_leases(spark, tmp_path):
    now = [0.0]
    a, b = (Leases(Store(spark, f"file://{tmp_path}"), m, 5.0, lambda: now[0]) for m in "ab")
    assert a.claim(S[0]) and a.claim(S[0]) and not b.claim(S[0]) and b.holder(S[0]) == "a"
    now[0] = 16
    assert b.holder(S[0]) is None and b.claim(S[0]) and not a.claim(S[0])
    b.release(S[0])
    assert a.claim(S[0])
    a.release(S[0])
    held_a = a.assigned(S, set())
    assert held_a == set(S)
    held_b = b.assigned(S, set())
    held_a = a.assigned(S, held_a)
    held_b = b.assigned(S, held_b)
    assert held_a | held_b == set(S) and not held_a & held_b and held_a and held_b
    b.leave(held_b)
    assert a.assigned(S, held_a) == set(S)


def test_windows_on_a_stream(spark, tmp_path):
    changefiles.register(spark)
    log = tmp_path / "log"
    log.mkdir()
    minute = 60_000_000
    lines = []
    for n, at in enumerate([0, 1, 2, 11, 12, 100]):
        lines += [{"schema": "s", "table": "t", "op": "insert", "after": {"id": "1"}, "position": lsn.show(n + 1), "commit_position": lsn.show(n + 1), "commit_timestamp_us": at * minute}, {"progress": lsn.show(n + 2)}]
    (log / "1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.format("changefiles").load(str(log))
    for name, df in (("tumbling", windows.counted(stream, "10 minutes")), ("sessions", windows.sessions(stream, "5 minutes"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    got = {r.start.minute: r.n for r in spark.table("tumbling").collect()}
    assert got == {0: 3, 10: 2}
    assert sorted(r.n for r in spark.table("sessions").collect()) == [2, 3]


def test_catalog_queries(spark):
    classes = spark.createDataFrame([(1, "public", "a", "d", "r"), (2, "public", "b", "i", "r"), (3, "public", "c", "f", "r"), (4, "pg_catalog", "x", "d", "r"), (5, "public", "v", "d", "v")], "oid int, schema string, name string, replident string, relkind string")
    indexes = spark.createDataFrame([(1, [2, 1], True, False), (2, [1], True, False), (2, [3], False, True), (3, [1], True, False)], "indrelid int, indkey array<int>, indisprimary boolean, indisreplident boolean")
    attributes = spark.createDataFrame([(t, n, f"c{n}", False, "s" if n == 3 and t == 1 else "") for t in (1, 2, 3) for n in (1, 2, 3)], "attrelid int, attnum int, attname string, attisdropped boolean, attgenerated string")
    assert sorted(map(tuple, catalogs.row_keys(classes, indexes, attributes).collect())) == [("public", "a", ["c2", "c1"]), ("public", "b", ["c3"])]
    assert {r.attrelid: r.columns for r in catalogs.stored_columns(attributes).collect()}[1] == ["c1", "c2"]
    assert [tuple(r) for r in catalogs.tables(classes).collect()] == [("public", "a"), ("public", "b"), ("public", "c")]
    found = spark.createDataFrame([("Sales", "Order Items"), ("public", "z")], "schema string, table string")
    targets = spark.createDataFrame([("sales__order_items",)], "table string")
    assert [tuple(r) for r in catalogs.existing_targets(found, targets).collect()] == [("Sales", "Order Items")]


def test_pages(spark):
    rows = spark.createDataFrame([(a, b, "q") for a in (2, 10, 9) for b in (1, 2)], "a int, b int, c string")
    first = catalogs.read_page(rows, ["a", "b"], 3)
    assert [tuple(r) for r in first.collect()] == [("2", "1", "q"), ("2", "2", "q"), ("9", "1", "q")]
    assert [tuple(r) for r in catalogs.read_page(rows, ["a", "b"], 3, [9, 1]).collect()] == [("9", "2", "q"), ("10", "1", "q"), ("10", "2", "q")]
    for keys, values in (([], None), (["x"], None), (["a"], [1, 2])):
        try:
            catalogs.read_page(rows, keys, 3, values)
            raise AssertionError
        except ValueError:
            pass
    assert catalogs.page_sql("Sales", "Order Items", ["order_id", "sku"], [("order_id", "bigint"), ("line", "integer")], 10, False) == 'SELECT "order_id"::text, "sku"::text FROM "Sales"."Order Items" WHERE ("order_id", "line") > ($1::bigint, $2::integer) ORDER BY "order_id", "line" LIMIT 10'


def test_joins(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("z", 9, "w")], "k string, t int, name string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("z", 10, 1)], "k string, t int, v int")
    got = sorted(map(tuple, joins.asof(left, right, ["k"], "t", ["v"]).collect()))
    assert got == [("k", 1, "y", None), ("k", 5, "x", 50), ("z", 9, "w", None)]
    points = spark.range(40).withColumnRenamed("id", "p")
    spans = spark.createDataFrame([(0, 3), (2, 25), (7, 7), (39, 100)], "s long, e long")
    got = sorted((r.p, r.s) for r in joins.interval(points, spans, "p", "s", "e", 5).collect())
    assert got == sorted((p, s) for p in range(40) for s, e in ((0, 3), (2, 25), (7, 7), (39, 100)) if s <= p < e)
