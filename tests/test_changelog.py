import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import coercion, dialect, lsn, naming
from tidewell.operators import changelog
from tidewell.operators.current import current_rows, latest, page

SCHEMA = "_op string, _source_id string, _position string, _commit_timestamp_us long, id int, tier string"
CORE = [
    ("update", "0/1CC23E0", 1, "silver"),
    ("insert", "0/1C8A348", 1, "bronze"),
    ("insert", "0/1C8A528", 2, "bronze"),
    ("insert", "0/9FFFFF", 3, "bronze"),
    ("update", "0/1000000", 3, "gold"),
    ("insert", "0/1C8A600", 4, "bronze"),
    ("delete", "0/1D00000", 4, "bronze"),
]


def log_of(spark, rows):
    return spark.createDataFrame([(op, "s", at, 0, i, t) for op, at, i, t in rows], SCHEMA)


@pytest.mark.parametrize("method", ["window", "aggregate"])
def test_current_rows_by_key(spark, method):
    got = [tuple(r) for r in current_rows(log_of(spark, CORE), ["id"], method).collect()]
    assert got == [(1, "silver"), (2, "bronze"), (3, "gold")]


def test_current_rows_without_key(spark):
    df = log_of(spark, [("insert", "0/20", 2, "b"), ("insert", "0/10", 1, "a"), ("delete", "0/30", 1, "a")])
    assert [tuple(r) for r in current_rows(df, []).collect()] == [(1, "a"), (2, "b")]
    assert current_rows(df, None).columns == df.columns and current_rows(df, None).count() == 3


def test_case_exact_names_and_note_column(spark):
    df = spark.createDataFrame([("insert", "s", "0/1", 0, 1, "n")], "_op string, _source_id string, _position string, _commit_timestamp_us long, `Order Id` int, _note string")
    assert current_rows(df, ["Order Id"]).columns == ["Order Id", "_note"]


def test_fill_keeps_what_an_update_left_out(spark):
    df = log_of(spark, [("insert", "0/1", 1, "large"), ("update", "0/2", 1, None)])
    assert [r.tier for r in current_rows(df, ["id"]).collect()] == [None]
    assert [r.tier for r in current_rows(df, ["id"], fill=True).collect()] == ["large"]


def test_one_shuffle_and_rank_before_it(spark):
    plan = latest(log_of(spark, CORE), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


def test_page(spark):
    df = spark.range(1500).orderBy("id")
    assert page(df).count() == 100 and page(df, 0, 10**9).count() == 1000
    assert [r.id for r in page(df, 1499, 5).collect()] == [1499] and page(df, 2000).count() == 0


@given(st.integers(0, lsn.MOST), st.integers(0, lsn.MOST))
def test_positions_order_as_numbers(a, b):
    assert lsn.parse(lsn.show(a)) == a
    assert (f"{a:016X}" < f"{b:016X}") == (a < b)


def test_position_columns(spark):
    values = [0, 1, 0x9FFFFF, 0x1000000, 2**32, 2**63 + 5, lsn.MOST]
    df = spark.createDataFrame([(lsn.show(v),) for v in values], "p string")
    got = df.select(lsn.sort_key(F.col("p")), lsn.number(F.col("p"))).collect()
    assert [(r[0], int(r[1])) for r in got] == [(f"{v:016X}", v) for v in values]
    assert spark.range(1).select(lsn.from_number(F.lit(2**40 + 10))).first()[0] == "100/A"
    for bad in ("", "x", "1/", "0/123456789", "0/1 "):
        with pytest.raises(ValueError):
            lsn.parse(bad)


def test_names(spark):
    assert naming.table_of("Sales", "Order Items") == "sales__order_items" and naming.sanitise("é🚀A") == "__a"
    assert naming.namespace_of("123e4567-e89b-12d3-a456-426614174000") == "cdc_123e4567e89b12d3a456426614174000"
    df = spark.createDataFrame([("Sales", "Ordér Items🚀")], "s string, t string")
    assert df.select(naming.table_name(F.col("s"), F.col("t"))).first()[0] == naming.table_of("Sales", "Ordér Items🚀")


ACCEPTED = [
    ("boolean", [("t", True), ("false", False), ("1", True), ("FALSE", False), (None, None)]),
    ("smallint", [("-7", -7)]),
    ("integer", [("70000", 70000)]),
    ("bigint", [("9000000000", 9000000000)]),
    ("real", [("1.5", 1.5)]),
    ("double precision", [("-2.25", -2.25), ("1e3", 1000.0)]),
    ("date", [("1970-01-02", dt.date(1970, 1, 2)), ("1969-12-31", dt.date(1969, 12, 31))]),
    ("timestamp without time zone", [("1970-01-01 00:00:01.5", dt.datetime(1970, 1, 1, 0, 0, 1, 500000)), ("1970-01-01 00:00:02", dt.datetime(1970, 1, 1, 0, 0, 2))]),
    ("numeric", [("12.345", "12.345")]),
]
REFUSED = [("boolean", "maybe"), ("boolean", "yes"), ("boolean", "y"), ("boolean", " T "), ("smallint", "70000"), ("integer", "x"), ("integer", " 7 "), ("real", "one"), ("date", "2026-13-01"), ("timestamp without time zone", "noon"), ("timestamp with time zone", "1970-01-01 00:00:00")]


def test_text_that_types_accept(spark):
    for source, cases in ACCEPTED:
        kind = coercion.target_type(source)
        df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, t string")
        got = [r[0] for r in df.orderBy("n").select(coercion.strict(F.col("t"), kind)).collect()]
        assert got == [v for _, v in cases], source
    micros = spark.createDataFrame([("1970-01-01 07:00:01.25+07",), ("1970-01-01 00:00:02+00",)], "t string").select(F.unix_micros(coercion.strict(F.col("t"), T.TimestampType()))).collect()
    assert [r[0] for r in micros] == [1250000, 2000000]


@pytest.mark.parametrize("source,text", REFUSED)
def test_text_that_types_refuse(spark, source, text):
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(PySparkException):
        df.select(coercion.strict(F.col("t"), coercion.target_type(source))).collect()
    value, refused = coercion.checked(F.col("t"), coercion.target_type(source))
    assert tuple(df.select(value, refused).first()) == (None, True)


def test_events_to_rows(spark):
    columns = [("id", "integer"), ("status", "text"), ("paid", "boolean")]
    target = changelog.schema(columns)
    events = spark.createDataFrame(
        [
            ("public", "orders", "insert", None, {"id": "1", "status": "new", "extra": "x"}, "0/1", "0/2", 5),
            ("public", "orders", "delete", {"id": "1", "status": None}, None, "0/3", "0/4", 6),
        ],
        changelog.EVENT,
    )
    got = [tuple(r) for r in changelog.rows(events, "src", target).collect()]
    assert got == [("insert", "src", "0/1", 5, 1, "new", None), ("delete", "src", "0/3", 6, 1, None, None)]
    assert [f.nullable for f in target.fields] == [False] * 4 + [True] * 3
    bad = events.withColumn("after", F.create_map(F.lit("id"), F.lit("one")))
    assert changelog.refused(bad, target).select("refused").collect()[0].refused == ["id"]
    chosen = spark.createDataFrame([("public", "customers")], "schema string, table string")
    assert changelog.selected(events, chosen).count() == 0 and changelog.selected(events, None).count() == 2
    assert spark.range(1).select(changelog.unix_micros(F.lit(844825432919964))).first()[0] == 1791510232919964


def test_dialect(spark):
    one = spark.range(1)
    row = one.select(
        dialect.strpos(F.lit("hello"), F.lit("l")),
        dialect.int_div(F.lit(-7), F.lit(2)),
        dialect.regexp_match(F.lit("ab12"), r"([a-z]+)(\d+)", 2),
        dialect.regexp_match(F.lit("--"), r"[a-z]+"),
        F.lower(F.hex(dialect.digest(F.lit("a"), "md5"))),
        dialect.date_bin(900_000_000, F.lit("2026-01-02 03:20:00").cast("timestamp_ntz")),
    ).first()
    assert tuple(row) == (3, -3, ["ab", "12"], None, "0cc175b9c0f1b6a831c399e269772661", dt.datetime(2026, 1, 2, 3, 15))
    assert [r.value for r in dialect.series(one, F.lit(1), F.lit(7), F.lit(3)).collect()] == [1, 4, 7]
    df = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 30), (1, 3, 40)], "k int, o int, v int")
    got = dialect.groups_frame(df, ["k"], F.col("o"), 1, 0, F.sum("v"), "s").orderBy("v").collect()
    assert [r.s for r in got] == [30, 30, 60, 70]
    assert [r.v for r in dialect.distinct_on(df, ["k"], [F.desc("v")]).collect()] == [40]
