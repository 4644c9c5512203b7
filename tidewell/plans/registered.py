"""The registered queries of the engine and their SQL: one for each operator that a user can reach.

A query is (Spark function, DuckDB SQL). Those named by ``sql()`` run the same text in both, Spark's
through ``spark.sql`` over views of the tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import coercion, dialect, lsn, naming, sketches
from tidewell.operators import changelog, joins
from tidewell.operators.current import current_rows, latest, page
from tidewell.operators.maintenance import Policy, compact, orphans, plan
from tidewell.sources import catalogs
from tidewell.sources.scratch import folder, stored
from tidewell.sources.tablelog import Catalog, File, Table

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events".split()

queries: dict[str, Query] = {}
oracle_sql: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        queries[name] = query
        if sql is not None:
            oracle_sql[name] = sql
        return query

    return keep


def sql(name: str, text: str, other: str | None = None) -> None:
    """The same query in both engines; ``other``: DuckDB's text where its dialect differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                read(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    queries[name] = run
    oracle_sql[name] = other or text


# changelogs derived from the tables

EVENTS_LOG = """(SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS _op,
  printf('%X', event_id // 16384) || '/' || printf('%X', (event_id % 16384) * 262144) AS _position, event_id, user_id, event_type, value FROM events)"""
_LAST = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY event_id DESC) AS r FROM " + EVENTS_LOG


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a changelog of users; text order of its positions is not their order."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    at = F.concat_ws("/", F.hex(F.expr("event_id div 16384")), F.hex(F.expr("(event_id % 16384) * 262144")))
    return e.select(op.alias("_op"), F.lit("events").alias("_source_id"), at.alias("_position"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_commit_timestamp_us"), "event_id", "user_id", "event_type", "value")


_BY_USER = f"SELECT event_id, user_id, event_type, value FROM ({_LAST.format(keys='user_id')}) WHERE r = 1 AND _op <> 'delete'"


@register("current_rows_events", _BY_USER)
def _(spark, sf_dir):
    return current_rows(events_log(spark, sf_dir), ["user_id"], ordered=False)


@register("current_rows_aggregate", _BY_USER)
def _(spark, sf_dir):
    return current_rows(events_log(spark, sf_dir), ["user_id"], "aggregate", ordered=False)


@register("current_rows_composite_key", f"SELECT event_id, user_id, event_type, value FROM ({_LAST.format(keys='user_id, event_type')}) WHERE r = 1 AND _op <> 'delete'")
def _(spark, sf_dir):
    return current_rows(events_log(spark, sf_dir), ["user_id", "event_type"], ordered=False)


@register("latest_change_per_key", f"SELECT _op, _position, event_id, user_id FROM ({_LAST.format(keys='user_id')}) WHERE r = 1")
def _(spark, sf_dir):
    return latest(events_log(spark, sf_dir), ["user_id"]).select("_op", "_position", "event_id", "user_id")


@register("current_rows_keyless", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'R'")
def _(spark, sf_dir):
    op = F.when(F.col("l_returnflag") == "R", "delete").otherwise("insert")
    log = read(spark, sf_dir, "lineitem").select(op.alias("_op"), F.lit("s").alias("_source_id"), lsn.from_number(F.col("l_orderkey")).alias("_position"), F.lit(0).cast("long").alias("_commit_timestamp_us"), "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return current_rows(log, [], ordered=False)


@register("current_rows_page", f"SELECT * FROM ({_BY_USER}) ORDER BY user_id NULLS FIRST LIMIT 25 OFFSET 10")
def _(spark, sf_dir):
    return page(current_rows(events_log(spark, sf_dir), ["user_id"]), 10, 25)


@register("read_rows_as_stored_count", "SELECT count(*) AS n, CAST(7 AS BIGINT) AS columns FROM events")
def _(spark, sf_dir):
    rows = current_rows(events_log(spark, sf_dir), None).drop("value")
    return rows.agg(F.count("*").alias("n")).withColumn("columns", F.lit(len(rows.columns)).cast("long"))


@register("forward_filled_updates", f"""SELECT event_id, user_id, CASE WHEN _op = 'update' THEN coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id)) ELSE v END AS value
FROM (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM {EVENTS_LOG})""")
def _(spark, sf_dir):
    from tidewell.operators.current import filled

    log = events_log(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return filled(log, ["user_id"]).select("event_id", "user_id", "value")


@register("lsn_sort", f"SELECT _position, event_id, row_number() OVER (ORDER BY event_id) AS place FROM {EVENTS_LOG}")
def _(spark, sf_dir):
    log = events_log(spark, sf_dir).select("_position", "event_id", lsn.sort_key(F.col("_position")).alias("at"))
    # places within runs of neighbouring positions, and how many rows the runs before have; only runs are counted in one task
    log = log.withColumn("run", F.substring("at", 1, 9))
    within = log.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("at")))
    before = F.sum("rows").over(Window.orderBy("run")) - F.col("rows")
    runs = log.groupBy("run").agg(F.count("*").alias("rows")).select("run", before.alias("before"))
    return within.join(runs, "run").orderBy("at").select("_position", "event_id", (F.col("n") + F.col("before")).alias("place"))


@register("lsn_numeric_max", "SELECT CAST(max((event_id // 16384) * 4294967296 + (event_id % 16384) * 262144) AS DOUBLE) AS top, CAST(min((event_id // 16384) * 4294967296 + (event_id % 16384) * 262144) AS DOUBLE) AS low FROM events")
def _(spark, sf_dir):
    n = lsn.number(F.col("_position"))
    return events_log(spark, sf_dir).agg(F.max(n).cast("double").alias("top"), F.min(n).cast("double").alias("low"))


@register("changelog_op_counts", f"SELECT _op, event_type, count(*) AS n FROM {EVENTS_LOG} GROUP BY _op, event_type")
def _(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("_op", "event_type").agg(F.count("*").alias("n"))


def _text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as change events with text images."""
    o = read(spark, sf_dir, "orders")
    image = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("open"), F.when(F.col("o_orderstatus") == "O", "t").otherwise("f"), F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    gone = F.col("o_orderstatus") == "F"
    at = lsn.from_number(F.col("o_orderkey"))
    return o.select(F.lit("public").alias("schema"), F.lit("orders").alias("table"), F.when(gone, "delete").otherwise("insert").alias("op"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"), at.alias("position"), at.alias("commit_position"), F.lit(0).cast("long").alias("commit_timestamp_us"))


_ORDERS = [("id", "bigint"), ("total", "double precision"), ("open", "boolean"), ("day", "date"), ("absent", "integer")]


@register("changelog_typed_coercion", "SELECT CASE o_orderstatus WHEN 'F' THEN 'delete' ELSE 'insert' END AS _op, o_orderkey AS id, o_totalprice AS total, o_orderstatus = 'O' AS open, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS INTEGER) AS absent FROM orders")
def _(spark, sf_dir):
    return changelog.rows(_text_events(spark, sf_dir), "s", changelog.schema(_ORDERS)).drop(*changelog.FIXED[1:])


@register("coercion_refused", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM orders WHERE o_orderkey % 3 = 0")
def _(spark, sf_dir):
    bad = _text_events(spark, sf_dir).withColumn("after", F.transform_values("after", lambda k, v: F.when((k == "id") & (v.cast("long") % 3 == 0), F.concat(v, F.lit("x"))).otherwise(v)))
    bad = bad.withColumn("before", F.transform_values("before", lambda k, v: F.when((k == "id") & (v.cast("long") % 3 == 0), F.concat(v, F.lit("x"))).otherwise(v)))
    out = changelog.refused(bad, changelog.schema(_ORDERS))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("refused") != F.array(F.lit("id"))).alias("wrong"))


@register("snapshot_rows_below_changes", f"""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC) AS r FROM (
SELECT user_id, event_id, _op, event_id + 1 AS p FROM {EVENTS_LOG} UNION ALL SELECT c_custkey, -1, 'read', 0 FROM customer)) WHERE r = 1 AND _op <> 'delete'""")
def _(spark, sf_dir):
    log = events_log(spark, sf_dir).where("event_id > 0 or _position <> '0/0'").select(*changelog.FIXED, "user_id", "event_id")
    first = events_log(spark, sf_dir).where("_position = '0/0'").withColumn("_position", F.lit("0/1")).select(log.columns)
    backfilled = read(spark, sf_dir, "customer").select(F.lit("read").alias("_op"), F.lit("events").alias("_source_id"), F.lit("0/0").alias("_position"), F.lit(0).cast("long").alias("_commit_timestamp_us"), F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"))
    return current_rows(log.unionByName(first).unionByName(backfilled), ["user_id"], ordered=False)


@register("redelivery_dedup", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id > 4321")
def _(spark, sf_dir):
    from tidewell.streaming.apply import uncovered

    mark = lsn.show((4321 // 16384) << 32 | (4321 % 16384) * 262144)
    again = events_log(spark, sf_dir).withColumn("commit_position", F.col("_position"))
    return uncovered(again, mark, False).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@register("keyset_page", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey > 9 OR (l_orderkey = 9 AND l_linenumber > 1) ORDER BY CAST(l_orderkey AS BIGINT), CAST(l_linenumber AS INTEGER) LIMIT 200")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return catalogs.read_page(rows, ["l_orderkey", "l_linenumber"], 200, [9, 1])


@register("selection_semi_filter", "SELECT count(*) AS n FROM orders")
def _(spark, sf_dir):
    events = _text_events(spark, sf_dir)
    both = events.unionByName(events.withColumn("table", F.lit("other")))
    return changelog.selected(both, spark.createDataFrame([("public", "orders")], "schema string, table string")).agg(F.count("*").alias("n"))


@register("target_name_sanitise", "SELECT p_partkey, lower(regexp_replace(p_brand || '.' || p_name, '[^A-Za-z0-9]', '_', 'g')) AS name FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", naming.sanitised(F.concat_ws(".", "p_brand", "p_name")).alias("name"))


@register("row_key_posexplode", "SELECT 'public' AS schema, n_name AS \"table\", 'k' || n_regionkey || ',k' || n_nationkey AS keys FROM nation")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    classes = n.select(F.col("n_nationkey").alias("oid"), F.lit("public").alias("schema"), F.col("n_name").alias("name"), F.lit("d").alias("replident"))
    indexes = n.select(F.col("n_nationkey").alias("indrelid"), F.array(F.col("n_regionkey") + 100, F.col("n_nationkey")).alias("indkey"), F.lit(True).alias("indisprimary"), F.lit(False).alias("indisreplident"))
    attributes = n.select(F.col("n_nationkey").alias("attrelid"), F.explode(F.array(F.struct((F.col("n_regionkey") + 100).alias("attnum"), F.concat(F.lit("k"), F.col("n_regionkey")).alias("attname")), F.struct(F.col("n_nationkey").alias("attnum"), F.concat(F.lit("k"), F.col("n_nationkey")).alias("attname")))).alias("a")).select("attrelid", "a.*")
    return catalogs.row_keys(classes, indexes, attributes).withColumn("keys", F.concat_ws(",", "keys"))


@register("first_fk_lateral", "SELECT r_name AS \"table\", (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS to_table, true AS in_key FROM region")
def _(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    columns = r.select(F.lit("s").alias("schema"), F.col("r_name").alias("table"), F.lit("c").alias("column"), F.lit(1).alias("ordinal"), F.lit("text").alias("type"), F.lit(True).alias("nullable"))
    foreign = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("s").alias("schema"), F.col("r_name").alias("table"), F.lit("c").alias("column"), F.col("n_name").alias("constraint"), F.lit("s").alias("to_schema"), F.col("n_name").alias("to_table"), F.lit("c").alias("to_column"))
    return catalogs.explorer(columns, columns.select("schema", "table", "column"), foreign).select("table", "to_table", "in_key")


@register("ingested_flags", "SELECT 's' AS schema, n_name AS \"table\", n_regionkey = 1 AS ingested FROM nation")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.lit("s").alias("schema"), F.col("n_name").alias("table"), "n_regionkey")
    return catalogs.flagged(n.select("schema", "table"), n.where("n_regionkey = 1"))


@register("missing_tables", "SELECT 's' AS schema, n_name AS \"table\" FROM nation WHERE n_regionkey <> 1")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.lit("s").alias("schema"), F.col("n_name").alias("table"), "n_regionkey")
    return catalogs.missing(n.select("schema", "table"), n.where("n_regionkey = 1"))


@register("compaction_bins")
def _(spark, sf_dir):
    files = [File(f"f{r.n_nationkey:02}", 10 + 7 * r.n_regionkey, 1, r.n_nationkey) for r in read(spark, sf_dir, "nation").collect()]
    bins = plan(files, Policy(target=100, small=75, least_files=3, most_bytes=1000))
    return spark.createDataFrame([(n, f.path) for n, b in enumerate(bins) for f in b], "bin int, path string")


@register("current_states_joined", f"""SELECT u.user_id, u.event_id, c.c_mktsegment, count(o_orderkey) AS orders FROM ({_BY_USER}) u JOIN customer c ON c.c_custkey = u.user_id
LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY u.user_id, u.event_id, c.c_mktsegment""")
def _(spark, sf_dir):
    users = current_rows(events_log(spark, sf_dir), ["user_id"], ordered=False)
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    met = users.join(c, c.c_custkey == users.user_id).join(o, o.o_custkey == c.c_custkey, "left")
    return met.groupBy("user_id", "event_id", "c_mktsegment").agg(F.count("o_orderkey").alias("orders"))


@register("asof_join", "SELECT e.event_id, e.user_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS purchase FROM events e WHERE e.event_type = 'click'")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return joins.asof(left, right, ["user_id"], "ts", ["purchase"]).select("event_id", "user_id", "purchase")


@register("interval_join", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey AND p_size < n_nationkey + 3")
def _(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("s"), (F.col("n_nationkey") + 3).alias("e"))
    return joins.interval(read(spark, sf_dir, "part"), n, "p_size", "s", "e", 3).select("p_partkey", "n_nationkey")


@register("join_inequality", "SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders ON l_extendedprice - 96000 > o_totalprice AND l_shipdate < o_orderdate")
def _(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 96000).alias("over"), "l_shipdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return joins.inequality(li, o, [("over", ">", "o_totalprice"), ("l_shipdate", "<", "o_orderdate")]).select("l_orderkey", "l_linenumber", "o_orderkey")


_HOT = "CASE WHEN user_id % 2 = 0 THEN -1 ELSE user_id END"


@register("asof_hot_key", f"""WITH e AS (SELECT event_id, {_HOT} AS k, ts, event_type FROM events),
r AS (SELECT k, ts, max(event_id) AS purchase FROM e WHERE event_type = 'purchase' GROUP BY k, ts)
SELECT l.event_id, l.k, r.purchase FROM (SELECT * FROM e WHERE event_type <> 'purchase') l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr(_HOT).alias("k"), "ts", "event_type")  # half of all rows have one key
    left, right = e.where("event_type <> 'purchase'").select("event_id", "k", "ts"), e.where("event_type = 'purchase'").select("k", "ts", F.col("event_id").alias("purchase"))
    return joins.asof(left, right, ["k"], "ts", ["purchase"]).select("event_id", "k", "purchase")


@register("interval_join_levels", """SELECT a.event_id AS span, count(*) AS n, max(b.event_id) AS last FROM (SELECT event_id, ts AS s, ts + to_microseconds(CAST(CASE WHEN event_id % 200 = 1 THEN 63072000 ELSE power(6, event_id % 8) END * 1000000 AS BIGINT)) AS e FROM events WHERE event_type = 'error') a
JOIN events b ON b.ts >= a.s AND b.ts < a.e GROUP BY a.event_id""")
def _(spark, sf_dir):
    # from a second to two years
    seconds = F.when(F.col("event_id") % 200 == 1, 63072000).otherwise(F.pow(F.lit(6), F.col("event_id") % 8))
    e = read(spark, sf_dir, "events")
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("span"), F.col("ts").alias("s"), F.timestamp_add("MICROSECOND", (seconds * 1000000).cast("long"), F.col("ts")).alias("e"))
    return joins.interval_totals(e.select("event_id", "ts"), spans, "ts", "s", "e", ["span"], {"n": ("count", "*"), "last": ("max", "event_id")})


@register("groups_frame", "SELECT c_custkey, CAST(sum(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM customer")
def _(spark, sf_dir):
    return dialect.groups_frame(read(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_nationkey"), 1, 1, F.sum("c_nationkey"), "s").select("c_custkey", "s")


@register("distinct_on", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def _(spark, sf_dir):
    return dialect.distinct_on(read(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey")


@register("date_bin", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bin, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(dialect.date_bin(15 * dialect.WIDTHS["minute"], F.col("ts")).alias("bin")).agg(F.count("*").alias("n"))


@register("dialect_functions", r"SELECT p_partkey, CAST(strpos(p_name, 'a') AS INTEGER) AS place, CAST(p_size // 7 AS BIGINT) AS sevenths, upper(md5(p_brand)) AS digest, nullif(regexp_extract(p_brand, '\d+'), '') AS match FROM part")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", dialect.strpos(F.col("p_name"), F.lit("a")).alias("place"), dialect.int_div(F.col("p_size"), F.lit(7)).alias("sevenths"), F.hex(dialect.digest(F.col("p_brand"), "md5")).alias("digest"), dialect.regexp_match(F.col("p_brand"), r"\d+")[0].alias("match"))


@register("generate_series", "SELECT r_regionkey, CAST(unnest(generate_series(0, r_regionkey)) AS INTEGER) AS value FROM region")
def _(spark, sf_dir):
    return dialect.series(read(spark, sf_dir, "region"), F.lit(0), F.col("r_regionkey")).select("r_regionkey", "value")


@register("json_rows", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","none":null}' AS json FROM region""")
def _(spark, sf_dir):
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none"))
    return r.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


# delegated SQL: joins

sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
sql("join_using", "SELECT k, n, m FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) a LEFT JOIN (SELECT r_regionkey AS k, r_name AS m FROM region WHERE r_regionkey > 1) b USING (k)")
sql("join_natural", "SELECT k, n, m FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS m FROM region) b")
sql("join_using_lateral", "SELECT r_name, m FROM region, LATERAL (SELECT max(n_nationkey) AS m FROM nation WHERE n_regionkey = r_regionkey) t")
sql("not_in_null_aware", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey ELSE 0 END FROM region)")
sql("star_join", "SELECT n_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, l_returnflag")

# aggregation

sql("group_sum_cast", "SELECT o_orderstatus, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(12, 2))), 2) AS total FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, CAST(round(sum(CAST(o_totalprice AS DECIMAL(12, 2))), 2) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus")
sql("statistics", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS p, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag")
sql("regressions", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
sql("bool_and_bits", "SELECT n_regionkey, bool_and(n_nationkey > 3) AS every_, bool_or(n_nationkey > 20) AS some_, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
sql("medians", "SELECT l_returnflag, round(median(l_quantity), 6) AS m, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p FROM lineitem GROUP BY l_returnflag")
sql("string_and_array_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(sort_array(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey")
sql("distinct_and_filter", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS d, count(*) FILTER (WHERE o_totalprice > 50000) AS f FROM orders GROUP BY o_orderpriority")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("rollup_cube", "SELECT 'r' AS k, n_regionkey AS a, n_nationkey AS b, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey) UNION ALL SELECT 'c', n_regionkey, n_nationkey % 3, count(*) FROM nation GROUP BY CUBE (n_regionkey, n_nationkey % 3)")
sql("having_distinct", "SELECT DISTINCT n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 2) t")

# windows

sql("window_ranking", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
sql("window_ntile_row_number", "SELECT c_custkey, ntile(4) OVER w AS q, row_number() OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
sql("window_analytic", "SELECT event_id, lag(event_id) OVER w AS a, lead(event_id, 2) OVER w AS b, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
sql("window_last_value", "SELECT event_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events")
sql("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS s, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM events")
sql("window_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM events")
sql("qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")

# sets, order, subqueries

for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    # of nations no customer's lacks a supplier, so the difference is taken between keys
    _left, _right = ("c_custkey", "s_suppkey") if _name == "except" else ("c_nationkey", "s_nationkey")
    sql(f"set_{_name}", f"SELECT {_left} AS k FROM customer {_op} SELECT {_right} FROM supplier")
sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 20 OFFSET 5")
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
sql("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
sql("subqueries", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql("predicates", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' WHEN p_size IN (1, 2, 3) THEN 'low' ELSE 'rest' END AS band FROM part WHERE p_name LIKE '%a%' AND p_type IS NOT NULL AND NOT (p_retailprice < 920)")
sql("no_table", "SELECT 1 + 1 AS two, 'x' AS s")

# scalar functions

sql("strings", "SELECT n_nationkey, upper(n_name) AS u, initcap(lower(n_name)) AS i, substr(n_name, 2, 3) AS s, replace(n_name, 'A', '*') AS r, reverse(n_name) AS v, lpad(n_name, 12, '.') AS l, concat_ws('-', n_name, 'x') AS c, translate(n_name, 'AE', '43') AS t, left(n_name, 2) AS a, levenshtein(n_name, 'CHINA') AS d, starts_with(n_name, 'A') AS w, split_part(n_name, 'A', 1) AS p FROM nation".replace("starts_with", "startswith"), "SELECT n_nationkey, upper(n_name) AS u, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS i, substr(n_name, 2, 3) AS s, replace(n_name, 'A', '*') AS r, reverse(n_name) AS v, lpad(n_name, 12, '.') AS l, concat_ws('-', n_name, 'x') AS c, translate(n_name, 'AE', '43') AS t, left(n_name, 2) AS a, CAST(levenshtein(n_name, 'CHINA') AS INTEGER) AS d, starts_with(n_name, 'A') AS w, split_part(n_name, 'A', 1) AS p FROM nation")
sql("more_strings", "SELECT n_nationkey, trim(concat('  ', n_name, ' ')) AS t, btrim(n_name, 'A') AS b, repeat(n_name, 2) AS r, right(n_name, 3) AS e, rpad(n_name, 12, '*') AS p, chr(n_nationkey + 65) AS c, ascii(n_name) AS a, octet_length(n_name) AS o FROM nation", "SELECT n_nationkey, trim(concat('  ', n_name, ' ')) AS t, trim(n_name, 'A') AS b, repeat(n_name, 2) AS r, right(n_name, 3) AS e, rpad(n_name, 12, '*') AS p, chr(CAST(n_nationkey + 65 AS INTEGER)) AS c, ascii(n_name) AS a, strlen(n_name) AS o FROM nation")
sql("regexes", "SELECT p_partkey, regexp_like(p_type, '^[A-Z]+') AS l, regexp_replace(p_name, '[aeiou]', '_') AS r, regexp_count(p_name, 'a') AS c, regexp_extract(p_brand, '([0-9])', 1) AS e FROM part", "SELECT p_partkey, regexp_matches(p_type, '^[A-Z]+') AS l, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, CAST(len(regexp_extract_all(p_name, 'a')) AS INTEGER) AS c, regexp_extract(p_brand, '([0-9])', 1) AS e FROM part")
sql("dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, year(o_orderdate) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(extract(DAY FROM o_orderdate) AS INTEGER) AS d, CAST(o_orderdate AS DATE) + INTERVAL '10' DAY AS plus, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS gap FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(extract(DAY FROM o_orderdate) AS INTEGER) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL '10' DAY AS DATE) AS plus, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS gap FROM orders")
sql("maths", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(power(p_size, 1.5), 4) AS p, CAST(sign(p_size - 25) AS DOUBLE) AS g, round(sin(p_size), 6) AS t, p_size % 7 AS m, greatest(p_size, 10) AS h, least(p_size, 10) AS w, ceil(p_retailprice) AS c, floor(p_retailprice) AS f FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(power(p_size, 1.5), 4) AS p, CAST(sign(p_size - 25) AS DOUBLE) AS g, round(sin(p_size), 6) AS t, p_size % 7 AS m, greatest(p_size, 10) AS h, least(p_size, 10) AS w, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f FROM part")
sql("more_maths", "SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(log(10, p_size + 1), 6) AS l, isnan(CAST(p_size AS DOUBLE)) AS n, round(pi(), 9) AS pi, nanvl(CAST(p_size AS DOUBLE), 0) AS v FROM part", "SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(log10(p_size + 1), 6) AS l, isnan(CAST(p_size AS DOUBLE)) AS n, round(pi(), 9) AS pi, CAST(p_size AS DOUBLE) AS v FROM part")
sql("conditionals", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS c, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'more' END AS k, try_cast(n_name AS INT) AS t FROM nation")
sql("arrays", "SELECT n_nationkey, array_contains(array(n_nationkey, n_regionkey), 2) AS c, size(array_distinct(array(n_nationkey, n_regionkey))) AS d, array_join(slice(array('a', 'b', 'c'), 2, 2), '') AS s, aggregate(array(1, 2, n_regionkey), 0, (a, x) -> a + x) AS t FROM nation", "SELECT n_nationkey, list_contains([n_nationkey, n_regionkey], 2) AS c, CAST(len(list_distinct([n_nationkey, n_regionkey])) AS INTEGER) AS d, array_to_string((['a', 'b', 'c'])[2:3], '') AS s, CAST(list_sum([1, 2, n_regionkey]) AS INTEGER) AS t FROM nation")
sql("unnest", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(array(n_regionkey, n_nationkey * 2)) t AS x", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey * 2]) AS x FROM nation")
sql("structs_and_maps", "SELECT n_nationkey, named_struct('a', n_name, 'b', 1).a AS f, map('k', n_regionkey, 'z', 9)['k'] AS m, array_join(map_keys(map('k', 1, 'z', 2)), '') AS ks FROM nation", "SELECT n_nationkey, struct_pack(a := n_name, b := 1).a AS f, map_extract(MAP {'k': n_regionkey, 'z': 9}, 'k')[1] AS m, array_to_string(map_keys(MAP {'k': 1, 'z': 2}), '') AS ks FROM nation")
sql("hashes", "SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, hex(n_name) AS h FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, hex(n_name) AS h FROM nation")
sql("json_text", """SELECT event_id, get_json_object(concat('{"a":{"b":', event_id, '}}'), '$.a.b') AS b FROM events""", """SELECT event_id, json_extract_string('{"a":{"b":' || event_id || '}}', '$.a.b') AS b FROM events""")
sql("casts", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderkey AS STRING) AS s, CAST('2026-01-02' AS DATE) AS day, o_orderkey::INT AS i FROM orders", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderkey AS VARCHAR) AS s, CAST('2026-01-02' AS DATE) AS day, o_orderkey::INT AS i FROM orders")
sql("table_functions", "SELECT id FROM range(0, 20, 3)", "SELECT range AS id FROM range(0, 20, 3)")


@register("approximate_aggregates")
def _(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"), F.count("*").alias("n"))


@register("tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))


# sketches: what they estimate against what is exact, which DuckDB counts in full

_SHARES = [0.1, 0.5, 0.99]
_WEIGHTED = """SELECT {keys}, s.share, (SELECT min(x) FROM (SELECT {inner}, {value} AS x, sum({weight}) OVER (PARTITION BY {inner_keys} ORDER BY {value}) AS c, sum({weight}) OVER (PARTITION BY {inner_keys}) AS t FROM lineitem) w
WHERE {same} AND c >= s.share * t) AS exact, true AS within FROM (SELECT DISTINCT {keys} FROM lineitem) g, (SELECT CAST(unnest([0.1, 0.5, 0.99]) AS DOUBLE) AS share) s"""


@register("approx_percentile_weighted", _WEIGHTED.format(keys="l_returnflag, l_linestatus", inner="l_returnflag AS f, l_linestatus AS l", inner_keys="l_returnflag, l_linestatus", value="l_extendedprice", weight="l_quantity", same="f = l_returnflag AND l = l_linestatus"))
def _(spark, sf_dir):
    li, by = read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    sketch = stored(sketches.quantile_sketch(li, by, "l_extendedprice", "l_quantity"), "quantiles")
    exact = sketches.refined(li, sketch, by, "l_extendedprice", "l_quantity", _SHARES)
    return sketches.quantiles(sketch, by, _SHARES).join(exact, [*by, "share"]).select(*by, "share", "exact", sketches.within(F.col("estimate"), F.col("exact")).alias("within"))


@register("quantile_sketch_rollup", _WEIGHTED.format(keys="l_returnflag", inner="l_returnflag AS f", inner_keys="l_returnflag", value="l_extendedprice", weight="1", same="f = l_returnflag") + " UNION ALL SELECT 'all', share, (SELECT min(x) FROM (SELECT l_extendedprice AS x, count(*) OVER (ORDER BY l_extendedprice) AS c, count(*) OVER () AS t FROM lineitem) w WHERE c >= s.share * t), true FROM (SELECT CAST(unnest([0.1, 0.5, 0.99]) AS DOUBLE) AS share) s")
def _(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    fine = stored(sketches.quantile_sketch(li.withColumn("month", F.date_trunc("month", "l_shipdate")), ["l_returnflag", "month"], "l_extendedprice"), "quantiles")
    out = []
    for by in (["l_returnflag"], []):
        sketch = sketches.merged(fine, by)
        both = sketches.quantiles(sketch, by, _SHARES).join(sketches.refined(li, sketch, by, "l_extendedprice", None, _SHARES), [*by, "share"])
        out.append(both.select(F.col("l_returnflag") if by else F.lit("all").alias("l_returnflag"), "share", "exact", sketches.within(F.col("estimate"), F.col("exact")).alias("within")))
    return out[0].unionByName(out[1])


@register("distinct_sketch_rollup", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    fine = stored(sketches.distinct_sketch(li.withColumn("month", F.date_trunc("month", "l_shipdate")), ["l_returnflag", "month"], "l_partkey"), "distinct")
    exact = li.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= sketches.distinct_bound() * F.col("exact")
    return sketches.distinct_counts(fine, ["l_returnflag"]).join(exact, "l_returnflag").select("l_returnflag", "exact", near.alias("within"))


@register("set_sketch_overlap", """WITH c AS (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey)
SELECT count(*) FILTER (WHERE o AND f) AS both_, count(*) FILTER (WHERE o AND NOT f) AS first_, true AS within FROM c""")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    fine = stored(sketches.set_sketch(o, ["o_orderstatus"], "o_custkey"), "sets")
    one, two = (F.max(F.when(F.col("o_orderstatus") == s, F.col("sketch"))).alias(s) for s in "OF")
    found = fine.agg(one, two).select(*[c.alias(f"__{n}") for n, c in sketches.overlaps(F.col("O"), F.col("F")).items()])
    each = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("o"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    exact = each.agg(F.count_if(F.col("o") & F.col("f")).alias("both_"), F.count_if(F.col("o") & ~F.col("f")).alias("first_"), F.count_if(F.col("o") | F.col("f")).alias("either"))
    off = sketches.overlap_bound() * F.col("either")
    near = (F.abs(F.col("__both") - F.col("both_")) <= off) & (F.abs(F.col("__first") - F.col("first_")) <= off) & (F.abs(F.col("__either") - F.col("either")) <= off)
    return exact.join(F.broadcast(found), F.lit(True)).select("both_", "first_", near.alias("within"))


@register("rank_sketch_rollup", "SELECT event_type, CAST(unnest([0.1, 0.5, 0.99]) AS DOUBLE) AS share, count(*) AS n, true AS within FROM events GROUP BY event_type")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    fine = stored(sketches.rank_sketch(e.withColumn("day", F.date_trunc("day", "ts")), ["event_type", "day"], "value"), "ranks")
    found = sketches.rank_quantiles(fine, ["event_type"], _SHARES)
    # the ranks that the estimate has: of the values below it, and of those up to it
    ranks = e.join(F.broadcast(found), "event_type").groupBy("event_type", "share", "n").agg(F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))
    off = sketches.rank_bound() * F.col("n")
    return ranks.select("event_type", "share", "n", ((F.col("below") - off <= F.col("share") * F.col("n")) & (F.col("share") * F.col("n") <= F.col("upto") + off)).alias("within"))


# tables of the lake: made of the events in eight commits, each of a range of positions


def _lake(spark: SparkSession, sf_dir: str) -> Table:
    log = events_log(spark, sf_dir)
    most = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    table = Catalog(spark, folder(spark, "lake")).create("ns", "public__events", log.schema, ["event_id"])
    for n in range(8):
        low, high = (k * (most + 1) // 8 for k in (n, n + 1))
        table.append(log.where((F.col("event_id") >= low) & (F.col("event_id") < high)).repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), None, "events")
    return table


def _at(event_id: int) -> str:
    return lsn.show((event_id // 16384) << 32 | (event_id % 16384) * 262144)


@register("lake_scan_pruned", f"SELECT _op, _position, event_id, user_id, event_type, value FROM {EVENTS_LOG} WHERE event_id >= 2000 AND event_id < 4500")
def _(spark, sf_dir):
    return _lake(spark, sf_dir).scan(where=[("_position", ">=", _at(2000)), ("_position", "<", _at(4500))]).drop("_source_id", "_commit_timestamp_us")


@register("lake_time_travel", """SELECT n, CAST((SELECT count(*) FROM events WHERE event_id < (n * (SELECT max(event_id) + 1 FROM events)) // 8) AS BIGINT) AS total, (SELECT max(event_id) FROM events WHERE event_id < (n * (SELECT max(event_id) + 1 FROM events)) // 8) AS last
FROM (SELECT CAST(unnest([1, 3, 8]) AS INTEGER) AS n) t""")
def _(spark, sf_dir):
    table = _lake(spark, sf_dir)
    snapshots = table.load()[1].snapshots
    parts = [table.scan(snapshots[n - 1].id).agg(F.count("*").alias("total"), F.max("event_id").alias("last")).select(F.lit(n).alias("n"), "total", "last") for n in (1, 3, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_COMMITS = "SELECT n, (SELECT count(*) FROM events WHERE event_id >= (n - 1) * m // 8 AND event_id < n * m // 8) AS added, (SELECT count(*) FROM events WHERE event_id < n * m // 8) AS total FROM (SELECT unnest(range(1, 9)) AS n, (SELECT max(event_id) + 1 FROM events) AS m) t"


@register("lake_snapshots", f"SELECT CAST(n AS BIGINT) AS sequence_number, 'append' AS operation, added, total, 'events' AS source FROM ({_COMMITS})")
def _(spark, sf_dir):
    s = F.col("summary")
    return _lake(spark, sf_dir).metadata("snapshots").select("sequence_number", "operation", s["added-records"].cast("long").alias("added"), s["total-records"].cast("long").alias("total"), s["cdc.source-id"].alias("source"))


@register("lake_manifests", f"SELECT CAST(a.n AS BIGINT) AS snapshot, CAST(b.n AS BIGINT) AS sequence_number, b.added AS records FROM ({_COMMITS}) a JOIN ({_COMMITS}) b ON b.n <= a.n")
def _(spark, sf_dir):
    table = _lake(spark, sf_dir)
    order = table.metadata("snapshots").select("snapshot_id", F.col("sequence_number").alias("snapshot"))
    return table.metadata("manifests").join(order, "snapshot_id").groupBy("snapshot", "sequence_number").agg(F.sum("record_count").alias("records"))


@register("lake_history", f"SELECT CAST(n AS BIGINT) AS sequence_number, CAST(nullif(n - 1, 0) AS BIGINT) AS parent, true AS is_current_ancestor FROM ({_COMMITS})")
def _(spark, sf_dir):
    table = _lake(spark, sf_dir)
    order = table.metadata("snapshots").select("snapshot_id", "sequence_number")
    named = table.metadata("history").join(order, "snapshot_id")
    return named.join(order.toDF("parent_id", "parent"), "parent_id", "left").select("sequence_number", "parent", "is_current_ancestor")


@register("lake_compacted", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, true AS fewer FROM events")
def _(spark, sf_dir):
    table = _lake(spark, sf_dir)
    before = table.load()[1].current.files
    size = sum(f.size for f in before) // 10
    compact(table, Policy(target=2 * size, small=2 * size, least_files=2, most_bytes=1 << 62))
    after = sorted(table.load()[1].current.files, key=lambda f: f.sequence)
    # the place of a row: rows of the files before its own, and its number there
    starts = [(f.path.rsplit("/", 1)[1], sum(g.rows for g in after[:n])) for n, f in enumerate(after)]
    rows = spark.read.schema(table.schema()).parquet(*[f.path for f in after]).select("event_id", F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("nth"))
    named = rows.join(F.broadcast(spark.createDataFrame(starts, "name string, start long")), "name")
    return named.select("event_id", (F.col("start") + F.col("nth") + 1).alias("place"), F.lit(len(after) < len(before)).alias("fewer"))


# side outputs

_LINE = """'{"schema":"s","table":"events","op":"insert","after":{"id":"' || event_id || '"},"position":"0/' || printf('%X', event_id) || '","commit_position":"0/' || printf('%X', event_id) || '","commit_timestamp_us":0}'"""


@register("decode_errors", f"SELECT kind, line, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'decode' ELSE 'good' END AS kind, CASE WHEN event_id % 7 = 0 THEN left(l, length(l) - 3 - event_id % 5) ELSE '' END AS line FROM (SELECT event_id, {_LINE} AS l FROM events) a) b GROUP BY kind, line")
def _(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select("event_id", F.expr(_LINE).alias("l"))
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("left(l, cast(length(l) - 3 - event_id % 5 as int))")).otherwise(F.col("l"))
    out = changelog.decoded(lines.select(cut.alias("line")))
    return out.groupBy(F.when(F.col("error").isNotNull(), "decode").otherwise("good").alias("kind"), F.coalesce("error", F.lit("")).alias("line")).agg(F.count("*").alias("n"))


@register("refused_rows", """SELECT 'refused' AS kind, '0/' || printf('%X', o_orderkey) AS position, 'id' AS columns FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'landed', '', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 3 <> 0""")
def _(spark, sf_dir):
    from tidewell.streaming.apply import Applier, SourceTable

    broken = lambda c: F.transform_values(c, lambda k, v: F.when((k == "id") & (v.cast("long") % 3 == 0), F.concat(v, F.lit("x"))).otherwise(v))
    batch = _text_events(spark, sf_dir).withColumn("after", broken("after")).withColumn("before", broken("before"))
    applier = Applier(Catalog(spark, folder(spark, "letters")), "00000000-0000-0000-0000-000000000001", {("public", "orders"): SourceTable(_ORDERS, ["id"])}, dead_letters=True)
    for _ in range(2):  # delivered twice, landed once
        applier.apply(batch)
    landed = applier.table("public", "orders").scan().agg(F.lit("landed").alias("kind"), F.lit("").alias("position"), F.count("*").cast("string").alias("columns"))
    return applier.letters().scan().select("kind", "position", "columns").unionByName(landed)


# backfills: in key ranges side by side, with the stream's commits between

_CUSTOMERS = [("id", "bigint"), ("name", "text"), ("total", "double precision")]


def _customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("total"))


@register("backfill_beside_stream", """SELECT id, name, total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC) AS r FROM (
SELECT c_custkey AS id, c_name AS name, c_acctbal AS total, 'read' AS op, 0 AS p FROM customer UNION ALL
SELECT o_custkey, o_orderpriority, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'delete' ELSE 'update' END, o_orderkey + 1 FROM orders)) WHERE r = 1 AND op <> 'delete'""")
def _(spark, sf_dir):
    from tidewell.streaming import backfill
    from tidewell.streaming.apply import Applier, SourceTable

    o, rows = read(spark, sf_dir, "orders"), _customer_rows(spark, sf_dir)
    image = F.create_map(F.lit("id"), F.col("o_custkey").cast("string"), F.lit("name"), F.col("o_orderpriority"), F.lit("total"), F.col("o_totalprice").cast("string"))
    gone, at = F.col("o_orderstatus") == "F", lsn.from_number(F.col("o_orderkey") + 1)
    last = o.agg(F.max("o_orderkey")).first()[0] or 0
    slices = F.least(F.expr(f"o_orderkey * 4 div {last + 1}"), F.lit(3))
    events = o.select(F.lit("public").alias("schema"), F.lit("customer").alias("table"), F.when(gone, "delete").otherwise("update").alias("op"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"), at.alias("position"), at.alias("commit_position"), F.lit(0).cast("long").alias("commit_timestamp_us"), slices.alias("slice"))
    source = "00000000-0000-0000-0000-000000000002"
    applier = Applier(Catalog(spark, folder(spark, "backfill")), source, {("public", "customer"): SourceTable(_CUSTOMERS, ["id"])})
    table, waiting = applier.table("public", "customer"), [0, 1, 2, 3]

    def deliver() -> bool:
        """A slice of the stream before each wave of ranges."""
        if waiting:
            applier.foreach_batch(events.where(F.col("slice") == waiting.pop(0)).drop("slice"), 0)
        return False

    backfill.fill(table, source, rows, ["id"], -(-rows.count() // 8) or 1, at_once=2, stop=deliver)
    while waiting:
        deliver()
    return current_rows(table.scan(), ["id"], ordered=False)


@register("backfill_ranges", "SELECT count(*) AS n, true AS even, true AS apart FROM lineitem")
def _(spark, sf_dir):
    from tidewell.streaming import backfill

    rows, keys = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]
    schema = changelog.schema([("l_orderkey", "bigint"), ("l_linenumber", "integer"), ("l_quantity", "double precision")])
    table = Catalog(spark, folder(spark, "backfill")).create("ns", "public__lineitem", schema, keys)
    backfill.fill(table, "s", rows, keys, -(-rows.count() // 16) or 1)
    own = F.col(keys[0]).cast("decimal(20,0)") * 2**32 + F.col(keys[1])  # as one number, whose least is kept without sorting the rows by file
    files = table.scan().groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("rows"), F.min(own).alias("low"), F.max(own).alias("high"))
    before = F.lag("high").over(Window.orderBy("low"))  # a row for each of sixteen ranges
    met = files.withColumn("apart", F.coalesce(F.col("low") > before, F.lit(True)))
    return met.agg(F.sum("rows").alias("n"), (F.max("rows") <= 2 * F.avg("rows")).alias("even"), F.every("apart").alias("apart"))


# free SQL as its users send it, through the gate, over tables of the lake


def _served(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement through the query service; lake.ns.public__X are the given tables it names."""
    from tidewell.plans.service import QueryService

    catalog = Catalog(spark, folder(spark, "served"))
    for t in TABLES:
        if f"public__{t}" in text:
            rows = read(spark, sf_dir, t)
            catalog.create("ns", f"public__{t}", rows.schema).append(rows, None, "s")
    return QueryService(spark, catalog).frame(text, ["ns"])


def free(name: str, text: str, other: str) -> None:
    queries[name] = lambda spark, sf_dir: _served(spark, sf_dir, text)
    oracle_sql[name] = other


free(
    "free_sql_strings",
    """SELECT p_partkey, strpos(p_name, 'e') AS place, to_hex(p_partkey * 31) AS hexed, string_to_array(p_name, ' ')[0] AS word, array_to_string(make_array(p_brand, p_type), '|') AS both,
    regexp_match(p_brand, '([A-Za-z]+)#?([0-9])')[1] AS digit, starts_with(p_name, 'a') AS a FROM lake.ns.public__part""",
    """SELECT p_partkey, CAST(strpos(p_name, 'e') AS INTEGER) AS place, printf('%x', p_partkey * 31) AS hexed, string_split(p_name, ' ')[1] AS word, p_brand || '|' || p_type AS both,
    CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#?([0-9])') THEN regexp_extract(p_brand, '([A-Za-z]+)#?([0-9])', 2) END AS digit, starts_with(p_name, 'a') AS a FROM part""",
)
free(
    "free_sql_numbers",
    "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, trunc(0 - p_retailprice) AS whole, lower(hex(digest(p_name, 'sha256'))) AS d, lower(hex(digest(p_name, 'md5'))) AS m FROM lake.ns.public__part WHERE gcd(p_partkey, 6) > 1",
    "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, CAST(trunc(-p_retailprice) AS DOUBLE) AS whole, sha256(p_name) AS d, md5(p_name) AS m FROM part WHERE gcd(p_partkey, 6) > 1",
)
free(
    "free_sql_date_bin",
    "SELECT date_bin(INTERVAL '7' HOUR, ts, TIMESTAMP_NTZ'2001-02-03 04:05:06') AS bin, event_type, count(*) AS n FROM lake.ns.public__events GROUP BY date_bin(INTERVAL '7' HOUR, ts, TIMESTAMP_NTZ'2001-02-03 04:05:06'), event_type",
    "SELECT time_bucket(INTERVAL '7 hours', CAST(ts AS TIMESTAMP), TIMESTAMP '2001-02-03 04:05:06') AS bin, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
free(
    "free_sql_series",
    "SELECT n_nationkey, value FROM lake.ns.public__nation, LATERAL generate_series(n_nationkey, n_nationkey * 300, 7) UNION ALL SELECT n_nationkey, s.value FROM generate_series(24, 0, -1) AS s JOIN lake.ns.public__nation ON n_nationkey = s.value",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, unnest(generate_series(n_nationkey, n_nationkey * 300, 7)) AS value FROM nation UNION ALL SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey BETWEEN 0 AND 24",
)


@register("orphan_files", """SELECT 'file:///lake/data/c' || o_orderkey % 100 || '/' || o_orderkey || '.parquet' AS path FROM orders
WHERE o_orderkey % 5 <> 0 AND o_custkey < 1000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)""")
def _(spark, sf_dir):
    o, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_quantity > 25")
    at = lambda root, key, end: F.concat(F.lit(root), F.col(key) % 100, F.lit("/"), F.col(key), end)
    listed = o.select(at("file:///lake/data/c", "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, ".crc").otherwise(".parquet")).alias("path"), F.col("o_custkey").alias("modified_ms"))
    return orphans(listed, items.select(at("file:/lake/data/c", "l_orderkey", F.lit(".parquet")).alias("path")), 1000)


# more of the scalar and aggregate families

sql(
    "more_dates",
    "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day, to_timestamp(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS parsed, from_unixtime(o_orderkey * 1000) AS clock, CAST(timestamp_millis(o_orderkey * 1001) AS TIMESTAMP_NTZ) AS millis FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS parsed, strftime(epoch_ms(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') AS clock, epoch_ms(o_orderkey * 1001) AS millis FROM orders",
)
sql(
    "array_building",
    "SELECT p_partkey, array_append(array(p_size, 7), 3) AS appended, concat(array(p_size), array(1, 2)) AS joined, array_sort(array(p_size, 25, 3)) AS ordered, array_sort(array_union(array(p_size, 1), array(1, 2))) AS united, array_position(array(1, p_size), p_size) AS place FROM part",
    "SELECT p_partkey, list_append([p_size, 7], 3) AS appended, list_concat([p_size], [1, 2]) AS joined, list_sort([p_size, 25, 3]) AS ordered, list_sort(list_distinct([p_size, 1, 2])) AS united, CAST(list_position([1, p_size], p_size) AS BIGINT) AS place FROM part",
)
sql(
    "map_access",
    "SELECT p_partkey, array_sort(map_values(m)) AS vals, array_sort(map_keys(m)) AS names, m['b'] AS b, m['z'] AS absent, map_contains_key(m, 'a') AS has FROM (SELECT p_partkey, map('a', p_size, 'b', p_size + 1) AS m FROM part) t",
    "SELECT p_partkey, list_sort(map_values(m)) AS vals, list_sort(map_keys(m)) AS names, m['b'] AS b, m['z'] AS absent, map_contains(m, 'a') AS has FROM (SELECT p_partkey, MAP {'a': p_size, 'b': p_size + 1} AS m FROM part) t",
)
sql(
    "byte_encodings",
    "SELECT p_partkey, base64(CAST(p_name AS BINARY)) AS b64, lower(hex(p_name)) AS hexed, CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING) AS back, CAST(unhex(hex(p_name)) AS STRING) AS again FROM part",
    "SELECT p_partkey, to_base64(encode(p_name)) AS b64, lower(hex(encode(p_name))) AS hexed, decode(from_base64(to_base64(encode(p_name)))) AS back, decode(unhex(hex(encode(p_name)))) AS again FROM part",
)


@register("first_last_nth_aggregates", """SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS first_part, last(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS last_part, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey)[2] AS second_part FROM lineitem GROUP BY l_orderkey""")
def _(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    least = F.min(order).getField("l_partkey").alias("first_part")
    # the second by a running number, kept for two rows a key, not by a list of the whole group
    ranked = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nth = ranked.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(order))).where("n <= 2")
    second = nth.groupBy("l_orderkey").agg(F.max(F.when(F.col("n") == 2, F.col("l_partkey"))).alias("second_part"))
    ends = ranked.groupBy("l_orderkey").agg(least, F.max(order).getField("l_partkey").alias("last_part"))
    return ends.join(second, "l_orderkey")


@register("current_rows_keyless_ordered", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error' ORDER BY event_id LIMIT 60 OFFSET 40")
def _(spark, sf_dir):
    return page(current_rows(events_log(spark, sf_dir), []), 40, 60)


@register("epoch_shift", "SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS shifted FROM events")
def _(spark, sf_dir):
    since = F.unix_micros(F.col("ts").cast("timestamp")) - changelog.EPOCH_SHIFT  # the log's own clock
    return read(spark, sf_dir, "events").select("event_id", changelog.unix_micros(since).alias("shifted"))


@register("column_list", "SELECT n_name AS \"column\", 'k' || n_nationkey AS type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_nationkey")
def _(spark, sf_dir):
    n, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    columns = n.join(regions, n.n_regionkey == regions.r_regionkey).select(F.lit("s").alias("schema"), F.col("r_name").alias("table"), F.col("n_name").alias("column"), F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("k"), "n_nationkey").alias("type"))
    return catalogs.column_list(columns, "s", "ASIA")
