"""What a source database says about itself: keys, columns, foreign keys, tables; and pages of its rows.

Each function takes the source's catalog tables as DataFrames (from spark.read.jdbc, or from fixtures)
and plans the same joins that the database would run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.naming import quoted, table_name

SYSTEM = ("pg_catalog", "information_schema")


def row_keys(classes: DataFrame, indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(schema, table, keys): the columns of each table's replica identity, in the order of its index.

    classes(oid, schema, name, replident); indexes(indrelid, indkey array<int>, indisprimary,
    indisreplident); attributes(attrelid, attnum, attname). Default identity: the primary key; ``i``: the
    chosen index; others have none and no row here.
    """
    wanted = ((F.col("replident") == "d") & F.col("indisprimary")) | ((F.col("replident") == "i") & F.col("indisreplident"))
    keys = classes.join(indexes, classes.oid == indexes.indrelid).where(wanted).select("oid", "schema", "name", F.posexplode("indkey").alias("nth", "attnum"))
    named = keys.join(attributes, (keys.oid == attributes.attrelid) & (keys.attnum == attributes.attnum))
    rows = named.groupBy("schema", F.col("name").alias("table")).agg(F.sort_array(F.collect_list(F.struct("nth", "attname"))).alias("k"))
    return rows.select("schema", "table", F.col("k.attname").alias("keys"))


def stored_columns(attributes: DataFrame) -> DataFrame:
    """(attrelid, columns): columns that are stored; dropped and generated ones are not."""
    live = attributes.where("attnum > 0 and not attisdropped and attgenerated = ''")
    rows = live.groupBy("attrelid").agg(F.sort_array(F.collect_list(F.struct("attnum", "attname"))).alias("k"))
    return rows.select("attrelid", F.col("k.attname").alias("columns"))


def column_list(columns: DataFrame, schema: str, table: str) -> DataFrame:
    """(column, type) of one table in its own order, from columns(schema, table, column, ordinal, type); those that the
    source generates are among them."""
    own = columns.where((F.col("schema") == schema) & (F.col("table") == table))
    return own.orderBy("ordinal").select("column", "type")


def tables(classes: DataFrame) -> DataFrame:
    """Ordinary tables outside the system's schemas, in order."""
    own = classes.where((F.col("relkind") == "r") & ~F.col("schema").isin(*SYSTEM) & ~F.col("schema").startswith("pg_toast"))
    return own.select("schema", F.col("name").alias("table")).orderBy("schema", "table")


def explorer(columns: DataFrame, primary: DataFrame, foreign: DataFrame) -> DataFrame:
    """Every column with its type, whether it may be null, is in the key, and its first foreign key.

    columns(schema, table, column, ordinal, type, nullable); primary(schema, table, column);
    foreign(schema, table, column, constraint, to_schema, to_table, to_column).
    """
    where = ["schema", "table", "column"]
    first = F.row_number().over(Window.partitionBy(*where).orderBy("constraint", "to_schema", "to_table", "to_column"))
    one = foreign.withColumn("nth", first).where("nth = 1").drop("nth", "constraint")
    keyed = columns.join(primary.select(*where).distinct().withColumn("in_key", F.lit(True)), where, "left")
    out = keyed.join(one, where, "left").withColumn("in_key", F.coalesce("in_key", F.lit(False)))
    return out.orderBy("schema", "table", "ordinal")


def flagged(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """The source's tables, and whether each is ingested."""
    marks = chosen.select("schema", "table").distinct().withColumn("ingested", F.lit(True))
    return found.join(marks, ["schema", "table"], "left").withColumn("ingested", F.coalesce("ingested", F.lit(False)))


def missing(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """Chosen tables that the source does not have any more."""
    return chosen.join(found, ["schema", "table"], "left_anti")


def existing_targets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """The source's tables that have a target table already, by the name it would get."""
    named = found.withColumn("target", table_name(F.col("schema"), F.col("table")))
    return named.join(targets.select(F.col("table").alias("target")), "target", "left_semi").select("schema", "table")


def after(keys: list[str], values: list) -> Column:
    """Rows behind a key, in the order of the key's columns: (k1, k2) > (v1, v2), typed."""
    if len(keys) != len(values):
        raise ValueError(f"{len(values)} values for {len(keys)} key columns")
    out, equal = F.lit(False), F.lit(True)
    for k, v in zip(keys, values):
        c = F.col(quoted(k))
        out, equal = out | (equal & (c > F.lit(v))), equal & (c == F.lit(v))
    return out


def read_page(rows: DataFrame, keys: list[str], limit: int, values: list | None = None) -> DataFrame:
    """The next rows by key behind the given one, every column as text.

    Filter, order and limit reach the source (or become TakeOrderedAndProject); comparison and order are
    those of the columns' types.
    """
    if not keys:
        raise ValueError("a page needs a key")
    unknown = [k for k in keys if k not in rows.columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    found = rows if values is None else rows.where(after(keys, values))
    paged = found.orderBy(*[F.col(quoted(k)).asc_nulls_last() for k in keys]).limit(limit)
    return paged.select(*[F.col(quoted(c)).cast("string").alias(c) for c in rows.columns])


def page_sql(schema: str, table: str, columns: list[str], keys: list[tuple[str, str]], limit: int, first: bool) -> str:
    """The same page in the source's own SQL, for a JDBC subquery; keys are (column, type)."""
    name = lambda x: '"' + x.replace('"', '""') + '"'
    shown = ", ".join(f"{name(c)}::text" for c in columns)
    order = ", ".join(name(k) for k, _ in keys)
    where = "" if first else f" WHERE ({order}) > ({', '.join(f'${n}::{t}' for n, (_, t) in enumerate(keys, 1))})"
    return f"SELECT {shown} FROM {name(schema)}.{name(table)}{where} ORDER BY {order} LIMIT {limit}"
