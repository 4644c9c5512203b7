"""Current rows: a changelog collapsed to the present state of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import lsn
from tidewell.functions.naming import quoted
from tidewell.operators.changelog import FIXED

PAGE, MOST = 100, 1000


def _column(name: str) -> Column:
    return F.col(quoted(name))


def latest(changelog: DataFrame, keys: list[str], method: str = "window") -> DataFrame:
    """The last change of each key, deletes included.

    ``window``: a rank of 1 by position; Spark keeps one row of each key before the shuffle already
    (WindowGroupLimit), so a key of very many changes is no burden. ``aggregate``: max_by on the
    position key, with partial aggregation. Both plan one shuffle on the key.
    """
    if method == "aggregate":
        whole = F.struct(*[_column(c).alias(f"c{n}") for n, c in enumerate(changelog.columns)])
        best = changelog.groupBy(*[_column(k) for k in keys]).agg(F.max_by(whole, F.coalesce(lsn.sort_key(F.col("_position")), F.lit("~"))).alias("__best"))
        return best.select(*[F.col("__best")[f"c{n}"].alias(c) for n, c in enumerate(changelog.columns)])
    by = Window.partitionBy(*[_column(k) for k in keys]).orderBy(lsn.sort_key(F.col("_position")).desc_nulls_first())
    return changelog.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank")


def filled(changelog: DataFrame, keys: list[str]) -> DataFrame:
    """A changelog whose null columns in updates take the last value before: for sources that leave out
    large unchanged values. A value set to null on purpose is not told apart, so this is an option."""
    by = Window.partitionBy(*[_column(k) for k in keys]).orderBy(lsn.sort_key(F.col("_position"))).rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in changelog.columns if c not in FIXED and c not in keys]
    made = {c: F.when(F.col("_op") == "update", F.coalesce(_column(c), F.last(_column(c), ignorenulls=True).over(by))).otherwise(_column(c)) for c in rest}
    return changelog.select(*[made.get(c, _column(c)).alias(c) for c in changelog.columns])


def current_rows(changelog: DataFrame, keys: list[str] | None, method: str = "window", ordered: bool = True, fill: bool = False) -> DataFrame:
    """The source's rows as the changelog last has them.

    keys: the row key; an empty list: the table has none, and every change that is no delete is a row,
    by position; None: the key is not known, and the changelog is given as it is stored.
    """
    if keys is None:
        return changelog
    if not keys:
        live = changelog.where("_op <> 'delete'")
        return (live.orderBy(lsn.sort_key(F.col("_position")).asc_nulls_first()) if ordered else live).drop(*FIXED)
    last = latest(filled(changelog, keys) if fill else changelog, keys, method).where("_op <> 'delete'").drop(*FIXED)
    return last.orderBy(*[_column(k).asc_nulls_first() for k in keys]) if ordered else last


def page(df: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """So many rows after the first so many; at most MOST, none past the end."""
    return df.offset(max(0, offset)).limit(max(0, min(limit, MOST)))
