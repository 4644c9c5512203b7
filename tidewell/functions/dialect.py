"""Functions that users of other SQL dialects miss in Spark, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.naming import quoted

WIDTHS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def strpos(text: Column, part: Column) -> Column:
    """Where part begins in text, from 1; 0 if it does not occur."""
    return F.call_function("instr", text, part)


def date_bin(micros: int, at: Column, origin_micros: int = 0) -> Column:
    """The start of the bin of so many microseconds that a timestamp without time zone is in."""
    since = F.unix_micros(at.cast("timestamp")) - origin_micros
    return F.timestamp_micros(since - F.pmod(since, F.lit(micros)) + origin_micros).cast("timestamp_ntz")


def int_div(a: Column, b: Column) -> Column:
    """Division of integers that cuts toward zero."""
    return F.call_function("div", a, b)


def regexp_match(text: Column, pattern: str, groups: int = 0) -> Column:
    """The first match as a list: its groups, or the whole match; null where there is none."""
    parts = [F.regexp_extract(text, pattern, g) for g in (range(1, groups + 1) if groups else [0])]
    return F.when(text.rlike(pattern), F.array(*parts))


def digest(value: Column, method: str) -> Column:
    """Binary digest by name: md5, sha224, sha256, sha384 or sha512."""
    return F.unhex(F.md5(value) if method == "md5" else F.sha2(value, int(method.removeprefix("sha"))))


def series(df: DataFrame, start: Column, stop: Column, step: Column | None = None, name: str = "value") -> DataFrame:
    """Each row once for each number of the series from start to stop, both included."""
    return df.withColumn(name, F.explode(F.sequence(start, stop) if step is None else F.sequence(start, stop, step)))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    rank = F.row_number().over(Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def groups_frame(df: DataFrame, partition: list[str], order: Column, before: int, after: int, value: Column, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: so many peer groups before and after the row's own."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(order))
    frame = Window.partitionBy(*partition).orderBy("__peers").rangeBetween(-before, after)
    return df.withColumn("__peers", rank.cast("long")).withColumn(name, value.over(frame)).drop("__peers")
