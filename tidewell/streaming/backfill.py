"""Backfill: the rows a table had before its changes were captured, page by page or in key ranges side by side.

Backfilled rows are ``read`` rows at position 0/0, below every change, so it does not matter in which order they and
the stream's changes are committed, as long as the capture began before the rows are read. The state is committed
with the rows it speaks of: a backfill goes on behind what landed last. Each table is filled once.

* ``run`` reads pages one after the other: a source is asked for one small page at a time, in key order.
* ``fill`` cuts the keys into ranges by quantiles of a sample and keeps the cuts in the table's properties. Waves of
  ranges are one job each, a range a task, a wave a commit that holds only if the state is as it was when the wave
  began: of two backfills of a table one goes on and the other stops, and commits of the stream between are no conflict.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.naming import quoted
from tidewell.operators import changelog
from tidewell.sources.catalogs import after, read_page
from tidewell.sources.tablelog import BACKFILL, State, Table, added

PAGE = 5000
START = "0/0"
#: Rows of a range, about; keys sampled for each cut, about; ranges of a wave.
RANGE, SAMPLED, WAVE = 1_000_000, 64, 256


class Overtaken(Exception):
    """Another backfill of the same table went on meanwhile."""


def state_of(table: Table) -> dict | None:
    text = table.load()[1].properties.get(BACKFILL)
    return json.loads(text) if text else None


def _events(rows: DataFrame, now_us: int) -> DataFrame:
    """Rows of text columns as read events."""
    return rows.select(
        F.lit("").alias("schema"),
        F.lit("").alias("table"),
        F.lit("read").alias("op"),
        F.lit(None).cast("map<string,string>").alias("before"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(quoted(c)) for c in rows.columns])).alias("after"),
        F.lit(START).alias("position"),
        F.lit(START).alias("commit_position"),
        F.lit(now_us).cast("long").alias("commit_timestamp_us"),
    )


def step(table: Table, source_id: str, rows: DataFrame, keys: list[str], size: int = PAGE, now_us: int = 0) -> dict:
    """One page and the state after it, in one commit."""
    state = state_of(table) or {"state": "running", "after": None}
    if state["state"] != "running":
        return state
    if not keys:
        new = {"state": "skipped", "reason": "no key"}
        table.append(None, None, source_id, properties={BACKFILL: json.dumps(new)})
        return new
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    last = state["after"]
    values = None if last is None else [rows.sparkSession.range(1).select(F.lit(v).cast(kinds[k])).first()[0] for k, v in zip(keys, last, strict=True)]
    page = read_page(rows, keys, size, values).persist()
    try:
        found = [tuple(r) for r in page.select(*[F.col(f"`{k}`") for k in keys]).collect()]
        new = {"state": "running", "after": list(found[-1])} if len(found) == size else {"state": "done"}
        batch = changelog.rows(_events(page, now_us), source_id, table.schema()) if found else None
        table.append(batch, None, source_id, "backfill", {BACKFILL: json.dumps(new)})
    finally:
        page.unpersist()
    return new


def run(table: Table, source_id: str, rows: DataFrame, keys: list[str], size: int = PAGE, stop: Callable[[], bool] = lambda: False) -> dict:
    """Steps until the table is filled; a failed step may be run again."""
    state = state_of(table) or {"state": "running"}
    while state["state"] == "running" and not stop():
        state = step(table, source_id, rows, keys, size)
    return state


def cuts(rows: DataFrame, keys: list[str], ranges: int) -> list[list[str]]:
    """Keys, as text, that cut the rows into so many ranges of about equal size: quantiles of a sample of whole keys.

    The sample has some SAMPLED keys a range, whatever the number of rows; keys of several columns are cut as one.
    """
    if ranges < 2:
        return []
    own = [F.col(quoted(k)) for k in keys]
    found = rows.select(*own).where(~_any_null(keys))
    share = min(1.0, SAMPLED * ranges / max(1, found.count()))
    sample = found if share == 1.0 else found.sample(share, 0)
    tiled = sample.distinct().withColumn("__tile", F.ntile(ranges).over(Window.orderBy(*own)))
    tops = tiled.groupBy("__tile").agg(F.max(F.struct(*own)).alias("top")).orderBy("__tile")
    texts = tops.select(F.array(*[F.col("top")[k].cast("string") for k in keys]).alias("top")).collect()
    return [list(r.top) for r in texts[:-1]]


def _any_null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(quoted(k)).isNull()
    return out


def _behind(rows: DataFrame, keys: list[str], cut: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return after(keys, [F.lit(v).cast(kinds[k]) for k, v in zip(keys, cut, strict=True)])


def range_of(rows: DataFrame, keys: list[str], bounds: list[list[str]]) -> Column:
    """Which range a row is in, from 0: it holds the keys behind the cut before it up to its own. A binary search in a
    constant array, as a tree of comparisons makes a method too long to be compiled; a key with nulls is left of a cut
    it cannot be compared with."""
    if not bounds:
        return F.lit(0)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    known = F.array(*[F.struct(*[F.lit(v).cast(kinds[k]).alias(f"k{n}") for n, (k, v) in enumerate(zip(keys, cut, strict=True))]) for cut in bounds])
    own = F.struct(*[F.col(quoted(k)).alias(f"k{n}") for n, k in enumerate(keys)])  # nulls are least in a struct's order
    strides = F.array(*[F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(strides, F.lit(0), lambda low, s: F.when(F.get(known, low + s - 1) < own, low + s).otherwise(low))


def wave(rows: DataFrame, keys: list[str], bounds: list[list[str]], first: int, last: int) -> DataFrame:
    """Rows of the ranges from first up to but without last, each range a partition in key order.

    The outer cuts are plain comparisons, so that the source itself reads only these keys.
    """
    part = rows
    if first > 0:
        part = part.where(_behind(rows, keys, bounds[first - 1]) | _any_null(keys))
    if last <= len(bounds):
        part = part.where(~_behind(rows, keys, bounds[last - 1]) | _any_null(keys))
    own = bounds[max(0, first - 1) : last]  # the cuts around these ranges, and no others, are compared
    part = part.withColumn("__range", range_of(rows, keys, own) + F.lit(max(0, first - 1) - first))
    if first > 0 or last <= len(bounds):  # others than keys with nulls were chosen by the outer cuts
        part = part.where(~_any_null(keys) | F.col("__range").between(0, last - first - 1))
    return part.repartitionById(last - first, F.col("__range").cast("int")).sortWithinPartitions("__range", *[F.col(quoted(k)) for k in keys]).drop("__range")


def fill(table: Table, source_id: str, rows: DataFrame, keys: list[str], size: int = RANGE, at_once: int = WAVE, now_us: int = 0, stop: Callable[[], bool] = lambda: False) -> dict:
    """Fills a table from ranges of about ``size`` rows, ``at_once`` in a job and a commit; a failed call may be made again.

    A range is sorted and written by one task, so it has about RANGE rows at most, whatever ``size`` is: larger tables have
    more ranges, not larger tasks. Only rows of one key are never parted.

    Defined cases: no key: skipped. No rows: done. Repeated keys are in one range and all land. A key with nulls lands in
    the range left of what it cannot be compared with. A backfill begun in pages goes on in pages (``run``).
    """
    state = state_of(table)
    if state is None:
        if keys:
            count = rows.count()
            state = {"state": "ranges", "cuts": cuts(rows, keys, math.ceil(count / min(size, RANGE))), "next": 0}
        else:
            state = {"state": "skipped", "reason": "no key"}
        _advance(table, None, source_id, None, state)
    while state["state"] == "ranges" and not stop():
        bounds, first = state["cuts"], state["next"]
        last = min(first + at_once, len(bounds) + 1)
        texts = wave(rows, keys, bounds, first, last).select(*[F.col(quoted(c)).cast("string").alias(c) for c in rows.columns])
        new = {**state, "next": last} if last <= len(bounds) else {"state": "done"}
        _advance(table, changelog.rows(_events(texts, now_us), source_id, table.schema()), source_id, state, new)
        state = new
    return state


def _advance(table: Table, batch: DataFrame | None, source_id: str, old: dict | None, new: dict) -> None:
    """Rows and the state after them, if the state is still the old one; else the files are taken back."""
    files = table.write_files(batch, "backfill") if batch is not None else ()
    before = None if old is None else json.dumps(old)

    def change(state: State) -> State:
        if state.properties.get(BACKFILL) != before:
            raise Overtaken(f"{table.namespace}.{table.name}")
        return replace(added(state, files, None, source_id), properties=state.properties | {BACKFILL: json.dumps(new)})

    try:
        table.commit(change)
    except Overtaken:
        for f in files:
            table.store.delete(f.path)
        raise
