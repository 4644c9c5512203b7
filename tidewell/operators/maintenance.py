"""Upkeep of snapshot tables: compaction, snapshot expiry, orphan sweep."""

from __future__ import annotations

import logging
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import accumulate, groupby, takewhile
from operator import itemgetter

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.tablelog import CHECKPOINT, MAINTENANCE, SOURCE, Catalog, File, State, Table, checkpoint_of, counters, snapshot

log = logging.getLogger(__name__)
SWEPT = "cdc.swept-at-ms"
MIB = 1 << 20


@dataclass(frozen=True)
class Policy:
    """Fixed defaults of the system; sizes in bytes, ages in seconds."""

    target: int = 128 * MIB
    small: int = 96 * MIB
    least_files: int = 8
    most_bytes: int = 1024 * MIB
    snapshot_age: float = 3600
    snapshots_kept: int = 10
    orphan_age: float | None = 3 * 24 * 3600
    every: float = 300
    #: A table is swept once in so many seconds; so many entries of its log stay, whatever their age.
    sweep_every: float = 3600
    entries_kept: int = 100


def plan(files: list[File], policy: Policy) -> list[list[File]]:
    """Which files to rewrite together, in the order of commits.

    Small files are packed one after the other, each into the bin before it as long as ``target`` is not exceeded. A large
    file ends a bin, so that what one file holds in the end lies close together in the log. Bins that would save too little stay
    as they are; of the others the oldest are taken, up to ``most_bytes`` in all.
    """
    ordered = sorted(files, key=lambda f: (f.sequence, f.path))

    def place(last: tuple[int, int], f: File) -> tuple[int, int]:
        number, filled = last
        if f.size >= policy.small:
            return number + 1, policy.target
        return (number, filled + f.size) if filled + f.size <= policy.target else (number + 1, f.size)

    numbers = [number for number, _ in accumulate(ordered, place, initial=(0, policy.target))][1:]
    small = [(number, f) for number, f in zip(numbers, ordered, strict=True) if f.size < policy.small]
    bins = [[f for _, f in own] for _, own in groupby(small, key=itemgetter(0))]
    size = lambda b: sum(f.size for f in b)
    worth = [b for b in bins if len(b) >= max(2, policy.least_files) or (len(b) > 1 and size(b) >= policy.small)]
    return [b for b, _ in takewhile(lambda x: x[1] <= policy.most_bytes, zip(worth, accumulate(map(size, worth)), strict=True))]


class InputGone(Exception):
    """A file to be replaced is not in the table any more."""


def rewrite(table: Table, bins: list[list[File]]) -> list[tuple[File, ...]]:
    """The rows of each bin, in the order of its files and of rows in them, as one file: one job for all bins.

    A bin is a partition, so bins are written side by side. Which file goes where is joined to the rows by broadcast; the
    list is as long as the plan, which the policy bounds.
    """
    spark = table.spark
    if not bins:
        return []
    places = [(f.path.rsplit("/", 1)[1], n, k) for n, files in enumerate(bins) for k, f in enumerate(files)]
    listed = F.broadcast(spark.createDataFrame(places, "__name string, __bin int, __file int"))
    rows = spark.read.schema(table.schema()).parquet(*[f.path for files in bins for f in files])
    rows = rows.select("*", F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__row")).join(listed, "__name")
    dealt = rows.repartitionById(len(bins), F.col("__bin")).sortWithinPartitions("__file", "__row").drop("__name", "__bin", "__file", "__row")
    made = table.write_files(dealt, "compact")
    of = lambda f: int(re.search(r"part-(\d+)", f.path.rsplit("/", 1)[1])[1])
    return [tuple(f for f in made if of(f) == n) for n in range(len(bins))]


def supported(table: Table, state: State, bins: list[list[File]]) -> bool:
    """Whether a rewrite keeps all that the files hold: they lie where this library writes them, in no partition folders, and
    have no column, and no type of one, that the table's schema does not have. The footers are read in one job."""
    paths = [f.path for b in bins for f in b]
    if not all(re.search(rf"{re.escape(table.name)}/data/[^/=]+/[^/]+$", p) for p in paths):
        return False
    try:
        stored = table.spark.read.option("mergeSchema", "true").parquet(*paths).schema if paths else []
    except (AnalysisException, PySparkException):
        return False
    known = {f.name: f.dataType for f in table.schema(state).fields}
    return all(known.get(f.name) == f.dataType for f in stored)


def compact(table: Table, policy: Policy, before_commit: Callable[[], None] | None = None) -> dict[str, int]:
    """Rewrites the planned bins in one job; each is then replaced in a commit of its own, or not at all."""
    report = Counter(bins=0, files_in=0, files_out=0, bytes_in=0)
    _, state = table.load()
    if state.current is None:
        return dict(report)
    bins = plan(list(state.current.files), policy)
    if not supported(table, state, bins):
        log.warning("%s.%s: not compacted, its files are not of the table's layout", table.namespace, table.name)
        return dict(report)
    made = rewrite(table, bins)
    if [sum(f.rows for f in b) for b in made] != [sum(f.rows for f in b) for b in bins]:
        for f in (f for b in made for f in b):
            table.store.delete(f.path)
        raise ValueError(f"{table.name}: rewritten rows differ; nothing was replaced")
    for n, (old, new) in enumerate(zip(bins, made, strict=True)):
        if before_commit:
            before_commit()

        def change(now: State, old=old, new=new) -> State:
            live = now.current.files if now.current else ()
            paths = {f.path for f in old}
            if not paths <= {f.path for f in live}:
                raise InputGone(table.name)
            made = tuple(replace(f, sequence=max(o.sequence for o in old)) for f in new)
            files = tuple(sorted([f for f in live if f.path not in paths] + list(made), key=lambda f: (f.sequence, f.path)))
            summary = counters(live, made, tuple(old)) | {MAINTENANCE: "compaction"}
            position, legacy = checkpoint_of(now)
            if position is not None and not legacy:
                summary[CHECKPOINT] = position
            if now.current and SOURCE in now.current.summary:
                summary[SOURCE] = now.current.summary[SOURCE]
            return replace(now, sequence=now.sequence + 1, snapshots=(*now.snapshots, snapshot(now, "replace", summary, files, tuple(sorted(paths)))))

        try:
            table.commit(change)
        except InputGone:
            for f in (f for b in made[n:] for f in b):
                table.store.delete(f.path)
            break
        report.update(bins=1, files_in=len(old), files_out=len(new), bytes_in=sum(f.size for f in old))
    return dict(report)


def expire(table: Table, policy: Policy, now: float | None = None) -> dict[str, int]:
    """Forgets snapshots beyond the age and the number kept, and the files only they mention."""
    limit = ((now or time.time()) - policy.snapshot_age) * 1000
    gone: list[str] = []
    count = 0

    def change(state: State) -> State | None:
        nonlocal gone, count
        keep = max(1, policy.snapshots_kept)
        old = [s for s in state.snapshots[:-keep] if s.timestamp_ms < limit]
        if not old:
            gone, count = [], 0
            return None
        ids = {s.id for s in old}
        kept = tuple(s for s in state.snapshots if s.id not in ids)
        named = lambda some: {f.path for s in some for f in s.files} | {p for s in some for p in s.removed}
        gone, count = sorted(named(old) - {f.path for s in kept for f in s.files}), len(old)
        # a checkpoint that only an expired snapshot has moves to the oldest one kept
        position, legacy = checkpoint_of(replace(state, snapshots=tuple(old)))
        first = kept[0]
        if position is not None and not legacy and checkpoint_of(replace(state, snapshots=kept[:1]))[0] is None:
            first = replace(first, summary=first.summary | {CHECKPOINT: position})
        return replace(state, snapshots=(replace(first, parent=None), *kept[1:]))

    table.commit(change)
    for path in gone:
        table.store.delete(path)
    return {"snapshots": count, "files": len(gone)}


def _plain(path: Column) -> Column:
    """A path without its scheme, however many slashes follow that."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def orphans(listed: DataFrame, named: DataFrame, before_ms: int) -> DataFrame:
    """(path) of the data files in a listing (path, modified_ms) that are older than a time and that nothing names.

    An anti join. A file whose age is not known stays; a null path is no file.
    """
    old = listed.where(F.col("path").endswith(".parquet") & (F.col("modified_ms") < before_ms)).withColumn("__plain", _plain(F.col("path")))
    kept = named.where("path is not null").select(_plain(F.col("path")).alias("__plain"))
    return old.join(kept, "__plain", "left_anti").select("path")


def listing(table: Table) -> DataFrame:
    """(path, modified_ms) of the data files, listed by Spark: folders are listed in tasks where there are many, and no
    content is read. What is there when this is called is in it."""
    found = table.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{table.root}/data")
    return found.select("path", F.unix_millis("modificationTime").alias("modified_ms"))


def sweep(table: Table, policy: Policy, now: float | None = None) -> dict[str, int]:
    """Deletes what failed writers left and what is old and of no use: data files that no snapshot names, folders of
    writers that never came to a commit, entries of the log far behind the newest. Once in ``sweep_every`` seconds.

    Files are listed before the log is read, so one that is committed meanwhile is named. Nothing younger than
    ``orphan_age`` goes; a folder goes only where all it holds is older. Files without a byte, which Spark does not list, go
    with their folder only.
    """
    report = {"orphans": 0, "folders": 0, "entries": 0}
    now = now or time.time()
    swept = table.load()[1].properties.get(SWEPT)
    if policy.orphan_age is None or (swept is not None and now * 1000 < int(swept) + policy.sweep_every * 1000):
        return report
    limit, store, data = int((now - policy.orphan_age) * 1000), table.store, f"{table.root}/data"
    if store.exists(data):
        listed, folders = listing(table), store.folders(data)
        version, state = table.load()
        names = {f.path for s in state.snapshots for f in s.files}
        named = table.spark.createDataFrame([(p,) for p in names], "path string")
        for row in orphans(listed, named, limit).toLocalIterator():
            store.delete(row.path)
            report["orphans"] += 1
        used = {p.rsplit("/", 2)[1] for p in names}
        for folder in folders:
            if folder not in used:
                left = store.list(f"{data}/{folder}")
                if all(at < limit for _, _, at in left):
                    report["orphans"] += sum(p.endswith(".parquet") for p, _, _ in left)
                    report["folders"] += 1
                    store.delete(f"{data}/{folder}")
    else:
        version = table.version()
    for path, _, at in store.list(f"{table.root}/metadata"):
        number = re.search(r"/v(\d+)\.json$", path)
        if number and int(number[1]) <= version - policy.entries_kept and at < limit:
            store.delete(path)
            report["entries"] += 1
    for path, _, at in store.list(f"{store.root}/_new"):
        if at < limit:
            store.delete(path)
    table.set_property(SWEPT, str(int(now * 1000)))
    return report


def maintain(catalog: Catalog, policy: Policy | None = None, namespaces: set[str] | None = None, now: float | None = None) -> dict[str, int]:
    """Compaction, expiry and sweep, one table at a time; a table that fails does not stop the others."""
    policy, total = policy or Policy(), Counter(tables=0, failed=0)
    for ns, name in catalog.tables(namespaces):
        table = catalog.table(ns, name)
        total["tables"] += 1
        for step in (lambda: compact(table, policy), lambda: expire(table, policy, now), lambda: sweep(table, policy, now)):
            try:
                total.update(step())
            except Exception:
                log.exception("maintenance of %s.%s", ns, name)
                total["failed"] += 1
    return dict(total)
