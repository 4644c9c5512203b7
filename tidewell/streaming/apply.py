"""Applying a stream of changes to snapshot tables, each transaction whole and once.

The table's own checkpoint, committed with its rows, is the truth; Spark's offsets only say where to
read on. A batch that is delivered again after a crash finds its transactions covered and adds nothing.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import lsn, naming
from tidewell.functions.naming import table_of
from tidewell.operators import changelog
from tidewell.sources.tablelog import Catalog, Table, checkpoint_of

log = logging.getLogger(__name__)

DEAD_LETTERS, DEAD_MARK = "_dead_letters", "cdc.dead"
LETTERS = T.StructType([T.StructField(c, T.LongType() if c == "line" else T.StringType(), True) for c in ("kind", "schema", "table", "position", "line", "columns", "content")])


@dataclass(frozen=True)
class SourceTable:
    """Columns (name, type in the source) and key; an empty key: the table has none."""

    columns: list[tuple[str, str]]
    keys: list[str]


def uncovered(events: DataFrame, checkpoint: str | None, legacy: bool) -> DataFrame:
    """Events that a table does not have yet.

    A checkpoint is the commit position of the last transaction; one of the legacy kind is a change's
    own position. One that cannot be read covers nothing.
    """
    try:
        known = None if checkpoint is None else lsn.parse(checkpoint)
    except ValueError:
        log.error("unreadable checkpoint %r: nothing is skipped", checkpoint)
        known = None
    if known is None:
        return events
    return events.where(lsn.sort_key(F.col("position" if legacy else "commit_position")) > f"{known:016X}")


@dataclass
class Applier:
    """Commits micro-batches of one source. ``tables``: what its tables look like; ``selection``: which
    are captured, read anew for each batch, None for all."""

    catalog: Catalog
    source_id: str
    tables: dict[tuple[str, str], SourceTable]
    selection: Callable[[], set[tuple[str, str]] | None] = lambda: None
    failed: dict[tuple[str, str], Exception] = field(default_factory=dict)
    #: Rows that a column's type refuses, and lines that could not be decoded, go to the table of dead letters; else the
    #: former fail their table's batch and the latter are logged.
    dead_letters: bool = False

    def letters(self) -> Table:
        """kind (decode or refused), schema, table, position, line, columns (that refuse their text), content (what came)."""
        return self.catalog.create(self.namespace, DEAD_LETTERS, LETTERS)

    def _bury(self, rows: DataFrame, kind: str, mark: str, covered: Column) -> None:
        """Appends letters that are not there yet and, in the same commit, up to where those of this kind are."""
        table = self.letters()
        name = f"{DEAD_MARK}.{kind}"
        known = table.load()[1].properties.get(name)
        new = rows if known is None else rows.where(covered > known)
        if known is None or mark > known:
            table.append(new.select(*LETTERS.names), None, self.source_id, "dead", {name: mark})

    def _decode_errors(self, errors: DataFrame) -> None:
        count, last = errors.agg(F.count("*"), F.max("line") if "line" in errors.columns else F.lit(None).cast("long")).first()
        if not count:
            return
        if not self.dead_letters or last is None:
            log.error("%d lines could not be decoded", count)
            return
        found = errors.select(F.lit("decode").alias("kind"), "schema", "table", "position", "line", F.lit(None).cast("string").alias("columns"), F.concat_ws(": ", F.col("after")["error"], F.col("after")["raw"]).alias("content"))
        self._bury(found, "decode", f"{last:020d}", F.lpad(F.col("line").cast("string"), 20, "0"))

    def _refused(self, new: DataFrame, table: Table, schema: str, name: str, top: str) -> DataFrame:
        """Puts away the rows of a batch that a column refuses; the others."""
        target = table.schema()
        marked = changelog.checked(new, target)
        found = marked.where(F.size("refused") > 0).select(
            F.lit("refused").alias("kind"),
            "schema",
            "table",
            "position",
            (F.col("line") if "line" in new.columns else F.lit(None)).cast("long").alias("line"),
            F.array_join("refused", ",").alias("columns"),
            F.to_json(changelog.image()).alias("content"),
            lsn.sort_key(F.col("commit_position")).alias("at"),
        )
        if not found.isEmpty():
            self._bury(found, f"refused.{schema}.{name}", top, F.col("at"))
        return marked.where(F.size("refused") == 0).drop("refused")

    @property
    def namespace(self) -> str:
        return naming.namespace_of(self.source_id)

    def table(self, schema: str, name: str) -> Table:
        known = self.tables.get((schema, name))
        if known is None or not known.columns:
            raise ValueError(f"no columns known of {schema}.{name}")
        return self.catalog.create(self.namespace, table_of(schema, name), changelog.schema(known.columns), known.keys)

    def apply(self, batch: DataFrame) -> dict[tuple[str, str], str]:
        """Commits a batch of whole transactions; returns the checkpoints of the tables that grew.

        Tables are committed one by one; if one fails the others go on, and the batch is to be
        delivered again, which the tables that have it will skip. Dead letters are committed before the rows beside
        them, with a mark of their own, so that they too are there once, however often a batch is delivered.
        """
        self.failed = {}
        chosen = self.selection()
        whole = batch.where("op <> 'progress'").persist()
        events = whole.where("op <> 'error'")
        landed: dict[tuple[str, str], str] = {}
        try:
            self._decode_errors(whole.where("op = 'error'"))
            for schema, name in sorted((r.schema, r.table) for r in events.select("schema", "table").distinct().collect()):
                if chosen is not None and (schema, name) not in chosen:
                    continue
                try:
                    table = self.table(schema, name)
                    state = table.load()[1]
                    new = uncovered(events.where((F.col("schema") == schema) & (F.col("table") == name)), *checkpoint_of(state))
                    top = new.agg(F.max(lsn.sort_key(F.col("commit_position")))).first()[0]
                    if top is None:
                        continue
                    if self.dead_letters:
                        new = self._refused(new, table, schema, name, top)
                    rows = changelog.rows(new.orderBy(lsn.sort_key(F.col("commit_position")), *([F.col("line")] if "line" in new.columns else [lsn.sort_key(F.col("position"))])), self.source_id, table.schema(state))
                    mark = lsn.show(int(top, 16))
                    table.append(rows, mark, self.source_id)
                    landed[schema, name] = mark
                except Exception as error:
                    log.exception("batch of %s.%s", schema, name)
                    self.failed[schema, name] = error
        finally:
            whole.unpersist()
        return landed

    def foreach_batch(self, batch: DataFrame, number: int) -> None:
        """For writeStream.foreachBatch: a failure makes Spark deliver the batch again."""
        self.apply(batch)
        if self.failed:
            raise next(iter(self.failed.values()))


@dataclass
class Progress:
    """How far the source may let go of its log."""

    delivered: int | None = None
    confirmed: int | None = None

    def floor(self, oldest_buffered: int | None) -> int | None:
        """The position to confirm, if it moved: just before the oldest transaction that is not durable,
        or else all that was delivered. Tables with nothing waiting do not hold it back."""
        at = max(0, oldest_buffered - 1) if oldest_buffered is not None else self.delivered
        if at is None or (self.confirmed is not None and at <= self.confirmed):
            return None
        self.confirmed = at
        return at

    def seen(self, position: str) -> None:
        at = lsn.parse(position)
        self.delivered = at if self.delivered is None else max(self.delivered, at)


@dataclass
class Session:
    """The delivery rules for one source, change by change: what a micro-batch engine does in batches.

    ``commit(table, changes, checkpoint)`` may raise: the changes then stay and are tried again.
    """

    commit: Callable[[tuple[str, str], list[dict], str], None]
    checkpoint: Callable[[tuple[str, str]], tuple[str | None, bool]]
    confirm: Callable[[int], None]
    most: int = 1000
    interval: float = 5.0
    clock: Callable[[], float] = time.monotonic
    selection: Callable[[], set[tuple[str, str]] | None] = lambda: None
    waiting: dict[tuple[str, str], list[tuple[int, dict]]] = field(default_factory=dict)
    marks: dict[tuple[str, str], tuple[int, bool] | None] = field(default_factory=dict)
    flushed: dict[tuple[str, str], float] = field(default_factory=dict)
    progress: Progress = field(default_factory=Progress)
    open: bool = False

    def change(self, record: dict) -> None:
        self.open = True
        table = record["schema"], record["table"]
        chosen = self.selection()
        if chosen is not None and table not in chosen:
            return
        try:
            commit = lsn.parse(record["commit_position"])
        except ValueError:
            log.error("dropped a change with an unreadable commit position: %r", record["commit_position"])
            return
        if table not in self.marks:
            text, legacy = self.checkpoint(table)
            try:
                self.marks[table] = None if text is None else (lsn.parse(text), legacy)
            except ValueError:
                self.marks[table] = None
            self.waiting[table], self.flushed[table] = [], self.clock()
        mark = self.marks[table]
        if mark is not None and (lsn.parse(record["position"]) if mark[1] else commit) <= mark[0]:
            return
        self.waiting[table].append((commit, record))

    def progressed(self, position: str) -> None:
        self.open = False
        try:
            self.progress.seen(position)
        except ValueError:
            log.error("unreadable progress: %r", position)
        for table, held in self.waiting.items():
            if len(held) >= self.most:
                self._flush(table)
        self._confirm()

    def tick(self) -> None:
        if not self.open:
            now = self.clock()
            for table, held in self.waiting.items():
                if held and now - self.flushed[table] >= self.interval:
                    self._flush(table)
        self._confirm()

    def _flush(self, table: tuple[str, str]) -> None:
        held = self.waiting[table]
        top = held[-1][0]
        try:
            self.commit(table, [r for _, r in held], lsn.show(top))
        except Exception:
            log.exception("batch of %s stays for another try", table)
            return
        self.marks[table], self.flushed[table] = (top, False), self.clock()
        held.clear()

    def _confirm(self) -> None:
        oldest = min((held[0][0] for held in self.waiting.values() if held), default=None)
        at = self.progress.floor(oldest)
        if at is not None:
            self.confirm(at)


@dataclass
class Backoff:
    """Pauses between sessions: doubling from the first to the last, begun anew after a long session."""

    first: float = 1.0
    last: float = 60.0
    steady: float = 60.0
    next: float = 1.0

    def after(self, session_seconds: float) -> float:
        if session_seconds >= self.steady:
            self.next = self.first
        pause, self.next = self.next, min(self.last, self.next * 2)
        return pause


def supervise(start: Callable[[], None], stop: Callable[[], bool], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Runs sessions until told to stop; returns how many there were."""
    backoff, count = Backoff(), 0
    while not stop():
        began = clock()
        count += 1
        try:
            start()
        except Exception:
            log.exception("session ended")
        if not stop():
            sleep(backoff.after(clock() - began))
    return count
