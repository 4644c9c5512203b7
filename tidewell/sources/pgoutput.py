"""The logical replication messages of Postgres (pgoutput, version 1, text) and the state between them.

Plain Python: a stream reader calls it for each message; ``decode_frame`` runs it over a captured log in
a DataFrame. The live transport is not part of this package.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from tidewell.functions import lsn
from tidewell.operators.changelog import EPOCH_SHIFT


class DecodeError(Exception):
    """A message that cannot be read; the stream goes on."""


class Truncated(DecodeError):
    pass


class MissingTerminator(DecodeError):
    pass


class UnknownRelation(DecodeError):
    pass


class UnexpectedMarker(DecodeError):
    pass


class UnexpectedKind(DecodeError):
    pass


class InvalidText(DecodeError):
    pass


@dataclass
class Message:
    """The unread rest of a message."""

    data: bytes

    def take(self, n: int) -> bytes:
        if len(self.data) < n:
            raise Truncated(f"{n} bytes expected, {len(self.data)} found")
        out, self.data = self.data[:n], self.data[n:]
        return out

    def number(self, form: str) -> int:
        return struct.unpack(">" + form, self.take(struct.calcsize(">" + form)))[0]

    def name(self) -> str:
        text, end, rest = self.data.partition(b"\0")
        if not end:
            raise MissingTerminator("a name without its end")
        self.data = rest
        return text.decode("utf-8", "replace")


@dataclass(frozen=True)
class Relation:
    schema: str
    table: str
    columns: tuple[str, ...]


@dataclass
class Decoder:
    """Relations seen and the transaction that is open."""

    relations: dict[int, Relation] = field(default_factory=dict)
    commit_position: int | None = None
    commit_micros: int = 0

    def begin(self, final: int, log_micros: int) -> None:
        self.commit_position, self.commit_micros = final, min(log_micros + EPOCH_SHIFT, 2**63 - 1)

    def commit(self, end: int) -> dict[str, Any]:
        self.commit_position = None
        return {"progress": lsn.show(end)}

    def keepalive(self, end: int) -> dict[str, Any] | None:
        """Progress, between transactions only: inside one it says nothing about the rest of it."""
        return {"progress": lsn.show(end)} if self.commit_position is None else None

    def message(self, position: int, data: bytes) -> dict[str, Any] | None:
        """A change as a record, or None; DecodeError where the message is damaged."""
        if not data:
            return None
        kind, rest = data[:1], Message(data[1:])
        if kind == b"R":
            self._relation(rest)
            return None
        if kind not in (b"I", b"U", b"D"):
            return None
        oid = rest.number("I")
        if oid not in self.relations:
            raise UnknownRelation(str(oid))
        relation = self.relations[oid]
        op, before, after = {b"I": "insert", b"U": "update", b"D": "delete"}[kind], None, None
        marker = rest.take(1)
        if op != "insert" and marker in (b"K", b"O"):
            before = self._tuple(rest, relation)
            marker = rest.take(1) if op == "update" else b""
        if op == "delete":
            if before is None:
                raise UnexpectedMarker(repr(marker))
        elif marker != b"N":
            raise UnexpectedMarker(repr(marker))
        else:
            after = self._tuple(rest, relation)
        at = lsn.show(position)
        commit = lsn.show(self.commit_position) if self.commit_position is not None else at
        return {"schema": relation.schema, "table": relation.table, "op": op, "before": before, "after": after, "position": at, "commit_position": commit, "commit_timestamp_us": self.commit_micros}

    def _relation(self, rest: Message) -> None:
        oid, schema, table = rest.number("I"), rest.name(), rest.name()
        rest.take(1)  # replica identity
        columns = []
        for _ in range(rest.number("H")):
            rest.take(1)  # flags
            columns.append(rest.name())
            rest.take(8)  # type and modifier
        self.relations[oid] = Relation(schema, table, tuple(columns))

    def _tuple(self, rest: Message, relation: Relation) -> dict[str, str | None]:
        out: dict[str, str | None] = {}
        for n in range(rest.number("H")):
            name = relation.columns[n] if n < len(relation.columns) else f"${n}"
            kind = rest.take(1)
            if kind in (b"t", b"b"):
                raw = rest.take(rest.number("I"))
                try:
                    out[name] = raw.decode()
                except UnicodeDecodeError as error:
                    raise InvalidText(name) from error
            elif kind in (b"n", b"u"):  # null, or unchanged and not sent
                out[name] = None
            else:
                raise UnexpectedKind(repr(kind))
        return out


def records(events: Iterator[tuple[str, int, int, bytes]]) -> Iterator[dict[str, Any]]:
    """A log's events (kind, position, micros, data) to changes, progress and errors, in order.

    Kinds: begin, commit, keepalive, data, stop; others are passed over.
    """
    decoder = Decoder()
    for kind, position, micros, data in events:
        found = None
        if kind == "begin":
            decoder.begin(position, micros)
        elif kind == "commit":
            found = decoder.commit(position)
        elif kind == "keepalive":
            found = decoder.keepalive(position)
        elif kind == "data":
            try:
                found = decoder.message(position, data)
            except DecodeError as error:
                found = {"error": f"{type(error).__name__}: {error}"}
        elif kind == "stop":
            return
        if found is not None:
            yield found
