"""Saved queries and registered sources, as JSON records in the catalog's store."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from tidewell.sources.tablelog import Store

NAME, SQL = 100, 64 * 1024


@dataclass(frozen=True)
class SavedQuery:
    id: str
    project: str
    name: str
    sql: str


def checked_query(project: str, name: str, sql: str, id: str | None = None) -> SavedQuery:
    name = name.strip()
    if not name or len(name) > NAME:
        raise ValueError(f"a name has 1 to {NAME} characters")
    if not sql.strip() or len(sql.encode()) > SQL:
        raise ValueError(f"a query has 1 to {SQL} bytes")
    return SavedQuery(id or uuid.uuid4().hex, project, name, sql)


class SavedQueries:
    """Names are unique in a project, whatever their case; the text is kept as written."""

    def __init__(self, store: Store) -> None:
        self.store, self.root = store, f"{store.root}/_saved"

    def all(self, project: str) -> list[SavedQuery]:
        found = [SavedQuery(**json.loads(self.store.read(p))) for p, _, _ in self.store.list(f"{self.root}/{project}") if p.endswith(".json")]
        return sorted(found, key=lambda q: q.name.lower())

    def save(self, query: SavedQuery) -> SavedQuery:
        if any(q.name.lower() == query.name.lower() and q.id != query.id for q in self.all(query.project)):
            raise ValueError(f"there is a query named {query.name!r} already")
        path = f"{self.root}/{query.project}/{query.id}.json"
        self.store.replace(path, json.dumps(asdict(query)))
        return query

    def delete(self, project: str, id: str) -> None:
        self.store.delete(f"{self.root}/{project}/{id}.json")


@dataclass(frozen=True)
class Source:
    """A registered database. A new one ingests nothing until tables are chosen."""

    id: str
    name: str
    engine: str
    host: str
    port: int
    database: str
    user: str
    tables: tuple[tuple[str, str], ...] = field(default=())

    def checked(self) -> Source:
        uuid.UUID(self.id)
        if not all(x.strip() for x in (self.name, self.host, self.database, self.user)):
            raise ValueError("name, host, database and user must not be blank")
        if not 0 < self.port < 65536:
            raise ValueError("port out of range")
        if self.engine not in ("postgres", "mysql"):
            raise ValueError(f"no such engine: {self.engine}")
        return self

    def choosing(self, tables: list[tuple[str, str]]) -> Source:
        """The whole set is replaced; names are not checked against the database."""
        if any(not s.strip() or not t.strip() for s, t in tables):
            raise ValueError("schema and table must not be blank")
        return replace(self, tables=tuple(dict.fromkeys(tables)))


class Sources:
    def __init__(self, store: Store) -> None:
        self.store, self.root = store, f"{store.root}/_sources"

    def all(self) -> list[Source]:
        """All records; one that cannot be read fails the listing."""
        found = []
        for p, _, _ in self.store.list(self.root):
            if p.endswith(".json"):
                raw = json.loads(self.store.read(p))
                found.append(Source(**{**raw, "tables": tuple(map(tuple, raw["tables"]))}))
        return sorted(found, key=lambda s: s.id)

    def put(self, source: Source) -> None:
        path = f"{self.root}/{source.checked().id}.json"
        self.store.replace(path, json.dumps(asdict(source)))


#: Who may do what. An admin everything; a developer SQL in own projects; a user browse them.
def may(role: str, action: str, member: bool) -> bool:
    if role == "admin":
        return True
    return member and action in {"developer": ("query", "browse"), "user": ("browse",)}.get(role, ())
