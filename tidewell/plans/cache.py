"""A small store of answers that live for a while."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

VERSION = "1"


def key_of(kind: str, scope: str, sql: str) -> str:
    return f"{kind}:{VERSION}:{hashlib.sha256(scope.encode() + bytes(1) + sql.encode()).hexdigest()}"


@dataclass
class Cache:
    """Answers in JSON, by key. ``ttl`` 0: nothing is cached; ``entries`` 0: nothing is stored.

    When full, an expired entry goes first, else the one that would expire soonest. Answers above
    ``most_bytes`` and errors are not kept; what is not JSON any more counts as missing.
    """

    ttl: float = 30.0
    most_bytes: int = 1 << 20
    entries: int = 256
    clock: Callable[[], float] = time.monotonic
    held: dict[str, tuple[float, str]] = field(default_factory=dict)

    def get(self, key: str) -> str | None:
        until, text = self.held.get(key, (0.0, ""))
        if key not in self.held or until <= self.clock():
            return None
        try:
            json.loads(text)
        except ValueError:
            return None
        return text

    def put(self, key: str, text: str) -> None:
        if self.entries <= 0 or len(text.encode()) > self.most_bytes:
            return
        now = self.clock()
        if key not in self.held and len(self.held) >= self.entries:
            expired = [k for k, (until, _) in self.held.items() if until <= now]
            for k in expired or [min(self.held, key=lambda k: self.held[k][0])]:
                del self.held[k]
        self.held[key] = now + self.ttl, text

    def through(self, kind: str, scope: str, sql: str, compute: Callable[[], str]) -> str:
        if self.ttl <= 0:
            return compute()
        key = key_of(kind, scope, sql)
        found = self.get(key)
        if found is None:
            found = compute()
            self.put(key, found)
        return found
