"""Which instance captures which source."""

from __future__ import annotations

import uuid

MASK = 2**64 - 1
#: FNV-1a's offset and prime, and the multipliers of splitmix64's last steps.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
FIRST, SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shard_of(source_id: str, count: int) -> int:
    return uuid.UUID(str(source_id)).int % max(1, count)


def owns(source_id: str, index: int, count: int) -> bool:
    if index >= max(1, count):
        raise ValueError(f"shard {index} of {count}")
    return shard_of(source_id, count) == index


def weight(member: str, source_id: str) -> int:
    value = OFFSET
    for byte in member.encode() + uuid.UUID(str(source_id)).bytes:
        value = (value ^ byte) * PRIME & MASK
    for shift, factor in ((30, FIRST), (27, SECOND)):
        value = (value ^ value >> shift) * factor & MASK
    return value ^ value >> 31


def owner_of(members: set[str], source_id: str) -> str | None:
    """Highest weight wins, of equals the greatest name: who joins or leaves moves only its own sources."""
    return max(members, key=lambda m: (weight(m, source_id), m.encode()), default=None)


def reconcile(running: set[str], owned: set[str]) -> tuple[set[str], set[str]]:
    """(captures to start, captures to stop)."""
    return owned - running, running - owned
