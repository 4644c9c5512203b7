"""N-gram Jaccard self-join by universe partition and pigeonhole; exact.

Documents become sets of hashed five-word shingles. Texts of one set form a class, which is joined
once. Sets of a similar size form a band; a band's scheme deals the universe of shingles into m
segments by hash. If two sets of sizes x and y have a similarity of 3/4 or more they differ in
H = (x + y) / 7 shingles at most. So, if a set allots d(i) + 1 to segments so that the sum is more
than H, some segment differs in d(i) shingles at most: none (the segments are equal) or one (a segment
equals the other, or one of them less one shingle: its one-deletion neighbourhood).

Each class indexes its segments in the scheme of its band (in bands of small sets also their
one-deletion neighbourhoods) and looks up, as the larger of a pair, the schemes of its band and of
those below. Entries of equal hash meet in buckets, so it is known how many classes share each
segment, and what it is allotted goes by cost: segments that nobody shares are free, and then those
that the fewest share are probed, until the sum is reached. A class with enough segments of its own
probes nothing, whatever passages it shares. Nothing is left out.

Classes that share a probed group are candidates. All candidates of a class lie in its coarse
component (of classes that share groups). Chance ties unrelated classes, so that these components grow
faster than the input; those of several blocks are therefore parted first: a class has a sketch, the
parities of its shingles by hash, and two sets differ in as many shingles at least as their sketches in
bits, so that a group falls into the parts whose members can be similar. No similar pair is parted.
A component is compared in blocks of bounded size, and then block
against block where it has several and they are not all connected yet. In a block those that share
most groups are compared first, and pairs that are in one component by then not at all; texts are
shipped once for each block, never for each pair. So no link between different components is lost, and
groups of thousands of near copies cost a few comparisons each.

Defined cases: a document without words (or null) has an empty set and no links. A document of fewer
than five words has its whole sequence as its one shingle. Repeated rows stay repeated. Only the key
and the text are read. An empty table gives an empty one. Candidates are found by 64-bit hashes of
shingles and verified on their words. Neighbourhoods cost an entry for each shingle besides those of the
segments; they are indexed in bands where that is at most ``SMALL`` entries a set. In the other bands only
filled segments are indexed, of which there are a quarter more than are needed; a set that still has too
few of them is compared with all others, exactly, in blocks of such sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import wordhash
from tidewell.llm.components import components
from tidewell.llm.substrings import maybe
from tidewell.llm.workspace import Workspace

SHINGLE = 5
#: Similar: SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Entries that the one-deletion neighbourhoods of a set may cost, one a shingle.
SMALL = 128
#: Sets with too few segments that are compared with all others at a time.
FEW = 256
SLACK = 1.25
#: An entry's owner: the number of its class in the block, its band, and whether it is an index entry.
NUMBER, BAND, INDEX = np.uint32((1 << 24) - 1), 24, np.uint32(1 << 31)
#: Classes of a coarse component that are compared in one task, about.
BLOCK = 1024
#: Bits of a sketch at least; a larger set has a bit a shingle, about.
BITS = 256
#: The segment noted for entries of large sets.
ANY = 255


def shingle_sets(texts: list[bytes], length: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts are lower-cased in A-Z."""
    hashes, starts = wordhash.words([t.lower() for t in texts])
    every = wordhash.runs(hashes, length)
    out = []
    for a, b in zip(starts, starts[1:]):
        if b - a >= length:
            out.append(np.unique(every[a : b - length + 1]))
        elif b > a:
            out.append(wordhash.runs(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def exact_sets(texts: list[bytes], length: int = SHINGLE) -> list[np.ndarray]:
    """As shingle_sets, of numbers that stand for the words themselves: equal in these texts only where all words are."""
    numbers, _, starts = wordhash.numbered([t.lower() for t in texts])
    every = numbers
    for k in range(1, length):  # runs of k words to numbers, then those with the word that follows
        every = every[: max(0, len(numbers) - k)] * (len(numbers) + 1) + numbers[k:]
        every = np.unique(every, return_inverse=True)[1].astype(np.int64)
    short: dict[tuple[int, ...], int] = {}
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a >= length:
            out.append(np.unique(every[a : b - length + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(numbers[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return out


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by their lower bits: two sets differ in as many shingles at least as these in bits."""
    bits = max(BITS, 1 << (len(s) - 1).bit_length())
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """A row of uint64 for each sketch, all as wide as the shortest: the upper half is added to the lower."""
    width = min(map(len, sketches))
    rows = (np.frombuffer(x, "<u8").reshape(-1, width // 8) for x in sketches)
    return np.stack([np.bitwise_xor.reduce(x, axis=0) for x in rows])


def bands(most: int) -> list[tuple[int, int]]:
    """Sizes from and to, of each band: consecutive, each up to 16/9 of its least."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, lo * 16 // 9)
        out.append((lo, hi))
        lo = hi + 1
    return out


class Schemes:
    """Bands up to any size, made as they are asked for."""

    def __init__(self) -> None:
        self.bands: list[tuple[int, int]] = []

    def of(self, size: int) -> int:
        if not self.bands or self.bands[-1][1] < size:
            self.bands = bands(2 * size)
        lo, hi = 0, len(self.bands) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.bands[mid][1] < size:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def below(self, size: int) -> list[tuple[int, int]]:
        """Bands with sets that a set of this size may be linked to as the larger: (band, largest difference)."""
        least = -(-SHARE[0] * size // SHARE[1])
        own = self.of(size)
        return [(b, differences(size, min(size, self.bands[b][1]))) for b in range(self.of(least), own + 1)]

    def segments(self, band: int) -> int:
        hi = self.bands[band][1]
        most = differences(hi * SHARE[1] // SHARE[0], hi)
        return -(-(most + 1) // 2) + 2 if hi <= SMALL else int(SLACK * (most + 1)) + 1


def differences(x: int, y: int) -> int:
    """Shingles two sets of these sizes may differ in, at most, and still be similar."""
    return (x + y) * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])


def entries(s: np.ndarray, band: int, m: int, small: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a set's entries in a scheme, the segment of each, and the number of segments that count.

    Small sets: every segment, and every segment less one shingle. Large ones: the filled segments.
    """
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
    places = ((wordhash.mixed(s ^ salt) >> np.uint64(16)) % np.uint64(m)).astype(np.int64)
    terms = wordhash.mixed(s * np.uint64(0xD6E8FEB86659FD93) + salt)
    sums, sizes = np.zeros(m, np.uint64), np.bincount(places, minlength=m)
    np.add.at(sums, places, terms)
    seat = np.arange(m, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + salt
    full = wordhash.mixed(sums ^ seat)
    if not small:
        filled = np.flatnonzero(sizes)
        return full[filled], np.full(len(filled), ANY, np.uint8), len(filled)
    less = wordhash.mixed((sums[places] - terms) ^ seat[places])
    return np.concatenate([full, less]), np.concatenate([np.arange(m), places]).astype(np.uint8), m


def with_sets(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(id, size, doc, sketch): doc is the class, null for empty sets, as the sketch is."""
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, sketches = [], [], []
            for _, texts in wordhash.blocks(batch.column(1).to_pylist()):
                for s in shingle_sets(texts, length):
                    sizes.append(len(s))
                    classes.append(class_of(s) if len(s) else None)
                    sketches.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary())], ["id", "size", "doc", "sketch"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, size bigint, doc bigint, sketch binary")


#: Entries of a bucket stand in runs of one class and band: class, tag and length of each run.
PACKED = "bucket int, classes binary, tags binary, lengths binary, hashes binary, segments binary, needs binary"


def _signed(length: int, buckets: int):
    """Texts to packed entries: a row for each block of texts and bucket.

    ``needs`` (int64, four to a class and band): class, band, what its segments must sum to, what they
    would sum to if it shared none. Sets that may not differ at all are of one class: they need nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = Schemes(), set()
        for batch in batches:
            for _, texts in wordhash.blocks(batch.column(0).to_pylist()):
                classes, found, owner, segment, needs = [], [], [], [], []
                for s in shingle_sets(texts, length):
                    c = class_of(s)
                    if not len(s) or c in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(c)
                    own = schemes.of(len(s))
                    for band, differ in schemes.below(len(s)):
                        small = schemes.bands[band][1] <= SMALL
                        hashes, places, count = entries(s, band, schemes.segments(band), small)
                        found.append(hashes)
                        segment.append(places)
                        tag = np.uint32(len(classes) | band << BAND) | (INDEX if band == own else np.uint32(0))
                        owner.append(np.full(len(hashes), tag, np.uint32))
                        needs.append((c, band, differ + 1 if differ else 0, count * (2 if small else 1)))
                    classes.append(c)
                if not classes:
                    continue
                hashes, owners, places = np.concatenate(found), np.concatenate(owner), np.concatenate(segment)
                deal = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(deal, kind="stable")
                hashes, owners, places, deal = (hashes[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), owners[order].astype("<u4"), places[order], deal[order]
                ends = np.searchsorted(deal, np.arange(buckets + 1))
                names, need = np.array(classes, np.int64), np.array(needs, "<i8")
                home = need[:, 0] % buckets
                columns: list[list] = [[] for _ in range(7)]
                for b in range(buckets):
                    asked = need[home == b]
                    if ends[b] == ends[b + 1] and not len(asked):
                        continue
                    own = owners[ends[b] : ends[b + 1]]
                    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                    runs = own[begin]
                    lengths = np.diff(np.append(begin, len(own)))
                    row = (b, names[(runs & NUMBER).astype(np.int64)].astype("<i8"), (runs >> np.uint32(BAND)).astype(np.uint8), lengths.astype("<u4"), hashes[ends[b] : ends[b + 1]], places[ends[b] : ends[b + 1]], asked)
                    for c, x in zip(columns, row, strict=True):
                        c.append(x if isinstance(x, int) else x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bucket", "classes", "tags", "lengths", "hashes", "segments", "needs"])

    return run


GROUPS = ["gid", "pivot", "doc", "band", "segment", "n", "members", "need", "free"]


def _grouped(rows: pa.Table) -> pa.Table:
    """Classes that share an entry, one of them an index entry: a row for each member of each group.

    Groups of the same members (and, of small sets, for the same segment) are one, n times. Rows with
    a null gid are the needs of a class in a band.
    """
    hashes, classes, owners, places = [], [], [], []
    for names, tags, lengths, h, g in zip(*(rows.column(c).to_pylist() for c in ("classes", "tags", "lengths", "hashes", "segments")), strict=True):
        times = np.frombuffer(lengths, "<u4")
        hashes.append(np.frombuffer(h, "<u4"))
        classes.append(np.repeat(np.frombuffer(names, "<i8"), times))
        owners.append(np.repeat(np.frombuffer(tags, np.uint8).astype(np.uint32) << np.uint32(BAND), times))
        places.append(np.frombuffer(g, np.uint8))
    h, c, o, g = np.concatenate(hashes), np.concatenate(classes), np.concatenate(owners), np.concatenate(places)
    # most entries stand alone: drop them before the larger sort
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    many = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(h) else order
    h, c, o, g = h[many], c[many], o[many], g[many]
    order = np.lexsort((c, g, o & ~INDEX, h))
    h, c, o, g = h[order], c[order], o[order], g[order]
    band = ((o & ~INDEX) >> np.uint32(BAND)).astype(np.int64)
    whole = (h.astype(np.uint64) << np.uint64(24)) | (band.astype(np.uint64) << np.uint64(8)) | g.astype(np.uint64)
    out = [np.zeros(0, np.int64)] * 7
    if len(h):
        at = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]) | (c[1:] != c[:-1])]))
        index = np.logical_or.reduceat(o >= INDEX, at)
        whole, c, band, g = whole[at], c[at], band[at], g[at]
        begin = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        size = np.diff(np.concatenate([begin, [len(c)]]))
        group = np.repeat(np.arange(len(begin)), size)
        good = (size > 1) & np.logical_or.reduceat(index, begin)
        members = np.add.reduceat(wordhash.mixed(c.view(np.uint64)), begin)
        kind = wordhash.mixed(members + (band[begin].astype(np.uint64) << np.uint64(8)) + g[begin].astype(np.uint64) + (size.astype(np.uint64) << np.uint64(20)))
        _, one, n = np.unique(kind[good], return_index=True, return_counts=True)
        times = np.zeros(len(begin), np.int64)
        times[np.flatnonzero(good)[one]] = n
        keep = times[group] > 0
        out = [kind.view(np.int64)[group][keep], c[begin][group][keep], c[keep], band[keep], g[keep].astype(np.int64), times[group][keep], size[group][keep]]
    need = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 4) for x in rows.column("needs").to_pylist()])
    need = np.unique(need, axis=0)  # a class that several tasks met
    columns = [pa.array(x, pa.int64()) for x in [*out, np.zeros(len(out[0]), np.int64), np.zeros(len(out[0]), np.int64)]]
    none = pa.nulls(len(need), pa.int64())
    asked = [none, none, pa.array(need[:, 0]), pa.array(need[:, 1]), none, none, none, pa.array(need[:, 2]), pa.array(need[:, 3])]
    return pa.concat_tables([pa.Table.from_arrays(columns, GROUPS), pa.Table.from_arrays(asked, GROUPS)])


def _allotted(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups' members with ``probe``: whether the class probes the group, by the allotment of least cost.

    A large set's segments count one each, however many of them share a group; a small set's count two,
    with all their entries.
    """
    needs = rows[rows.gid.isna()].groupby(["doc", "band"], as_index=False)[["need", "free"]].max()
    groups = rows[rows.gid.notna()].drop(columns=["need", "free"])
    if groups.empty:
        return groups.assign(probe=0)[["gid", "pivot", "doc", "probe", "n"]]
    own = groups.segment == ANY
    groups = groups.assign(seat=groups.gid.where(own, groups.segment), cost=groups.n * groups.members)
    parts = groups.groupby(["doc", "band", "seat"], as_index=False).agg(n=("n", "sum"), cost=("cost", "sum"), segment=("segment", "first"))
    parts["units"] = parts.n.where(parts.segment == ANY, 2)
    parts = parts.merge(needs, on=["doc", "band"])
    parts["left"] = parts.need - parts.free + parts.groupby(["doc", "band"]).units.transform("sum")
    parts["rate"] = parts.cost / parts.units
    parts = parts.sort_values(["doc", "band", "rate", "seat"], kind="stable")
    before = parts.groupby(["doc", "band"]).units.cumsum() - parts.units
    parts["probe"] = (before < parts.left).astype("int64")
    out = groups.merge(parts[["doc", "band", "seat", "probe"]], on=["doc", "band", "seat"], how="left")
    return out.assign(probe=out.probe.fillna(0).astype("int64"))[["gid", "pivot", "doc", "probe", "n"]]


def allotted(made: DataFrame) -> DataFrame:
    """_allotted for all classes, dealt and sorted by class: one shuffle."""
    kinds = pa.schema([(c, pa.int64()) for c in ("gid", "pivot", "doc", "probe", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            frame = _allotted(table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get).astype({"doc": "int64", "band": "int64"}))
            yield from pa.Table.from_pandas(frame, kinds, preserve_index=False).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column("doc").to_numpy()
            last = int(np.searchsorted(docs, docs[-1])) if docs[0] != docs[-1] else 0  # the last class may go on
            kept.append(pa.Table.from_batches([batch.slice(0, last)]))
            if last:
                yield from done(pa.concat_tables(kept))
                kept = []
            elif kept[0].num_rows and kept[0].column("doc")[0].as_py() != docs[0]:
                yield from done(pa.concat_tables(kept))
                kept = []
            kept.append(pa.Table.from_batches([batch.slice(last)]))
        if kept:
            yield from done(pa.concat_tables(kept))

    dealt = made.repartition("doc").sortWithinPartitions("doc")
    return dealt.mapInArrow(run, "gid bigint, pivot bigint, doc bigint, probe bigint, n bigint")


def _parts(sizes: np.ndarray, bits: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """For each member of a group the first of its part, -1 if it is alone: parts are joined by pairs of which one probes that can be similar.

    A member meets those only that have no part yet, so that a group of near copies costs no more than its members.
    """
    part = np.full(len(sizes), -1)
    rest, asking = np.arange(len(sizes)), np.flatnonzero(probes)
    while len(asking):
        first, todo = asking[0], [asking[0]]
        rest, asking = rest[rest != first], asking[1:]
        while todo:
            k = todo.pop()
            met = rest if probes[k] else asking
            least, most = np.minimum(sizes[met], sizes[k]), np.maximum(sizes[met], sizes[k])
            apart = np.bitwise_count(bits[met] ^ bits[k]).sum(axis=1, dtype=np.int64)
            near = met[(least * SHARE[1] >= most * SHARE[0]) & (apart <= differences(least, most))]
            if len(near):
                part[first] = first
                part[near] = first
                rest, asking = (x[part[x] < 0] for x in (rest, asking))
                todo += near.tolist()
    return part


def _parted(rows: pa.Table) -> pa.Table:
    """Members of groups to members of their parts; those that are alone go."""
    rows = rows.sort_by("gid")
    gid, doc, probe, size = (rows.column(c).to_numpy() for c in ("gid", "doc", "probe", "size"))
    sketches = rows.column("sketch").to_pylist()
    begin = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])).tolist()
    out = []
    for a, b in zip(begin, [*begin[1:], len(gid)], strict=True):
        part = _parts(size[a:b], folded(sketches[a:b]), probe[a:b] > 0)
        at = np.flatnonzero(part >= 0)
        pivot = doc[a:b][part[at]]
        name = wordhash.mixed(gid[a:b][at].view(np.uint64) + wordhash.mixed(pivot.view(np.uint64)))
        out.append((name.view(np.int64), pivot, doc[a:b][at], probe[a:b][at]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["gid", "pivot", "doc", "probe"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if small * SHARE[1] < large * SHARE[0]:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    inner = int((both[1:] == both[:-1]).sum())
    return SHARE[1] * inner >= SHARE[0] * (small + large - inner)


def _links(docs: list[int], roots: list[int], gids: list[list[int]], probes: list[list[int]], sets: list[np.ndarray], sides: list[int] | None) -> list[tuple[int, int]]:
    """Links that join the components of one block's classes, and no more.

    Candidates share a group that one of them probes. Those that share most are compared first, and
    pairs that are in one component by then not at all. ``sides``: only pairs across sides count.
    """
    root: dict[int, int] = {}

    def find(r: int) -> int:
        while root.get(r, r) != r:
            root[r] = root.get(root[r], root[r])
            r = root[r]
        return r

    by: dict[int, list[tuple[int, int]]] = {}
    for k, (own, flags) in enumerate(zip(gids, probes, strict=True)):
        for g, f in zip(own, flags, strict=True):
            by.setdefault(g, []).append((k, f))
    n = len(docs)
    shared = np.zeros((n, n), np.int32)
    for members in by.values():
        if len(members) > 1 and any(f for _, f in members):
            at, asks = np.array([k for k, _ in members]), np.array([f for _, f in members], bool)
            shared[np.ix_(at, at)] += (asks[:, None] | asks[None, :]).astype(np.int32)
    shared = np.triu(shared, 1)
    if sides is not None:
        side = np.array(sides)
        shared[side[:, None] == side[None, :]] = 0
    sizes = np.array([len(x) for x in sets])
    shared[sizes[:, None] * SHARE[1] < sizes[None, :] * SHARE[0]] = 0
    shared[sizes[None, :] * SHARE[1] < sizes[:, None] * SHARE[0]] = 0
    a, b = np.nonzero(shared)
    order = np.argsort(-shared[a, b], kind="stable")
    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        ri, rj = find(roots[i]), find(roots[j])
        if ri != rj and _linked(sets[i], sets[j]):
            root[max(ri, rj)] = min(ri, rj)
            out.append((docs[i], docs[j]))
    return out


def _blocks(length: int):
    """Members of blocks, of one coarse component or of several small ones, to links (a, b)."""

    def run(rows: pa.Table) -> pa.Table:
        docs, roots, coarse, sides, gids, probes, texts = (rows.column(c).to_pylist() for c in ("doc", "root", "coarse", "side", "gids", "probes", "text"))
        sets = exact_sets([t.encode() for t in texts], length)
        of: dict[int, list[int]] = {}
        once = set()
        for k, (c, d) in enumerate(zip(coarse, docs, strict=True)):
            if d not in once:  # repeated rows of the input
                once.add(d)
                of.setdefault(c, []).append(k)
        out: list[tuple[int, int]] = []
        for members in of.values():
            if len(members) > 1:
                pick = lambda x: [x[k] for k in members]  # noqa: E731, B023
                out += _links(*map(pick, (docs, roots, gids, probes, sets)), pick(sides) if sides[members[0]] is not None else None)
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _compared(few: list[bytes], length: int):
    """Texts to links (a, b) of their classes with those of a few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(class_of(s), s) for s in shingle_sets(few, length)]
        for batch in batches:
            found = set()
            for _, texts in wordhash.blocks(batch.column(0).to_pylist()):
                sets = shingle_sets(texts, length)
                for (c, one), (d, two) in ((x, (class_of(s), s)) for s in sets if len(s) for x in asked):
                    if c != d and (c, d) not in found and _linked(one, two):
                        found.add((c, d))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _links_of_few(short: DataFrame, sets: DataFrame, df: DataFrame, ws: Workspace, key: str, text: str, length: int) -> DataFrame | None:
    """Links of the classes in ``short`` with all others, exactly; None if there are none. FEW texts are at the driver at a time."""
    if short.isEmpty():
        return None
    first = sets.join(short, "doc").groupBy("doc").agg(F.min(F.xxhash64("id")).alias("h"))
    rows = df.select(F.xxhash64(F.col(key)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = ws.put(rows.join(first.select("h").distinct(), "h").withColumn("turn", F.floor(F.row_number().over(Window.orderBy("h")) / FEW)), "few")
    parts = []
    for turn in range(texts.agg(F.max("turn")).first()[0] + 1):
        few = [r.text.encode() for r in texts.where(F.col("turn") == turn).select("text").collect()]
        parts.append(ws.put(rows.select("text").mapInArrow(_compared(few, length), "a bigint, b bigint").distinct(), f"few-{turn}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _coarse(groups: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(doc, coarse) of classes that share groups."""
    edges = groups.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    return components(edges, ws, name).select(F.col("node").alias("doc"), F.col("root").alias("coarse"))


def class_components(df: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text", length: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Sets and classes of all rows (id, size, doc, sketch), and (node, root) of linked classes."""
    spark = df.sparkSession
    sets = ws.put(with_sets(df, key, text, length), "sets")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(_signed(length, buckets), PACKED)
    made = ws.put(packed.groupBy("bucket").applyInArrow(_grouped, ", ".join(f"{c} bigint" for c in GROUPS)), "made")
    ws.tidy()
    exact = _links_of_few(made.where("gid is null and free < need").select("doc").distinct(), sets, df, ws, key, text, length)
    every = ws.put(allotted(made), "allotted")
    probed = every.groupBy("gid").agg(F.max("probe").alias("probed")).where("probed = 1").select("gid")
    groups = ws.put(every.join(ws.put(probed, "probed"), "gid", "left_semi"), "groups")
    ws.drop("made", "allotted")
    ws.tidy()

    # every pair to be compared lies in one coarse component
    coarse = ws.put(_coarse(groups, ws, "coarse"), "coarse")
    several = coarse.groupBy("coarse").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    wide = ws.put(coarse.join(several, "coarse", "left_semi").select("doc"), "wide")
    if not wide.isEmpty():
        sketches = sets.join(wide, "doc", "left_semi").groupBy("doc").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
        asked = groups.join(sketches, "doc").select(F.pmod("gid", F.lit(8 * buckets)).alias("key"), "gid", "doc", "probe", "size", "sketch")
        parted = ws.put(asked.groupBy("key").applyInArrow(_parted, "gid bigint, pivot bigint, doc bigint, probe bigint"), "parted")
        coarse = ws.put(coarse.join(wide, "doc", "left_anti").select("doc", "coarse").unionByName(_coarse(parted, ws, "finer")), "coarse-1")
        groups = ws.put(groups.join(wide, "doc", "left_anti").select(parted.columns).unionByName(parted), "groups-1")
        ws.drop("groups", "parted")
    many = coarse.groupBy("coarse").agg(F.count("*").alias("members")).select("coarse", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    own = groups.groupBy("doc").agg(F.collect_list("gid").alias("gids"), F.collect_list("probe").alias("probes"))
    placed = coarse.join(many, "coarse").join(own, "doc").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # one row of each class stands for it
    first = sets.where("doc is not null").groupBy("doc").agg(F.min(F.xxhash64("id")).alias("h"))
    placed = ws.put(placed.join(first, "doc"), "placed")
    ws.drop("groups", "groups-1")
    ws.tidy()

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes = []
            for _, some in wordhash.blocks(b.column(1).to_pylist()):
                classes += [class_of(s) if len(s) else None for s in shingle_sets(some, length)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes, pa.int64()), b.column(1)], ["h", "doc", "text"])

    rows = df.select(F.xxhash64(F.col(key)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    likely = maybe(rows, placed, "h").where("likely").select("h", "text")
    spread = F.pmod(F.xxhash64("coarse"), F.lit(8 * buckets))  # small components share a task's call
    inside = likely.mapInArrow(classed, "h bigint, doc bigint, text string").withColumnRenamed("h", "own").join(placed, "doc").where("own = h")
    inside = inside.withColumn("key", F.when(F.col("blocks") == 1, spread).otherwise(F.xxhash64("coarse", "block")))
    shown = ["key", "doc", F.col("doc").alias("root"), "coarse", F.lit(None).cast("int").alias("side"), "gids", "probes", "text"]
    links = ws.put(inside.select(*shown).groupBy("key").applyInArrow(_blocks(length), "a bigint, b bigint"), "links")
    if exact is not None:
        links = links.unionByName(exact)
    ws.tidy()
    roots = ws.put(components(links, ws, "first"), "roots-1")

    # classes of components with several blocks meet those of each other block, unless all are connected
    large = placed.where("blocks > 1").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    large = ws.put(large, "large")
    apart = large.groupBy("coarse").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("coarse")
    across = large.join(apart, "coarse", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    across = ws.put(across, "across")
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if across.isEmpty():
        return sets, roots
    key = F.xxhash64("coarse", F.least("block", "other"), F.greatest("block", "other"))
    texts = likely.mapInArrow(classed, "h bigint, doc bigint, text string").withColumnRenamed("h", "own")
    across = texts.join(across, "doc").where("own = h").select(key.alias("key"), "doc", "root", "coarse", F.col("block").alias("side"), "gids", "probes", "text")
    more = ws.put(across.groupBy("key").applyInArrow(_blocks(length), "a bigint, b bigint"), "more")
    ws.drop("placed", "large", "across")
    ws.tidy()
    return sets, components(joined.unionByName(more), ws, "second")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE) -> DataFrame:
    """A row for each row of df: key, n_shingles, component_id (the least key reachable by links)."""
    ws = Workspace(df.sparkSession, "setjoin")
    sets, roots = class_components(df, ws, key, text, length)
    roots = ws.put(roots, "roots-2")
    least = sets.where("doc is not null").groupBy("doc").agg(F.min("id").alias("least"))
    least = least.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("doc", "component_id")
    out = sets.join(named, "doc", "left")
    return out.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


#: The same in DuckDB, by counting the shingles that classes share.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT DISTINCT r, array_to_string(words[i + 1 : i + 5], ' ') AS g FROM (SELECT r, words, unnest(range(0, greatest(1, len(words) - 4))) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS class FROM grams GROUP BY r
), classes AS (
  SELECT class, min(r) AS r, any_value(n) AS n FROM sizes GROUP BY class
), rare AS (
  SELECT g.r, g.g, c.n FROM grams g JOIN classes c ON c.r = g.r
), pairs AS (
  SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS inner_ FROM rare a JOIN rare b ON a.g = b.g AND a.r < b.r AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM pairs WHERE 100 * inner_ >= 75 * (nx + ny - inner_)
), both_ AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM classes UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON reach.y = both_.x
), least_ AS (
  SELECT c.r, min(s.doc_id) AS doc_id FROM classes c JOIN sizes z USING (class) JOIN split s ON s.r = z.r GROUP BY c.r
), named AS (
  SELECT reach.x AS r, min(least_.doc_id) AS component_id FROM reach JOIN least_ ON least_.r = reach.y GROUP BY reach.x
)
SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id
FROM split s LEFT JOIN sizes z USING (r) LEFT JOIN classes c ON c.class = z.class LEFT JOIN named ON named.r = c.r"""
