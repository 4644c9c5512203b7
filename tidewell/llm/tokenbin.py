"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a bitmap tells
which ids go on; those have their next chunk in level 1, and so on. A rank directory over each bitmap
(ones before every 512 bits) leads from a place in one level to its place in the next. So any id is
read by a few look-ups, without decoding what stands before it.

Documents are dealt by range of doc_id and written in that order, a bounded shard at a time; the
manifest names the files of the attempts that succeeded, so tasks may run again on other machines.

Defined cases: a null text counts as empty; each document ends with the end id, so an empty one has
that alone. Null keys come first, rows of one key follow each other. An empty table writes no file.
Texts are encoded whole, however long; what a worker remembers is bounded in pieces and in bytes. Only
the key and the text are read.

File layout, little-endian: magic ``DAC1``; uint32 levels; uint64 documents, ids; per document int64
doc_id, uint8 whether it is null, uint64 ids before it in the file (arrays, one after the other); per
level uint64 codes, the chunks, the bitmap (least bit first, padded to 64 bytes) and the directory
(uint32).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.naming import quoted
from tidewell.llm.workspace import Workspace

MAGIC = b"DAC1"
END_ID = 2
#: Ids of a file, about; bounds what a task holds.
SHARD = 1 << 21
#: Bits that the rank directory has a sum for.
SPAN = 512
#: Pieces a worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 1 << 26
#: The split below and the library's agree on all characters whose first UTF-8 byte is smaller.
AGREED, FIRST_UNSURE = 0xD5, 0x540


def write_codes(ids: np.ndarray) -> bytes:
    """Ids (non-negative) as levels of chunks, bitmaps and directories."""
    rest, out, levels = ids.astype(np.uint64), [], 0
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (SPAN // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, SPAN // 8).sum(1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & np.uint64(255)).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        rest = rest[more] >> np.uint64(8)
        levels += 1
    return struct.pack("<I", levels) + b"".join(out)


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    before = np.cumsum(counts) - counts
    codes = write_codes(ids)
    table = np.array([k or 0 for k in doc_ids], "<i8").tobytes() + np.array([k is None for k in doc_ids], np.uint8).tobytes() + before.astype("<u8").tobytes()
    return MAGIC + codes[:4] + struct.pack("<QQ", len(doc_ids), len(ids)) + table + codes[4:]


class Shard:
    """A file read back: random access to ids and documents."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a file of token ids")
        levels, docs, self.n_ids = struct.unpack_from("<IQQ", raw, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        doc_ids, null, before = take("<i8", docs).tolist(), take("u1", docs).tolist(), take("<u8", docs)
        self.doc_ids = [None if n else k for k, n in zip(doc_ids, null, strict=True)]
        self.starts = np.concatenate([before, [self.n_ids]]).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            chunks, blocks = take("u1", n), -(-(-(-n // 8)) // (SPAN // 8))
            self.levels.append((chunks, take("u1", blocks * SPAN // 8), take("<u4", blocks + 1)))

    def _goes_on(self, level: int, place: int) -> bool:
        return bool(self.levels[level][1][place >> 3] >> (place & 7) & 1)

    def _rank(self, level: int, place: int) -> int:
        """Ones before a place: the directory, then at most SPAN bits."""
        _, bits, directory = self.levels[level]
        block = place // SPAN
        part = bits[block * SPAN // 8 : place >> 3]
        return int(directory[block]) + int(np.bitwise_count(part).sum()) + int(bits[place >> 3] & ((1 << (place & 7)) - 1)).bit_count()

    def token(self, place: int) -> int:
        """One id, without reading others."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = 0
        for level in range(len(self.levels)):
            value |= int(self.levels[level][0][place]) << (8 * level)
            if not self._goes_on(level, place):
                break
            place = self._rank(level, place)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of a range; in each level they are a range again, found by two ranks."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].view(bool)
            where = where[on]
            if not len(where):
                break
            start = self._rank(level, start)
            end = start + len(where)
        return out

    def document(self, nth: int) -> np.ndarray:
        return self.tokens(int(self.starts[nth]), int(self.starts[nth + 1]))


def _classes() -> np.ndarray:
    """Of the characters the two splits agree on: 0 other, 1 letter, 2 number, 3 space."""
    out = np.zeros(FIRST_UNSURE, np.uint8)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        known = regex.compile(pattern)
        out[[c for c in range(FIRST_UNSURE) if known.match(chr(c))]] = kind
    return out


def piece_starts(codes: np.ndarray, kind: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces begin that the byte-level pattern cuts texts into; the texts stand one after the other.

    A run of letters, of numbers or of other characters is a piece, with one space before it. A run of
    spaces is one, without the last if text follows; that is a piece, or joins what follows. The
    contractions 's 't 're 've 'm 'll 'd are pieces where they begin one.
    """
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    space = kind == 3
    before = np.concatenate([[0], kind[:-1]])
    blank_before = np.concatenate([[False], codes[:-1] == 32]) & ~first[:n]
    changed = first[:n] | (kind != before)
    follows = np.concatenate([~space[1:], [False]]) & ~first[1:]
    start = np.where(space, changed | follows, changed & ~blank_before)
    quote = np.flatnonzero((codes == 39) & start & ~first[1:])
    if len(quote):
        padded = np.concatenate([codes, [0, 0, 0]])
        inner = np.concatenate([first, [True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & ~inner[quote + 2]
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[at + 1] = False
            if size == 3:
                start[at + 2] = False
            after = at + size
            after = after[after < n]
            start[after[kind[after] == 1]] = True
    return np.flatnonzero(start)


class Encoder:
    """The library's ids of whole texts.

    Ids of a text are those of its pieces, one after the other. So the texts of a block are cut into
    pieces in numpy; each distinct piece is encoded by the library once and remembered, by its bytes.
    Texts with one of the file's added tokens, or with scripts that the two splits might see differently, are
    given to the library whole; so are all texts where the file's rules are other than the byte-level split of
    unchanged text (a normalizer, a prefix space, another split, truncation, padding).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split, model = rules.get("pre_tokenizer") or {}, rules["model"]
        unchanged = not any(rules.get(k) for k in ("normalizer", "truncation", "padding"))
        by_bytes = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        self.by_piece = unchanged and by_bytes and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.added = [t["content"] for t in rules.get("added_tokens") or [] if t["content"]]
        self.kind = _classes()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.ends, self.blocks = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that more than one block had, if that makes room."""
        keep = np.flatnonzero(self.blocks > 1)
        known, ids, ends = self.known, self.ids, self.ends
        self._clear()
        new = {old: k for k, old in enumerate(keep.tolist())}
        kept = {piece: new[k] for piece, k in known.items() if k in new}
        size = sum(map(len, kept))
        if len(keep) <= REMEMBERED // 2 and size <= REMEMBERED_BYTES // 2:
            self.known, self.bytes = kept, size
            count = np.diff(ends)[keep]
            upto = np.cumsum(count)
            self.ends = np.concatenate([[0], upto]).astype(np.int64)
            self.ids = ids[np.repeat(ends[keep] - (upto - count), count) + np.arange(self.ends[-1])]
            self.blocks = np.ones(len(keep), np.int32)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        made = [array("I", e.ids) for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        self.known.update(zip(pieces, range(len(self.blocks), len(self.blocks) + len(pieces)), strict=True))
        self.bytes += sum(map(len, pieces))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(m.tobytes() for m in made), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(m) for m in made])])
        self.blocks = np.concatenate([self.blocks, np.zeros(len(made), np.int32)])

    def _cut(self, texts: list[str]) -> list[bytes]:
        if not any(texts):
            return [b""] * len(texts)
        every = "".join(texts)
        codes = np.frombuffer(every.encode("utf-32-le"), "<u4")
        text_ends = np.cumsum([len(t) for t in texts])
        text_starts = text_ends - [len(t) for t in texts]
        begin = piece_starts(codes, self.kind[codes], text_starts[text_starts < len(codes)])
        # a piece begins where the one before ends; a character has one or two bytes here
        at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80))]).astype(np.int64)[np.append(begin, len(codes))]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(every.encode())]).dictionary_encode()
        names, back = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if len(self.known) + len(names) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        new = [p for p in names if p not in self.known]
        if new:
            self._learn(new)
        places = np.array([self.known[p] for p in names], np.int64)
        self.blocks[places] += 1
        place = places[back]
        first, size = self.ends[place], self.ends[place + 1] - self.ends[place]
        upto = np.cumsum(size)
        flat = self.ids[np.repeat(first - (upto - size), size) + np.arange(upto[-1])]
        cuts = np.concatenate([[0], upto])[np.searchsorted(begin, np.append(text_starts, len(codes)))] * 4
        raw = flat.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def block(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return self._whole(texts)
        plain = []
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            plain.append(not any(t in text for t in self.added) and (not len(raw) or raw.max() < AGREED))
        cut = iter(self._cut([t for t, p in zip(texts, plain) if p]))
        whole = iter(self._whole([t for t, p in zip(texts, plain) if not p]))
        return [next(cut if p else whole) for p in plain]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


MANIFEST = "part int, nth int, file string, documents bigint, ids bigint"


def write_files(df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes and writes the texts of df in ascending order of key; returns the manifest, a row a file.

    ``folder``: a URI that all machines can write to. Each row's ids end with ``end_id``. A null text
    counts as empty; null keys come first; rows of one key follow each other, by a hash of the text.
    The manifest must be stored once: running it again writes the files again.
    """
    ordered = df.select(F.col(quoted(key)).cast("long").alias("k"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("t"))
    # the bounds of the ranges come from a sample at the driver, so the texts themselves are no key
    ordered = ordered.withColumn("tie", F.xxhash64("t")).repartitionByRange("k", "tie")
    ordered = ordered.sortWithinPartitions(F.col("k").asc_nulls_first(), "tie").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, store_at = encoder(path), fs.FileSystem.from_uri(folder)
        part, nth, last = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        packed: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, size
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            name = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex}.dac"
            with store_at[0].open_output_stream(f"{store_at[1]}/{name}") as out:
                out.write(write_shard(keys, counts, np.frombuffer(b"".join(packed), "<u4")))
            row = pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "file": name, "documents": len(keys), "ids": int(counts.sum())}], pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))
            keys.clear()
            packed.clear()
            nth, size = nth + 1, 0
            return row

        for batch in batches:
            ks, ts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ts):
                upto, letters = at, 0
                while upto < len(ts) and letters < SHARD:
                    letters += len(ts[upto])
                    upto += 1
                for k, ids in zip(ks[at:upto], enc.block(ts[at:upto]), strict=True):
                    keys.append(k)
                    packed.append(ids + last)
                    size += len(ids) // 4 + 1
                    if size >= SHARD:
                        yield flush()
                at = upto
        if keys:
            yield flush()

    return ordered.mapInArrow(run, MANIFEST)


def read_files(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Reads the files of a manifest back: a row for each document in them.

    key, start (ids of all documents before it, in the order of the files), n_tokens, ids_crc32 (of
    the ids as little-endian unsigned 32-bit integers).
    """
    spark = manifest.sparkSession
    totals = sorted(manifest.groupBy("part").agg(F.sum("ids")).collect())  # a row for each written partition
    shifts, total = [], 0
    for part, n in totals:
        shifts.append((part, total))
        total += n
    table = spark.createDataFrame(shifts, "part int, shift long")
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("ids")
    files = manifest.withColumn("inside", inside).join(F.broadcast(table), "part").select("file", (F.col("inside") + F.col("shift")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                crc = [zlib.crc32(shard.document(n).astype("<u4").tobytes()) for n in range(len(shard.doc_ids))]
                starts = shard.starts
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + before, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], ["k", "start", "n_tokens", "ids_crc32"])

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = files.repartition(spread, "file").mapInArrow(run, "k bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("k", key)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Writes the ids of all documents and reads them back from the files."""
    ws = Workspace(df.sparkSession, "tokens")
    folder = ws.local_path("files")
    manifest = ws.put(write_files(df, folder, path), "manifest")
    return read_files(manifest, folder)
