"""Substring dedup with a log-structured index of fingerprints.

A window is ``width`` consecutive words. Of the runs of ``GRAM`` words in it, the one of least hash is
its anchor (the first of equals). Equal windows have equal anchors, and neighbouring windows mostly
share one, so the index holds a tenth as many fingerprints as there are windows.

Each batch of documents adds an immutable run (hash, document, place), sorted by hash. Runs are
merge-joined on the hash; fingerprints that occur twice or more point to windows that may repeat.
Only those windows are hashed whole and compared (verification). Once there are more than FAN_IN
runs they are compacted into one.

Fingerprints and windows are counted where they are read before they are shuffled, so a passage that
many documents share makes a row for each task, not for each document.

Defined cases: a null text has no words. A document is known by a hash of its doc_id and text, so
repeated rows are documents of their own that repeat each other's windows. Texts shorter than a
window lose nothing. Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import wordhash
from tidewell.llm.workspace import Workspace

WIDTH, GRAM = 35, 18
FAN_IN = 4
#: Bits of a filter of members, at most: 4 MB.
FILTER_BITS = 1 << 25


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, id, text): doc stands for the row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.xxhash64(F.col(key), whole, F.col(key).isNull()).alias("doc"), F.col(key).alias("id"), whole.alias("text"))


def anchored(hashes: np.ndarray, starts: list[int], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text: their places, their anchors' places, and hashes of all grams."""
    grams = wordhash.runs(hashes, gram)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.repeat(np.array(starts[1:]), np.diff(starts))
    inside = np.flatnonzero(np.arange(n) + width <= ends[:n])
    return inside, places[inside], grams


def fingerprints(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(hash, doc, place) of every anchor of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in wordhash.blocks(batch.column(1).to_pylist()):
                hashes, starts = wordhash.words(texts)
                _, places, grams = anchored(hashes, starts, width, gram)
                places = np.unique(places)
                of = np.searchsorted(starts, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[places].view(np.int64)), pa.array(keys[first + of]), pa.array((places - np.array(starts)[of]).astype(np.int32))], ["hash", "doc", "place"])

    return docs.select("doc", "text").mapInArrow(run, "hash bigint, doc bigint, place int")


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, one for each batch, and now and then one for many."""

    def __init__(self, ws: Workspace) -> None:
        self.ws, self.names, self.made = ws, [], 0

    def _write(self, df: DataFrame) -> None:
        name = f"run-{self.made:06d}"
        self.made += 1
        self.ws.put(df.sortWithinPartitions("hash"), name)
        self.names.append(name)

    def runs(self) -> DataFrame:
        every = [self.ws.spark.read.parquet(self.ws.path(n)) for n in self.names]
        out = every[0]
        for more in every[1:]:
            out = out.unionByName(more)
        return out

    def add(self, batch: DataFrame) -> None:
        self._write(batch)
        if len(self.names) > FAN_IN:
            self.compact()

    def compact(self) -> None:
        old = list(self.names)
        merged = self.runs()
        self.names = []
        self._write(merged)
        self.ws.drop(*old)

    def repeated(self) -> DataFrame:
        """(hash, doc, place) of fingerprints that all runs together have twice or more."""
        runs = self.runs()
        twice = runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        # from a table of its own, so that a hash of very many documents can be split in the join
        twice = self.ws.put(twice, f"twice-{self.made:06d}")
        self.ws.tidy()
        return runs.join(twice, "hash")

    def matches(self, batch: DataFrame) -> DataFrame:
        """Those of a new batch's fingerprints that the runs already have."""
        return batch.join(self.runs().select("hash").distinct(), "hash", "left_semi")


def maybe(rows: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """rows with ``likely``: false only where the members (a table) lack the row's value of the column, a long.

    A filter of 16 bits a member, broadcast. Its size is known from the count of the members; were it more
    than FILTER_BITS, all rows are likely and the join that follows does the work.
    """
    bits = max(1 << 16, 1 << (16 * members.count()).bit_length())
    if bits > FILTER_BITS:
        return rows.withColumn("likely", F.lit(True))
    bit = F.pmod(F.xxhash64(name), F.lit(bits))
    filled = members.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    found = rows.withColumn("_bit", bit).withColumn("_cell", F.expr("_bit div 64")).join(F.broadcast(filled), "_cell", "left")
    return found.withColumn("likely", F.coalesce(F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1 = 1"), F.lit(False))).drop("_bit", "_cell", "_bits")


def _windows(width: int, gram: int, buckets: int):
    """Keyed documents with places of candidate anchors to windows, dealt into buckets by anchor.

    Rows of ``bucket`` null: windows known to repeat, from equals in one block. Other rows: one of each
    kind of window of the block, to be compared with those of other blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            candidates = batch.column(2).to_pylist()
            for first, texts in wordhash.blocks(batch.column(1).to_pylist()):
                hashes, starts = wordhash.words(texts)
                windows, places, grams = anchored(hashes, starts, width, gram)
                wanted = np.concatenate([np.array(candidates[first + k], np.int64) + starts[k] for k in range(len(texts))])
                likely = np.isin(places, wanted)
                windows, places = windows[likely], places[likely]
                if not len(windows):
                    continue
                whole = wordhash.runs(hashes, width)[windows]
                doc = np.searchsorted(starts, windows, side="right") - 1
                at = windows - np.array(starts)[doc]
                _, one, back, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                here = n[back] > 1
                sent = np.zeros(len(windows), bool)
                sent[one] = True
                rows: list[tuple] = []

                def pack(chosen: np.ndarray, bucket: int | None) -> None:
                    order = chosen[np.lexsort((at[chosen], doc[chosen]))]
                    rows.append((bucket, keys[first + doc[order]].astype("<i8").tobytes(), at[order].astype("<i4").tobytes(), whole[order].astype("<u8").tobytes()))

                if here.any():
                    pack(np.flatnonzero(here), None)
                deal = ((grams[places] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                chosen = np.flatnonzero(sent)
                chosen = chosen[np.argsort(deal[chosen], kind="stable")]
                ends = np.searchsorted(deal[chosen], np.arange(buckets + 1))
                for b in range(buckets):
                    if ends[b] < ends[b + 1]:
                        pack(chosen[ends[b] : ends[b + 1]], b)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bucket", "docs", "places", "windows"])

    return run


def _compared(rows: pa.Table) -> pa.Table:
    """Of one bucket's windows those that occur twice or more, a row for each document."""
    docs, places, windows = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("docs", "<i8"), ("places", "<i4"), ("windows", "<u8")))
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[back] > 1)
    return _by_document(docs[hit], places[hit])


def _by_document(docs: np.ndarray, places: np.ndarray) -> pa.Table:
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order]
    own, cuts = np.unique(docs, return_index=True)
    parts = np.split(places, cuts[1:]) if len(own) else []
    return pa.Table.from_arrays([pa.array(own, pa.int64()), pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())], ["doc", "places"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for docs, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield from _by_document(np.frombuffer(docs, "<i8"), np.frombuffer(places, "<i4")).to_batches()


def repeated_windows(docs: DataFrame, ws: Workspace, width: int = WIDTH, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """(doc, places): places (int32s) of windows whose words start anywhere else too; several rows a doc."""
    spark = docs.sparkSession
    index = FingerprintIndex(ws)
    for n in range(batches):
        index.add(fingerprints(docs.where(F.pmod(F.shiftrightunsigned("doc", 8), F.lit(batches)) == n), width, gram))
    candidates = ws.put(index.repeated().groupBy("doc").agg(F.collect_set("place").alias("places")), "candidates")
    ws.drop(*index.names)
    ws.tidy()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = maybe(docs, candidates, "doc").where("likely").select("doc", "text").join(candidates, "doc").select("doc", "text", "places")
    windows = ws.put(asked.mapInArrow(_windows(width, gram, buckets), "bucket int, docs binary, places binary, windows binary"), "windows")
    known = windows.where("bucket is null").select("docs", "places").mapInArrow(_unpacked, "doc bigint, places binary")
    shared = windows.where("bucket is not null").groupBy("bucket").applyInArrow(_compared, "doc bigint, places binary")
    out = ws.put(known.unionByName(shared), "repeated")
    ws.drop("windows")
    ws.tidy()
    return out


def _covered(n: int, places: np.ndarray, width: int) -> np.ndarray:
    """Which of n words a window at one of the places covers."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, places, 1)
    np.add.at(marks, np.minimum(places + width, n), -1)
    return np.cumsum(marks[:-1]) > 0


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """Removes the words that repeated windows cover.

    A row for each row of df: key, n_words, n_removed, and ``kept`` (binary: the words left, joined by
    one space, UTF-8).
    """
    return _removed(df, key, text, width, gram, batches, lambda x: x, "binary")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """As dedup, with ``kept_sha256`` for the words themselves."""
    return _removed(df, key, text, width, gram, batches, lambda x: hashlib.sha256(x).hexdigest(), "string").withColumnRenamed("kept", "kept_sha256")


def _removed(df: DataFrame, key: str, text: str, width: int, gram: int, batches: int, form, kind: str) -> DataFrame:
    ws = Workspace(df.sparkSession, "substrings")
    docs = keyed(df, key, text)
    found = repeated_windows(docs, ws, width, gram, batches)
    marks = found.groupBy("doc").agg(F.collect_list("places").alias("places"))
    split = maybe(docs, found, "doc")
    id_type = docs.schema["id"].dataType.simpleString()
    out_type = pa.binary() if kind == "binary" else pa.string()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n, removed, kept = [], [], []
            for t, marked in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = t.encode().split()
                n.append(len(words))
                if marked:
                    gone = _covered(len(words), np.frombuffer(b"".join(marked), "<i4").astype(np.int64), width)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                kept.append(form(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, out_type)], ["id", "n_words", "n_removed", "kept"])

    none = split.where(~F.col("likely")).select("id", "text", F.lit(None).cast("array<binary>").alias("places"))
    some = split.where("likely").join(marks, "doc", "left").select("id", "text", "places")
    schema = f"id {id_type}, n_words bigint, n_removed bigint, kept {kind}"
    return none.mapInArrow(run, schema).unionByName(some.mapInArrow(run, schema)).withColumnRenamed("id", key)


ORACLE_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(words[i + 1 : i + {WIDTH}], ' ')) AS w FROM (SELECT r, words, unnest(range(0, len(words) - {WIDTH} + 1)) AS i FROM split)
), twice AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
  SELECT r, i FROM windows SEMI JOIN twice USING (w)
), gone AS (
  SELECT DISTINCT r, i + unnest(range(0, {WIDTH})) AS i FROM hits
), kept AS (
  SELECT r, i, word FROM (SELECT r, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM split) ANTI JOIN gone USING (r, i)
), joined AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM kept GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN joined USING (r)"""
