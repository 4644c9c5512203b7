"""How the sources of a language differ in their terms: exact divergences of smoothed shares.

Terms are found at the level of bytes: a table of 256 entries says which bytes belong to terms, so that
one difference over the joined UTF-8 buffers of many texts gives all boundaries. Slices are grouped by
xxhash; a slice whose bytes are not those of its group's first is grouped anew by its bytes, so that no
collision counts. Counts of (language, source, term) are summed in Spark.

Terms of a language are then dealt by hash into buckets of a bounded number of cells. A bucket is a CSR
matrix of sources by terms, met by the totals of the language's sources; sums over the terms of a bucket
come from reduceat over its rows, with the terms that a source lacks put in as a correction of a sum by
distinct values. Shares and divergences are whole numbers throughout. Buckets' sums are added in Spark, and
each bucket offers no more than the leading terms of a source.

Defined cases: a null text, language or source is ''. A group without terms has counts of zero; where no
term of a language is in enough documents its pairs have 0 and there are no term rows. Rows are documents of
their own, also where they are repeated. Only the named columns are read, others may have any name. An empty
table gives an empty one. A text is held whole in memory, some forty times its size at most. Shares are exact up to
9.2e15 occurrences in a language. The result has a row for each pair of sources of a language, so it grows
with their square, as asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import wordhash
from tidewell.llm.workspace import Workspace

#: Bytes of terms: letters and all that is not ASCII. A-Z become a-z.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: A term must be in so many documents of its language.
LEAST_DOCS = 3
#: Shares are in parts of this, and one more; SMOOTH is added to every count.
PARTS, SMOOTH = 1_000_000_000, 1
#: Term rows of a group.
LEADING = 200
#: Cells (source and term) of a bucket, about; sources of a bucket whose rows are worked out in one task, about.
CELLS, STRIPE = 1 << 18, 512
#: Bytes of texts that are counted together: what they share goes to Spark once.
BLOCK = 4 << 20

Hash = Callable[[bytes], int]


def grouped(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, hash_of: Hash = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's group, and the first slice of each group: one group for each sequence of bytes."""
    text = raw.tobytes()
    hashes = np.fromiter((hash_of(text[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    # byte by byte against the first of the group
    sizes = end - begin
    same = sizes == sizes[first[group]]
    inner = np.arange(sizes[same].sum()) - np.repeat(np.cumsum(sizes[same]) - sizes[same], sizes[same])
    unlike = raw[np.repeat(begin[same], sizes[same]) + inner] != raw[np.repeat(begin[first[group[same]]], sizes[same]) + inner]
    wrong = np.flatnonzero(~same)
    if unlike.any():
        wrong = np.union1d(wrong, np.flatnonzero(same)[np.repeat(np.arange(same.sum()), sizes[same])[unlike]])
    extra: dict[bytes, int] = {}
    more: list[int] = []
    for k in wrong.tolist():
        own = text[begin[k] : end[k]]
        if own not in extra:
            extra[own] = len(first) + len(more)
            more.append(k)
        group[k] = extra[own]
    return group, np.concatenate([first, np.array(more, np.int64)])


def terms_of(texts: list[bytes], hash_of: Hash = xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct terms of all texts; and the term and the text of each occurrence."""
    raw = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    if not len(raw):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(TERM[raw], prepend=False, append=False))
    begin, end = cuts[::2], cuts[1::2]
    group, first = grouped(raw, begin, end, hash_of)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    text = raw.tobytes()
    return [text[begin[k] : end[k]] for k in first.tolist()], group, np.searchsorted(starts, begin, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (lang, source, term, n, docs) by block; a null term shows that the group occurs."""
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, texts in wordhash.blocks(batch.column(2).to_pylist(), BLOCK):
            names: dict[tuple[str, str], int] = {}
            home = np.array([names.setdefault(k, len(names)) for k in zip(langs[at : at + len(texts)], sources[at : at + len(texts)], strict=True)], np.int64)
            terms, term, doc = terms_of(texts)
            width = len(terms) + 1  # the last stands for no term
            cells, n = np.unique(doc * width + term, return_counts=True)
            keys, order = np.unique(home[cells // width] * width + cells % width, return_inverse=True)
            sums, docs = np.zeros(len(keys), np.int64), np.bincount(order, minlength=len(keys))
            np.add.at(sums, order, n)
            found = [*names]
            group = np.concatenate([keys // width, np.arange(len(found))])
            column = lambda values: pa.array(values, pa.string()).take(pa.array(group))  # noqa: E731, B023
            term_column = pa.array([*terms, None], pa.binary()).cast(pa.string()).take(pa.array(np.concatenate([keys % width, np.full(len(found), width - 1)])))
            numbers = [pa.array(np.concatenate([x, np.zeros(len(found), np.int64)]), pa.int64()) for x in (sums, docs)]
            yield pa.RecordBatch.from_arrays([column([a for a, _ in found]), column([b for _, b in found]), term_column, *numbers], ["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(PARTS * (count + SMOOTH) / (total + SMOOTH * terms)), three digits at a time so that nothing overflows."""
    left, under = np.asarray(count + SMOOTH, np.int64), np.asarray(total + SMOOTH * terms, np.int64)
    out = np.zeros_like(left)
    for _ in range(3):
        out, left = out * 1000 + left * 1000 // under, left * 1000 % under
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def against_all(row: int, indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, absent: np.ndarray, terms: int) -> np.ndarray:
    """Sums over all terms of apart(row's share, other's share), for every other row of a CSR matrix of shares.

    ``absent``: the share that a row has of a term without a cell.
    """
    own = slice(indptr[row], indptr[row + 1])
    seen, times = np.unique(vals[own], return_counts=True)
    seen, times = np.append(seen, absent[row]), np.append(times, terms - times.sum())
    out = (apart(seen[:, None], absent[None, :]) * times[:, None]).sum(axis=0)  # as if the others had no cells
    mine = np.full(terms, absent[row])
    mine[cols[own]] = vals[own]
    mine = mine[cols]
    filled = np.flatnonzero(np.diff(indptr))
    if len(filled):
        change = apart(mine, vals) - apart(mine, np.repeat(absent, np.diff(indptr)))
        out[filled] += np.add.reduceat(change, indptr[filled])
    return out


RESULT = "lang string, source string, part string, item string, value long"


def _bucket(leading: int):
    """Cells of a bucket, and the groups of its language, to the bucket's part of the result."""

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table, groups: pa.Table) -> pa.Table:
        lang, stripe = key[0].as_py(), key[2].as_py()
        names = groups.column("source").to_pylist()
        asked = [k for k, s in enumerate(groups.column("home").to_pylist()) if s == stripe]
        size = groups.column("size").to_numpy()
        kinds, whole = groups.column("terms")[0].as_py(), groups.column("whole")[0].as_py()
        place = {s: k for k, s in enumerate(names)}
        rows = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
        listed = cells.column("term").combine_chunks().dictionary_encode()
        terms = pc.array_sort_indices(listed.dictionary)
        rank = np.empty(len(terms), np.int64)
        rank[terms.to_numpy()] = np.arange(len(terms))
        cols, counts = rank[listed.indices.to_numpy()] if len(listed) else np.zeros(0, np.int64), cells.column("n").to_numpy()
        order = np.lexsort((cols, rows))
        rows, cols, counts = rows[order], cols[order], counts[order]
        indptr = np.searchsorted(rows, np.arange(len(names) + 1))
        parts = []
        emit = lambda source, part, items, values: parts.append(pa.table({"lang": pa.array([lang] * len(values), pa.string()), "source": pa.array([source] * len(values), pa.string()), "part": pa.array([part] * len(values), pa.string()), "item": items, "value": pa.array(values, pa.int64())}))
        if len(cols):
            absent = share(np.zeros(len(names), np.int64), size, kinds)
            vals = share(counts, size[rows], kinds)
            total = np.zeros(len(terms), np.int64)
            np.add.at(total, cols, counts)
            usual = share(total, whole, kinds)
            words = listed.dictionary.take(terms)
        for a in asked:
            others = np.delete(np.arange(len(names)), a)
            sums = against_all(a, indptr, cols, vals, absent, len(terms)) if len(cols) else np.zeros(len(names), np.int64)
            emit(names[a], "pair", pa.array([names[b] for b in others], pa.string()), sums[others])
            own = slice(indptr[a], indptr[a + 1])
            if indptr[a] < indptr[a + 1]:
                p, q, col = vals[own], usual[cols[own]], cols[own]
                more = p > q
                value, col = apart(p[more], q[more]), col[more]
                first = np.lexsort((col, -value))[:leading]  # columns are in the order of their terms' bytes
                emit(names[a], "term", words.take(pa.array(col[first])).cast(pa.string()), value[first])
        none = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], k) for c, k in none.items()})

    return run


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term. A row with a null term for each group."""
    given = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = df.select(given(lang), given(source), given(text)).toDF("lang", "source", "text")
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, leading: int = LEADING) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: ``pair`` against each other source, ``term`` for the leading terms."""
    ws = Workspace(df.sparkSession, "divergence")
    counts = ws.put(term_counts(df, text, lang, source), "counts")
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    kept = counts.where("term is not null").withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("nth", F.row_number().over(of_term.orderBy("source")))
    cells = ws.put(kept.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", (F.col("nth") == 1).cast("long").alias("kind")), "cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("cells"), F.sum("kind").alias("kinds"))
    groups = ws.put(counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").na.fill(0, ["size", "cells", "kinds"]), "groups")
    deal = lambda n, most: F.greatest(F.ceil(n / F.lit(most)), F.lit(1)).cast("int")
    langs = groups.groupBy("lang").agg(F.sum("size").alias("whole"), F.sum("kinds").alias("terms"), deal(F.sum("cells"), CELLS).alias("buckets"), deal(F.count("*"), STRIPE).alias("stripes"))
    langs = ws.put(langs, "langs")

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = cells.join(langs.select("lang", "buckets", "stripes"), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    dealt = dealt.withColumn("stripe", each("stripes")).select("lang", "bucket", "stripe", "source", "term", "n")
    known = groups.join(langs, "lang").withColumn("home", F.pmod(F.xxhash64("source"), F.col("stripes")).cast("int"))
    known = known.withColumn("bucket", each("buckets")).withColumn("stripe", each("stripes")).select("lang", "bucket", "stripe", "source", "home", "size", "terms", "whole")
    keys = ("lang", "bucket", "stripe")
    found = ws.put(dealt.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(_bucket(leading), RESULT), "found")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= leading)
    return pairs.unionByName(terms)


#: The same in DuckDB, with every share of every group written out.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), found AS (
  SELECT lang, source, r, unnest(w) AS term FROM docs
), vocab AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS whole FROM vocab GROUP BY lang
), parts AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM found JOIN vocab USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, source, sum(n) AS size FROM counts GROUP BY lang, source
), shares AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(size, 0) + v) AS p
  FROM parts JOIN vocab USING (lang) JOIN langs USING (lang) LEFT JOIN sizes USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), usual AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (whole + v) AS q FROM vocab JOIN langs USING (lang)
), sums AS (
  SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY lang, a.source, b.source
), pairs AS (
  SELECT lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM parts a JOIN parts b USING (lang) LEFT JOIN sums s USING (lang) WHERE a.source <> b.source AND (s.source IS NULL OR (s.source = a.source AND s.item = b.source))
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
