"""Approximate nearest neighbours by largest inner product: an inverted file with product quantisation.

Coarse centroids and the codebooks of residuals are fitted on a bounded sample (``SAMPLE`` vectors,
the first by a hash of their id). Every vector is then put in the list of its nearest centroid, with
the codes of its residual. A query visits the lists whose centroids score highest. In a list it adds
up entries of its distance tables (asymmetric: the query is not quantised), and the best of each block
are scored again with the original vectors in double precision.

Lists and the queries that visit them meet in blocks of bounded size, so a list that holds a third of
all vectors is many tasks. Broadcast: the centroids and codebooks, bounded by LISTS and CODES.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows with a null id. Rows that repeat an id are each a
candidate, and each a query where their id is asked: a query leaves out its own row, not its own id.
Rows are told apart by a number that they get when the vectors are written. An empty table has no
result. Only the named columns are read; their names may hold any character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.naming import quoted
from tidewell.llm.workspace import Workspace

SAMPLE = 20_000
LISTS, CODES = 4096, 256
#: Components that share a code.
WIDTH = 4
#: How many lists queries visit is set so that, among the sample, lists hold this share of the neighbours
#: of each run of so many vectors.
TARGET, TRIALS = 0.95, 256
#: Vectors and queries that meet in a block, about.
BLOCK, QUERIES = 4096, 512
#: Of a block, so many times the wanted number are scored exactly.
RERANK = 16


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x CODES x WIDTH; the last subspace is padded with zeros

    @property
    def subspaces(self) -> int:
        return len(self.books)

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.subspaces * WIDTH))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.subspaces, WIDTH)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        place = nearest_rows(x, self.centroids)
        rest = self._split(x - self.centroids[place])
        return place, np.stack([nearest_rows(rest[:, m], self.books[m]) for m in range(self.subspaces)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each part of each query with the entries of its book."""
        return np.einsum("qmw,mcw->qmc", self._split(q), self.books)


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    norms = (centres * centres).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norms - 2 * (x[at : at + 4096] @ centres.T)).argmin(1)
    return out


def centres(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Lloyd's k-means; a centre that loses all its rows is put on the row farthest from its own."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    if len(c) < k:
        return np.concatenate([c, np.repeat(c[:1], k - len(c), 0)])
    for _ in range(rounds):
        near = nearest_rows(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        far = np.argsort(-((x - c[near]) ** 2).sum(1), kind="stable")
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[far[: len(empty)]]
    return c


def fit(sample: np.ndarray, total: int) -> Quantiser:
    """Lists grow as the square root of all vectors."""
    lists = int(min(LISTS, max(1, len(sample) // 16), 2 ** round(np.log2(max(1.0, 2 * total**0.5)))))
    coarse = centres(sample, lists, 8)
    rest = sample - coarse[nearest_rows(sample, coarse)]
    parts = -(-sample.shape[1] // WIDTH)
    padded = np.zeros((len(rest), parts * WIDTH))
    padded[:, : rest.shape[1]] = rest
    books = np.stack([centres(padded[:, m * WIDTH : (m + 1) * WIDTH], CODES, 6, m + 1) for m in range(parts)])
    return Quantiser(coarse, books)


def calibrate(sample: np.ndarray, quantiser: Quantiser, k: int) -> int:
    """Lists to visit: by brute force inside the sample, so many hold TARGET of the k nearest.

    All of the sample is asked, in runs of TRIALS in its order, and the run that needs most lists decides:
    ids may follow clusters, and what is enough for one is not for another.
    """
    few = min(k, len(sample) - 1)
    if few < 1:
        return 1
    place = nearest_rows(sample, quantiser.centroids)
    most = 0
    for at in range(0, len(sample), TRIALS):
        asked = sample[at : at + TRIALS]
        exact = asked @ sample.T
        exact[np.arange(len(asked)), np.arange(at, at + len(asked))] = -np.inf
        near = np.argpartition(-exact, few - 1, axis=1)[:, :few]
        turn = np.argsort(np.argsort(-(asked @ quantiser.centroids.T), axis=1, kind="stable"), axis=1)
        turns = np.sort(np.take_along_axis(turn, place[near], 1).ravel())
        most = max(most, int(turns[min(len(turns) - 1, int(np.ceil(TARGET * len(turns))))]))
    return most + 1


def blocks_of(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list the first block that has it, and how many blocks it is dealt over.

    Small lists share a block; one with more than BLOCK vectors has several of its own.
    """
    first, parts, block, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, BLOCK
    for n, size in enumerate(held.tolist()):
        if size > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first[n] = block
        if size > BLOCK:
            parts[n] = -(-size // BLOCK)
            block += int(parts[n])
        else:
            room -= size
    return first, parts


def _vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, raw) of the rows that take part, raw as doubles; and their dimension."""
    rows = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").take(1)
    if not lengths:
        return df.sparkSession.createDataFrame([], "id long, raw binary"), 0
    dim = lengths[0].n
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("v") == dim) & ~odd & F.exists("v", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten(), "<f8").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "raw"])

    return rows.mapInArrow(pack, "id bigint, raw binary"), dim


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)


def search(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """The k nearest found of each row of df where ``queries`` (over the column ``id``) holds.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. A query visits
    ``probes`` lists (by default as calibrate() finds), and further ones until they hold k others.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "nearest")
    rows, dim = _vectors(df, key, vector)
    rows = ws.put(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = rows.orderBy(F.xxhash64("id", "raw"), "id", "raw").limit(SAMPLE).collect() if dim else []
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    vectors = _matrix([bytes(r.raw) for r in sorted(sample, key=lambda r: (r.id, bytes(r.raw)))], dim)
    quantiser = fit(vectors, rows.count())
    shared = spark.sparkContext.broadcast(quantiser)
    visited = probes or calibrate(vectors, quantiser, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                place, codes = shared.value.encode(_matrix(b.column(1).to_pylist(), dim))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1), b.column(2)], ["list", "id", "code", "raw", "row"])

    index = ws.put(rows.mapInArrow(assign, "list bigint, id bigint, code binary, raw binary, row bigint"), "index")
    held = np.zeros(len(quantiser.centroids), np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        held[r["list"]] = r["count"]
    first, parts = blocks_of(held)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            scores = _matrix(b.column(1).to_pylist(), dim) @ shared.value.centroids.T
            scores[:, held == 0] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")
            upto = np.maximum(visited, (np.cumsum(held[order], 1) <= k).sum(1) + 1)
            upto = np.minimum(upto, int((held > 0).sum()))
            row, block, lists = [], [], []
            for n, (o, m) in enumerate(zip(order, upto, strict=True)):
                mine: dict[int, list[int]] = {}
                for x in np.sort(o[:m]).tolist():
                    for p in range(int(parts[x])):
                        mine.setdefault(int(first[x]) + p, []).append(x)
                row += [n] * len(mine)
                block += list(mine)
                lists += list(mine.values())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), b.column(0).take(take), b.column(2).take(take), b.column(1).take(take), pa.array(lists, pa.list_(pa.int64()))], ["block", "query_id", "query_row", "query", "lists"])

    visits = ws.put(rows.where(queries).mapInArrow(visit, "block bigint, query_id bigint, query_row bigint, query binary, lists array<bigint>"), "visits")
    sets = {r["block"]: -(-r["count"] // QUERIES) for r in visits.groupBy("block").count().collect()}  # a row for each block
    table = spark.createDataFrame([(n, int(first[n]), int(parts[n])) for n in range(len(held))], "list long, first long, parts int")
    turns = F.broadcast(spark.createDataFrame(list(sets.items()) or [(0, 1)], "block long, sets int"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = index.join(F.broadcast(table), "list").withColumn("block", F.col("first") + part("row", "parts"))
    left = left.join(turns, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"), "list", "id", "row", "code", "raw")
    right = visits.join(turns, "block").select("block", part("query_row", "sets").alias("set"), "query_id", "query_row", "query", "lists")

    def meet(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if vectors.num_rows and asking.num_rows:
            ids, rows = vectors.column("id").to_numpy(), vectors.column("row").to_numpy()
            order = np.lexsort((rows, ids))
            ids, rows, raw = ids[order], rows[order], _matrix(vectors.column("raw").to_pylist(), dim)[order]
            codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            lists, place = np.unique(vectors.column("list").to_numpy()[order], return_inverse=True)
            q, own, asked = _matrix(asking.column("query").to_pylist(), dim), asking.column("query_row").to_numpy(), asking.column("query_id").to_numpy()
            open_ = np.stack([np.isin(lists, x) for x in asking.column("lists").to_pylist()])
            few = min(RERANK * k, len(ids))
            for at in range(0, len(q), 64):
                one, mine = q[at : at + 64], own[at : at + 64]
                tables = shared.value.tables(one)
                approx = (one @ shared.value.centroids[lists].T)[:, place] + sum(tables[:, m, codes[:, m]] for m in range(codes.shape[1]))
                approx[~open_[at : at + 64][:, place] | (rows[None, :] == mine[:, None])] = -np.inf
                # the best by distance tables; of equals those of the smallest ids
                least = -np.partition(-approx, few - 1, axis=1)[:, few - 1 : few]
                above, equal = approx > least, approx == least
                chosen = above | (equal & (np.cumsum(equal, 1) <= few - above.sum(1, keepdims=True)))
                near = np.nonzero(chosen)[1].reshape(len(one), few)
                exact = (raw[near] * one[:, None, :]).sum(2)
                exact[np.take_along_axis(approx, near, 1) == -np.inf] = -np.inf
                best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                scores = np.take_along_axis(exact, best, 1)
                real = scores > -np.inf
                out[0].append(np.repeat(mine, real.sum(1)))
                out[1].append(np.repeat(asked[at : at + 64], real.sum(1)))
                out[2].append(ids[np.take_along_axis(near, best, 1)[real]])
                out[3].append(scores[real])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, kinds, strict=True)], ["query_row", "query_id", "vec_id", "score"])

    keys = ["block", "set"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
