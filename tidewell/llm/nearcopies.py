"""Near copies by MinHash with sequential Bayesian verification; links are confirmed on whole sets.

Texts become sets of hashed four-word shingles; texts of one set form a class (by 128 bits), which is
compared once. A set's signature has ``BANDS * ROWS`` values of a fast similarity sketch: every shingle is
thrown into one of as many bins, round after round until no bin is empty, and a bin keeps the least of its
first round. Each value of two signatures is equal with the sets' similarity as its probability. Classes
that share a band's key are candidates: at a similarity of exactly 0.8 a pair is missed by all bands with a
probability of 5e-6.

All candidates of a class lie in its coarse component (of classes that share keys). Components are compared
in blocks of bounded size. In a block, candidates' signatures are compared batch after batch: with m equal
values of n, under a uniform prior, the similarity is at least 0.8 with the probability that a binomial of
n + 1 draws is m or less, and a pair is dropped as soon as that is under ``MISS``. Survivors are confirmed on the
words, those with most equal values first, unless earlier links join them already. A component of several
blocks that its links do not join is dealt anew, so that its parts meet, and then compared block against
block where parts still remain. No pairs are listed outside a task, and no group of copies stands in one task.

Defined cases: a text without words (or null) has an empty set and no links, and is kept. A text of fewer
than four words has its whole sequence as its one shingle. Rows that share doc_id and text stay rows of
their own and are kept or not together. A null doc_id never names a component unless all of it are null. Only the key
and the text are read, others may have any name. An empty table gives an empty one. A text is held whole in
memory, some forty times its size at most. Rows are numbered once, in a table written before use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import wordhash
from tidewell.llm.components import components
from tidewell.llm.setjoin import exact_sets, shingle_sets
from tidewell.llm.substrings import maybe
from tidewell.llm.workspace import Workspace

SHINGLE = 4
#: Similar: SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (80, 100)
BANDS, ROWS = 40, 6
VALUES = BANDS * ROWS
#: Values compared at a time, and the probability of a link at which a pair is dropped.
BATCH, MISS = 48, 1e-6
#: Classes, and shingles, of a component that are compared in one task, about.
BLOCK, LOAD = 1024, 1 << 20
#: Pairs of signatures compared at a time.
PAIRS = 1 << 16


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES values of a set of hashes, which is not empty."""
    out, empty = np.zeros(VALUES, np.uint64), np.ones(VALUES, bool)
    bins, done = np.arange(VALUES, dtype=np.uint64), 0
    while empty.any():
        # as many rounds as fill all bins, most likely
        many = max(1, -(-9 * VALUES // len(s)))
        rounds = np.arange(done, done + many, dtype=np.uint64)
        done += many
        h = wordhash.mixed(s[None, :] + wordhash.mixed(rounds + np.uint64(1))[:, None])
        # bin, round, value: the least of a bin is that of its first round
        thrown = np.sort(((((h >> np.uint64(32)) % np.uint64(VALUES)) << np.uint64(56)) | (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        at = np.searchsorted(thrown, bins << np.uint64(56))
        first = thrown[np.minimum(at, len(thrown) - 1)]
        fresh = empty & (at < len(thrown)) & (first >> np.uint64(56) == bins)
        out[fresh] = wordhash.mixed(first[fresh])
        empty &= ~fresh
    return out


def keys(values: Column) -> Column:
    """A key for each band of a signature, from its values as they are stored."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring(values, k * 2 * ROWS + 1, F.lit(2 * ROWS)), k))


def least_equal(n: int, miss: float = MISS) -> int:
    """Equal values among n that a pair must have to be similar with a probability of ``miss`` at least."""
    t, sofar = SHARE[0] / SHARE[1], 0.0
    for m in range(n + 1):
        sofar += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if sofar >= miss:
            return m
    return n


#: (values compared by then, the least that must be equal).
CHECKS = [(n, least_equal(n)) for n in range(BATCH, VALUES + 1, BATCH)]


def survivors(signatures: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no batch drops; those with most equal values come first."""
    kept = []
    for at in range(0, len(a), PAIRS):
        x, y, before = a[at : at + PAIRS], b[at : at + PAIRS], 0
        equal = np.zeros(len(x), np.int64)
        for n, least in CHECKS:
            equal += (signatures[x, before:n] == signatures[y, before:n]).sum(axis=1)
            good = equal >= least
            x, y, equal, before = x[good], y[good], equal[good], n
        kept.append((x, y, equal))
    if not kept:
        return a, b
    x, y, equal = map(np.concatenate, zip(*kept, strict=True))
    order = np.argsort(-equal, kind="stable")
    return x[order], y[order]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)


def with_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, h1, h2, size, class, values) of each row; values (16 bits of each): where a task meets a class first."""
    own, whole = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), own.alias("id"), *_named(own, whole), whole.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, classes, values = [], [], []
            for _, texts in wordhash.blocks(batch.column("t").to_pylist()):
                for s in shingle_sets(texts, SHINGLE):
                    name = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    sizes.append(len(s))
                    classes.append(name)
                    if name is None or name in seen:
                        values.append(None)
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(name)
                    values.append(signature(s).astype("<u2").tobytes())
            columns = [pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["row", "id", "h1", "h2", "size", "class", "values"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, h1 long, h2 long, size long, class binary, values binary")


def _named(key: Column, text: Column) -> list[Column]:
    """What a row is found by when the texts are read again: 128 bits."""
    return [F.xxhash64(key, text).alias("h1"), F.xxhash64(text, key, F.lit(1)).alias("h2")]


def _links(roots: list[int], met: list[list[int]], sides: list[int] | None, signatures: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(root, least root) of the roots that links among one block's classes join to a lesser one. ``sides``: only pairs across them count."""
    by: dict[int, list[int]] = {}
    for k, own in enumerate(met):
        for g in own:
            by.setdefault(g, []).append(k)
    shared = np.zeros((len(roots), len(roots)), bool)
    for members in {tuple(m) for m in by.values() if len(m) > 1}:
        shared[np.ix_(members, members)] = True
    sizes, root = np.array([len(s) for s in sets]), np.array(roots)
    shared &= sizes[:, None] * SHARE[1] >= sizes[None, :] * SHARE[0]
    shared &= shared.T & (root[:, None] != root[None, :])
    if sides is not None:
        shared &= np.array(sides)[:, None] != np.array(sides)[None, :]
    above: dict[int, int] = {}

    def find(r: int) -> int:
        while above.get(r, r) != r:
            above[r] = above.get(above[r], above[r])
            r = above[r]
        return r

    for i, j in zip(*(x.tolist() for x in survivors(signatures, *np.nonzero(np.triu(shared, 1)))), strict=True):
        ri, rj = find(roots[i]), find(roots[j])
        if ri != rj and linked(sets[i], sets[j]):
            above[max(ri, rj)] = min(ri, rj)
    # stars, not chains: fewer rounds, or none, join them over the blocks
    return [(r, find(r)) for r in above]


def _compared(rows: pa.Table) -> pa.Table:
    """Classes of blocks (of one component, or of several small ones) to (a, b): roots and the least that their block joins them to."""
    order = rows.column("node").to_numpy().argsort(kind="stable")
    rows = rows.take(pa.array(order))
    nodes, roots, coarse, sides, met, values, texts = (rows.column(c).to_pylist() for c in ("node", "root", "coarse", "side", "met", "values", "text"))
    members: dict[int, list[int]] = {}
    once: set[int] = set()
    for k, (c, n) in enumerate(zip(coarse, nodes, strict=True)):
        if n not in once:  # repeated rows of the input
            once.add(n)
            members.setdefault(c, []).append(k)
    out: list[tuple[int, int]] = []
    for own in members.values():
        if len(own) > 1:
            pick = lambda x: [x[k] for k in own]  # noqa: E731, B023
            signatures = np.stack([np.frombuffer(values[k], "<u2") for k in own])
            sets = exact_sets([t.encode() for t in pick(texts)], SHINGLE)
            out += _links(pick(roots), pick(met), pick(sides) if sides[own[0]] is not None else None, signatures, sets)
    return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})


def links(texts: DataFrame, placed: DataFrame, *key: Column) -> DataFrame:
    """Links (a, b) of the roots of the classes in ``placed`` that meet under a key; texts: (h1, h2, text)."""
    shown = ["node", "root", "coarse", "side", "met", "values", "text"]
    met = maybe(texts, placed, "h1").where("likely").drop("likely").join(placed, ["h1", "h2"])
    return met.select(*[k.alias(f"k{n}") for n, k in enumerate(key)], *shown).groupBy(*[f"k{n}" for n in range(len(key))]).applyInArrow(_compared, "a long, b long")


def class_components(df: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows (id, size, class), classes (class, node, least id) and their components (node, root)."""
    sets = ws.put(with_sets(df, key, text), "sets")
    classes = ws.put(sets.where("class is not null").groupBy("class").agg(F.min(F.when(F.col("values").isNotNull(), F.col("row"))).alias("node"), F.min("id").alias("least")), "classes")
    stands = sets.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "h1", "h2", "size", "values")
    stands = ws.put(stands, "stands")
    banded = stands.select("node", F.explode(keys(F.col("values"))).alias("gid"))
    several = ws.put(banded.groupBy("gid").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("gid", "pivot"), "several")
    groups = ws.put(banded.join(several, "gid"), "groups")

    # every pair to be compared lies in one coarse component
    edges = groups.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    coarse = ws.put(components(edges, ws, "coarse").select("node", F.col("root").alias("coarse")), "coarse")
    own = groups.groupBy("node").agg(F.collect_list("gid").alias("met"))
    placed = coarse.join(maybe(stands, coarse, "node").where("likely").drop("likely"), "node").join(own, "node")
    wide = coarse.join(stands.select("node", "size"), "node").groupBy("coarse").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / LOAD)).cast("int").alias("blocks"))
    placed = ws.put(placed.join(wide, "coarse").withColumn("root", F.col("node")).withColumn("side", F.lit(None).cast("int")), "placed")
    ws.drop("several", "groups", "stands")

    hashed = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = df.select(*_named(*hashed), hashed[1].alias("text"))
    deal = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")
    calls = max(64, 4 * placed.count() // BLOCK)  # small components share a call, of some hundreds of classes
    home = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("coarse"), F.lit(calls))).otherwise(F.col("coarse"))
    # a class is in one block only, so what its block joins it to is its root
    found = links(texts, placed, home, F.when(F.col("blocks") > 1, deal(0)).otherwise(-1))
    roots = ws.put(found.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots-0")
    for turn in (1, 2):
        # components of several blocks that are not joined: dealt anew, then each block against each other
        now = placed.where("blocks > 1").drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = now.groupBy("coarse").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("coarse")
        left = ws.put(now.join(apart, "coarse", "left_semi"), f"left-{turn}")
        if left.isEmpty():
            break
        if turn == 1:
            more = links(texts, left, F.col("coarse"), deal(1))
        else:
            left = left.withColumn("side", deal(0)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> side")
            more = links(texts, left, F.col("coarse"), F.least("side", "other"), F.greatest("side", "other"))
        # links of roots: those of classes in other components stay as they are
        more = components(more, ws, f"turn-{turn}").select(F.col("node").alias("above"), F.col("root").alias("to"))
        every = roots.unionByName(left.select("node", "root")).distinct()
        roots = ws.put(every.join(more, F.col("root") == F.col("above"), "left").select("node", F.coalesce("to", "root").alias("root")), f"roots-{turn}")
    return sets.select("id", "size", "class"), classes, roots


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: key, n_shingles, component_id (the least key reachable by links), kept (whether it is the row's own)."""
    ws = Workspace(df.sparkSession, "nearcopies")
    sets, classes, roots = class_components(df, ws, key, text)
    rooted = ws.put(classes.join(roots, "node", "left").select("class", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = ws.put(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id"), "named")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return sets.join(named, "class", "left").select(F.col("id").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: The same in DuckDB, by counting the shingles that classes share.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT DISTINCT r, array_to_string(words[i + 1 : i + 4], ' ') AS g FROM (SELECT r, words, unnest(range(0, greatest(1, len(words) - 3))) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT r, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS class FROM grams GROUP BY r
), classes AS (
  SELECT class, min(r) AS r, any_value(n) AS n FROM sizes GROUP BY class
), rare AS (
  SELECT g.r, g.g, c.n FROM grams g JOIN classes c ON c.r = g.r
), pairs AS (
  SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS inner_ FROM rare a JOIN rare b ON a.g = b.g AND a.r < b.r AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM pairs WHERE 100 * inner_ >= 80 * (nx + ny - inner_)
), both_ AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT r AS x, r AS y FROM classes UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON reach.y = both_.x
), least_ AS (
  SELECT c.r, min(s.doc_id) AS doc_id FROM classes c JOIN sizes z USING (class) JOIN split s ON s.r = z.r GROUP BY c.r
), named AS (
  SELECT reach.x AS r, min(least_.doc_id) AS component_id FROM reach JOIN least_ ON least_.r = reach.y GROUP BY reach.x
), found AS (
  SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(named.component_id, s.doc_id) AS component_id
  FROM split s LEFT JOIN sizes z USING (r) LEFT JOIN classes c ON c.class = z.class LEFT JOIN named ON named.r = c.r
)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found"""
