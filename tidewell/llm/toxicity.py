"""Toxicity by a learned lexicon, matched through Levenshtein automata.

The lexicon (terms, and stems that begin several of them) is learned from a bounded sample of
labelled rows. Its terms form a trie; the Levenshtein automaton of a word walks the trie, one row of
distances for each letter, and leaves a branch once no distance in the row is small enough. So
misspelled terms are found without listing their variants. Each hit gets a score from the words
around it: hits within quotation marks, or after a word of reporting, weigh less than direct ones.
A small logistic model turns the sums of a document into a score.

Defined cases: a null or empty text has no hits and gets the score of that. Every row gets a row of
result. Labels of several rows of one doc_id must agree, else they are not used. Without toxic
labels the lexicon is empty and all scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.workspace import Workspace

#: Labelled rows learned from, at most: the first by a hash of their doc_id.
SAMPLE = 20_000
#: Terms and stems of a lexicon, at most of each: the strongest.
TERMS, STEMS = 4096, 256
#: Toxic documents a term must be in (and their share), and how much likelier it must be there (as a log).
LEAST, SHARE, ODDS = 4, 0.01, 3.0
#: Distinct words that make a beginning a stem; letters of a stem.
BEGUN, STEM_LETTERS = 4, (4, 5, 6)
#: Words on either side that tell quotation from abuse, and what a quoted hit counts.
WINDOW, QUOTED = 6, 0.25
THRESHOLD = 0.7
#: Words a worker remembers.
REMEMBERED = 500_000

QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says quote quoted quotes quoting called word words term terms wrote".split())
EDGE = ".,;:!?()[]{}<>|#*$%&'`~-_=+/\\" + QUOTES
LOOKALIKE = str.maketrans("013457@$", "oieastas")

EXACT, STEM, FUZZY = 1, 2, 3


def normal(word: str) -> str:
    return word.strip(EDGE).lower()


def tolerance(letters: int) -> int:
    """Edits allowed for a term of so many letters."""
    return 0 if letters < 5 else 1 if letters < 9 else 2


@dataclass
class Trie:
    """Terms, for the intersection with a word's automaton."""

    root: dict = field(default_factory=dict)
    patterns: list[str] = field(default_factory=list)
    likely: re.Pattern | None = None

    def add(self, term: str) -> None:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
        edits = tolerance(len(term))
        if edits:  # with so many edits, one of edits + 1 parts stands unchanged, at most so many places off
            cuts = [len(term) * k // (edits + 1) for k in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                after = len(term) - b
                self.patterns.append(f".{{{max(0, a - edits)},{a + edits}}}{re.escape(term[a:b])}.{{{max(0, after - edits)},{after + edits}}}")
            self.likely = None

    def near(self, word: str) -> str | None:
        """A term within its tolerance of word; the nearest, of equals the first by alphabet."""
        if self.likely is None:
            self.likely = re.compile("|".join(self.patterns) or "(?!)", re.DOTALL)
        if not self.likely.fullmatch(word):
            return None
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)), "")]
        while stack:
            node, row, letter = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= tolerance(len(child)) and (best is None or (row[-1], child) < best):
                        best = row[-1], child
                    continue
                new = [row[0] + 1]
                for i, w in enumerate(word):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (w != c)))
                if min(new) <= 2:
                    stack.append((child, new, c))
        return best[1] if best else None


class Matcher:
    """Words to kinds of hit, remembered. ``exempt``: words near a term that clean documents use."""

    def __init__(self, terms: list[str], stems: list[str], exempt: Iterable[str] = ()) -> None:
        self.terms, self.stems, self.trie, self.exempt = frozenset(terms), frozenset(stems), Trie(), frozenset(exempt)
        for t in terms:
            if not any(t.startswith(x) for x in stems):  # the stem finds those, whatever follows it
                self.trie.add(t)
        self.longest = max((len(t) + tolerance(len(t)) for t in self.terms), default=0)  # a longer word is near no term
        self.seen: dict[str, int] = {}

    def kind(self, raw: str) -> int:
        word = normal(raw)
        if not word or not self.terms:
            return 0
        if word in self.terms:
            return EXACT
        if any(word[:n] in self.stems for n in STEM_LETTERS):
            return STEM
        plain = word.translate(LOOKALIKE)
        if plain in self.terms:
            return FUZZY
        if 4 <= len(plain) <= self.longest and word not in self.exempt and self.trie.near(plain):
            return FUZZY
        return 0

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        """(place, kind) of each hit."""
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = self.kind(w)
        return [(i, k) for i, k in enumerate([seen[w] for w in words]) if k]


def quoted(words: list[str], place: int) -> bool:
    """Whether quotation marks open before and close after a place, or reporting leads to it."""
    before, after = words[max(0, place - WINDOW) : place], words[place + 1 : place + 1 + WINDOW]
    own = words[place]
    opens = own[0] in QUOTES or any(w[0] in QUOTES for w in before if w)
    closes = own.rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    return (opens and closes) or any(normal(w) in REPORTING for w in before[-2:])


FEATURES = ["exact", "stem", "fuzzy", "abuse", "density"]


def measure(matcher: Matcher, text: str) -> list[float]:
    """What the model sees of a text; zeros where nothing hits."""
    words = text.split()
    found = matcher.hits(words)
    if not found:
        return [0.0] * len(FEATURES)
    weight, sums = 0.0, [0.0, 0.0, 0.0]
    for place, kind in found:
        w = QUOTED if quoted(words, place) else 1.0
        sums[kind - 1] += w
        weight += w if kind != FUZZY else w / 2
    return [*[float(np.log1p(s)) for s in sums], float(np.log1p(weight)), float(min(1.0, 10 * weight / len(words)))]


@dataclass(frozen=True)
class Model:
    terms: list[str]
    stems: list[str]
    weights: list[float]  # of FEATURES, then the constant
    exempt: tuple[str, ...] = ()

    def score(self, x: list[float]) -> float:
        if not self.terms:
            return 0.0
        z = self.weights[-1] + sum(w * v for w, v in zip(self.weights, x))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> list[float]:
    """Weights and constant by Newton's method; weights of hits are kept from falling below 0."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.array([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + penalty * w), -4, 4)
        w[:-1] = np.maximum(w[:-1], 0)
    return w.tolist()


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Terms and stems out of (word, toxic documents, clean documents); ``*`` ends a beginning."""
    if not toxic:
        return [], []
    ranked = []
    for word, t, c in counts:
        odds = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if t >= max(LEAST, SHARE * toxic) and odds >= ODDS:
            ranked.append((-odds * np.sqrt(t), word))
    ranked.sort()
    words = [w for _, w in ranked if not w.endswith("*")]
    begun = Counter(w[:n] for w in words for n in STEM_LETTERS if len(w) > n)
    stems = [w[:-1] for _, w in ranked if w.endswith("*") and begun[w[:-1]] >= BEGUN]
    stems = sorted(stems, key=len)
    kept: list[str] = []
    for s in stems:  # the shortest that will do
        if not any(s.startswith(k) for k in kept):
            kept.append(s)
    return [w for w in words if len(w) >= 3][:TERMS], kept[:STEMS]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(3)) == 1


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the rows that are not held out.

    The lexicon's terms are found on two thirds of the sample and the model's weights on the rest, so
    that a term's hits are weighed where they were not chosen; then terms are found on all of it.
    """
    rated = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    rated = rated.groupBy("k").agg(F.min("y").cast("int").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    sample = rated.orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    part = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(3)).cast("int")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").select("k", F.coalesce("t", F.lit("")).alias("t"), "y", part.alias("part"))
    # copies of one document would make terms of all its words: of those with the same least words one counts
    hashes = F.transform(F.split(F.lower("t"), r"\s+"), lambda w: F.xxhash64(w))
    rows = rows.withColumn("least", F.slice(F.sort_array(F.array_distinct(hashes)), 1, 2)).groupBy("least", "y")
    rows = rows.agg(F.min_by(F.struct("t", "part"), F.struct("k", F.xxhash64("t"))).alias("one")).select("one.t", "y", "one.part")
    rows = Workspace(df.sparkSession, "toxicity").put(rows, "sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for t, y, third in zip(*(c.to_pylist() for c in batch.columns)):
                found = {w for raw in set(t.split()) if len(w := normal(raw)) >= 3}
                found |= {w[:n] + "*" for w in found for n in STEM_LETTERS if len(w) > n}
                sums.update((w, y, third > 0) for w in found)
                sums[" ", y, third > 0] += 1
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([sums[k] for k in keys], pa.int64())], ["w", "y", "first", "n"])

    tall = rows.mapInArrow(words, "w string, y int, first boolean, n bigint").groupBy("w").agg(
        *[F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name) for name, cond in (("t1", "y = 1 and first"), ("c1", "y = 0 and first"), ("t", "y = 1"), ("c", "y = 0")) for cond in [F.expr(cond)]]
    )
    # only words that pass can be collected: at most as many as LEAST toxic documents of the sample have
    likely = (F.col("w") == " ") | ((F.col("t") >= LEAST) & (F.col("t") * 4 >= F.col("c")))
    got = {r.w: r for r in tall.where(likely).collect()}
    total = got.pop(" ", None)
    if total is None or not total.t or not total.t1:
        return Model([], [], [0.0] * (len(FEATURES) + 1))
    first = lexicon([(w, r.t1, r.c1) for w, r in sorted(got.items())], total.t1, total.c1)
    final = lexicon([(w, r.t, r.c) for w, r in sorted(got.items())], total.t, total.c)

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, found = Matcher(*final), set()
        for batch in batches:
            for t, y, third in zip(*(c.to_pylist() for c in batch.columns)):
                if not y:
                    words = t.split()
                    found |= {(normal(words[i]), third > 0) for i, kind in matcher.hits(words) if kind == FUZZY}
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())], ["w", "first"])

    # bounded by the variants of TERMS terms
    clean = rows.mapInArrow(misspelled, "w string, first boolean").groupBy("w").agg(F.max("first")).collect()
    exempt = tuple(sorted(w for w, _ in clean))
    exempt_first = [w for w, f in clean if f]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*first, exempt_first)
        for batch in batches:
            found = [(*measure(matcher, t), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in range(len(FEATURES) + 1)], [*FEATURES, "y"])

    table = np.array([tuple(r) for r in rows.where("part = 0").mapInArrow(rest, ", ".join(f"{c} double" for c in [*FEATURES, "y"])).collect()], float)
    if not len(table) or not table[:, -1].any():
        return Model(*final, [2.0, 2.0, 0.5, 1.0, 0.0, -2.0], exempt)
    table = table[np.lexsort(table.T)]
    return Model(*final, logistic(table[:, :-1], table[:, -1]), exempt)


_matchers: dict[int, tuple[Model, Matcher]] = {}


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of df: key, held_out, score, predicted, and the hits it rests on."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms and STEMS stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if id(own) not in _matchers:
            _matchers.clear()
            _matchers[id(own)] = own, Matcher(own.terms, own.stems, own.exempt)
        matcher = _matchers[id(own)][1]
        for batch in batches:
            x = [measure(matcher, t) for t in batch.column(2).to_pylist()]
            scores = [own.score(v) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([v[3] for v in x], pa.float64())], ["k", "held_out", "score", "predicted", "abuse"])

    rows = df.select(F.col(key).alias("k"), held_out(F.col(key)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, held_out boolean, score double, predicted int, abuse double").withColumnRenamed("k", key)
