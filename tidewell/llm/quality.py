"""Quality rules: a decision list learned by sequential covering, applied as Spark conditionals.

Statistics of a document are DataFrame expressions on its whole text. The list is learned on the
driver from the statistics of a bounded sample of labelled documents (``SAMPLE`` rows, the first by a
hash of their doc_id): rules that reject are grown condition by condition on two thirds of the
sample, pruned on the rest, and kept while they are precise there. What comes out is an ordered chain
of when() expressions over the statistics.

Defined cases: a null text has no words. Every row gets one row of result, repeated or not. A
document without words fails the base rules. Without usable labels the list is empty and the base
rules alone decide. Labels of several rows of one doc_id must agree, else they are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
#: Of the documents that a rule rejects, so many must be labelled as bad, on the rows it was not grown on.
PRECISION = 0.95
#: A rule must reject so many labelled documents at least.
SUPPORT = 8
MOST_CONDITIONS, MOST_RULES = 4, 12

BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _dropped(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` (as the struct ``kept``) and the statistics of each row's text.

    Repeated three-word windows are found by sorting a document's window hashes with their places, in
    the row itself; documents whose windows all differ skip that.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), whole.alias("text"))
    df = df.withColumn("words", F.filter(F.split("text", BREAKS, -1), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("hashes", F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)).otherwise(none))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(repeats, placed))
    other = lambda k: F.get("placed", k)["h"]
    twice = F.transform("placed", lambda x, k: F.when((x["h"] == other(k - 1)) | (x["h"] == other(k + 1)), x["i"]))
    starts = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"))
    covered = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])
    stats = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _dropped(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        _dropped(F.col("text"), "!?").alias("n_marks"),
        _dropped(F.col("text"), "0123456789").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    # a generator is a fence: a filter on the statistics is not moved below it, into the lambdas
    return df.select("kept", F.inline(F.array(stats)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may compare with thresholds; all are defined for documents without words."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "marks": share("n_marks", "n_words"),
        "digits": share("n_digits", "word_chars"),
        "upper": share("n_upper", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest gain of information on the rows given."""
    p, n = int(bad.sum()), int((~bad).sum())
    before = np.log2(p / (p + n))
    found: tuple[float, Condition | None] = (0.0, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        p_low, n_low = np.cumsum(b)[cuts], np.cumsum(~b)[cuts]
        for above, ps, ns in ((False, p_low, n_low), (True, p - p_low, n - n_low)):
            gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - before), 0)
            k = int(gain.argmax())
            if gain[k] > found[0] + 1e-9:
                found = float(gain[k]), Condition(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray) -> list[Rule]:
    """Sequential covering: rules for ``bad`` rows, grown on the rows outside ``pruning``."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES:
        inside, rule = left & ~pruning, ()
        while len(rule) < MOST_CONDITIONS and bad[inside].any() and not bad[inside].all():
            _, c = _best({k: v[inside] for k, v in x.items()}, bad[inside])
            if c is None:
                break
            rule += (c,)
            inside &= c.holds(x)
        if not rule:
            break
        held, worth = left & pruning, []
        for size in range(1, len(rule) + 1):
            hit = held & _covers(rule[:size], x, len(bad))
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, -size))
        rule = rule[: -max(worth)[1]]
        hit = left & _covers(rule, x, len(bad))
        out = hit & pruning
        p, n = int((out & bad).sum()), int((out & ~bad).sum())
        if hit.sum() < SUPPORT or p + n == 0 or p / (p + n) < PRECISION or (hit & bad).sum() < PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Learns the list from the bounded sample; label 0 is bad."""
    rated = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y in (0, 1)")
    rated = rated.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    sample = rated.orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = with_statistics(docs.join(F.broadcast(sample), "k"), "t", ("k", "y")).where(~base_failed())
    got = rows.select("kept.y", F.pmod(F.xxhash64("kept.k", F.lit(1)), F.lit(3)).alias("part"), *[c.alias(f"f_{n}") for n, c in features().items()]).take(2 * SAMPLE)
    if not got:
        return []
    table = np.array([tuple(r) for r in got], float)
    table = table[np.lexsort(table.T)]  # the order of arrival has no say
    return learn({n: table[:, k + 2] for k, n in enumerate(features())}, table[:, 0] == 0, table[:, 1] == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1; 0: none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column()
        out = F.when(hit, number) if out is None else out.when(hit, number)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(df: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (the one that rejects, 0 for none) and ``kept`` of each row."""
    found = with_statistics(df, text, (key,)).withColumn("rule", verdict(rules)).withColumn("base_failed", base_failed())
    return found.select(F.col("kept")[key].alias(key), *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def accepted(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of df that neither the base rules nor the list reject, columns as they were."""
    found = with_statistics(df, text, tuple(df.columns)).where(~base_failed() & (verdict(rules) == 0))
    return found.select(*[F.col("kept")[c].alias(c) for c in df.columns])
