import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from oracle import compare

from tidewell.llm import filteraudit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    good, bad = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[t or ""].append(i)
    parts = defaultdict(list)
    for i, t, s in rows:
        t, w = t or "", WORD.findall(t or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(o is not None and o < i for o in texts[t])
        parts[s or ""].append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        rows_of_part = []
        for order in permutations("ABCDE"):
            alive = list(docs)
            for step, f in enumerate(order, 1):
                hit = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                shapley[f] += len(hit)
                rows_of_part.append((part, "".join(order), step, len(alive), len(hit), sum(f in d[1] for d in docs) - len(hit), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in hit), sum(d[0] in bad for d in hit)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_of_part]
    return sorted(out)


def rows_of():
    long = " ".join(f"w{k}" for k in range(250))
    half = " ".join(f"w{k % 99}" for k in range(200))
    edge = " ".join(f"w{k % 100}" for k in range(200))
    texts = [None, "", " \n\t ", "a", long, long, long, half, edge, long.upper(), long + " #", "é" * 98 + "AB", "é" * 97 + "AB", " ".join(f"w{k}" for k in range(199)), " ".join(f"w{k}" for k in range(200)), half + "$" + "A" * 200]
    rows = [(n, t, [None, "", "x", "y"][n % 4]) for n, t in enumerate(texts * 2)]
    return [*rows, (3, "a", "x"), (4, long, "z"), (None, long, "z"), (None, None, None), (100, "x" * 3_000_000, "z"), (101, "y " * 500_000, "z")]


LABELS = [(n, n % 2, int(n % 3 == 0)) for n in range(0, 30)] + [(4, 1, 1), (5, None, None), (None, 1, 1)]


def test_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as failed", "2 as `id`", "3 as `a.b`", "4 as part", "5 as digest")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "7 as good", "8 as n")
    got = filteraudit.audit(df, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = brute(rows, LABELS)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 600 * 4


def test_repeated_rows_and_no_labels(spark):
    rows = [(7, "b " * 300, "s")] * 5 + [(8, "b " * 300, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = filteraudit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute(rows, [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filteraudit.audit(df, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect() == []


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "a", None)], "`k.1` long, `t.x` string, `s.y` string")
    labels = spark.createDataFrame([(2, 1, 0)], "`k.1` long, quality int, toxic int")
    got = filteraudit.audit(df, labels, key="k.1", text="t.x", part="s.y")
    assert sorted(map(tuple, got.collect())) == brute([(1, "a", "s"), (2, "a", None)], [(2, 1, 0)])


def test_lattice():
    assert len(filteraudit.edges(5)) == 80 and len(filteraudit.steps("ABCDE")) == 600
    assert sum(w for _, _, w in filteraudit.edges(5)) == 600


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_as_sql(spark, sf):
    assert compare(spark, queries.op11_filteraudit, filteraudit.ORACLE_SQL, f"/root/testdata/sf{sf}") == 600 * 20
