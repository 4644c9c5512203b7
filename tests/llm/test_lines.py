import hashlib
import random
import re

from tidewell.llm import lines
from tidewell.llm.workspace import documents

WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """rows: (id, text), ids distinct."""
    every = sorted({x for _, t in rows for x in (t or "").split("\n") if WORD.search(x)})
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in every]
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(every)), key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if 75 * len(sets[j]) > 100 * len(sets[i]):
                break
            if sets[i] and find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp = {x: find(i) for i, x in enumerate(every)}
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, n = [], 0
        for x in (t or "").split("\n"):
            if x in comp:
                if comp[x] in seen:
                    n += 1
                    continue
                seen.add(comp[x])
            kept.append(x)
        out.append((k, n, "\n".join(kept)))
    return out


def make():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6)))
    pool = [[word() for _ in range(rng.randint(1, 40))] for _ in range(60)]
    rows = [(None, "first line of all, null id\nshort"), (0, None), (1, ""), (2, "\n \n\t\n"), (3, "short\nshort\nx")]
    for n in range(4, 90):
        text = []
        for _ in range(rng.randint(1, 8)):
            line = list(rng.choice(pool))
            if rng.random() < 0.5 and len(line) > 15:
                line[rng.randrange(len(line))] = word()
            text.append(" ".join(line) if rng.random() < 0.9 else "")
        rows.append((n, "\n".join(text)))
    return rows


def test_as_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(k, t, "é", 1) for k, t in rows], "doc_id long, text string, h string, place int")
    out = lines.dedup(df)
    assert out.columns == [*df.columns, "n_removed_lines"] and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    want = brute(rows)
    same = sum((got[k].n_removed_lines, got[k].text or "") == (n, t) for k, n, t in want)
    assert same >= 0.98 * len(want), [(got[k].n_removed_lines, n, k) for k, n, t in want if (got[k].text or "") != t]
    assert got[0].text is None and got[1].text == "" and got[2].text == "\n \n\t\n" and got[3].text == "x"
    short = {r.doc_id: r for r in lines.digest(df).collect()}
    assert all(short[k].kept_sha256 == hashlib.sha256((got[k].text or "").encode()).hexdigest() for k, _ in rows)
    assert lines.dedup(df.limit(0)).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one line here"), (1, "one line here"), (2, "one line here\nanother")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup(df).collect()) == [(1, "one line here"), (1, "one line here"), (2, "another")]


def test_recall_on_the_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    want = {k: (n, t) for k, n, t in brute([(r.doc_id, r.text) for r in docs.collect()])}
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in lines.dedup(docs).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_recall_of_lines_that_go(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {k: n for k, n, _ in brute(rows)}
    got = {r.doc_id: r.n_removed_lines for r in lines.dedup(docs).collect()}
    assert sum(min(got[k], want[k]) for k in want) >= 0.97 * sum(want.values())
    assert sum(max(0, got[k] - want[k]) for k in want) <= 0.01 * sum(want.values())


def test_unbroken_and_strange(spark):
    """A megabyte without a space, columns with dots and maps, scripts without spaces."""
    rng = random.Random(2)
    long = "".join(rng.choice("aB3") for _ in range(1_000_000))
    rows = [(1, long, {"a": 1}), (2, long[:-1], {}), (3, "x", None), (4, "今天天气很好我们一起去公园散步看花吧" * 3, {}), (5, "今天天气很好我们一起去公园散步看花吧" * 3 + "呢", {}), (6, "\U0001f600" * 30 + "ab", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string, int>")
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert got == {1: long, 2: "", 3: "x", 4: rows[3][1], 5: "", 6: rows[5][1]}


def test_large_group(spark):
    """Hundreds of near copies of one line, and hundreds that only share half with it."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    texts = [" ".join(base)]
    for n in range(600):
        other = list(base)
        for k in rng.sample(range(30), 1 if n % 2 else 12):
            other[k] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    want = {k: n for k, n, _ in brute(list(enumerate(texts)))}
    got = {r.doc_id: r.n_removed_lines for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want) and sum(want.values()) >= 300
