import hashlib
import re

from oracle import compare

from tidewell.llm import credentials
from tidewell.llm.workspace import documents

ASSIGN = re.compile(credentials.KINDS[0].pattern)
HEXES = re.compile("[0-9a-f]+")
ACCESS = re.compile("AKIA[A-Z0-9]+")


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEXES.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


ID, KEY = "AKIA" + "Z9" * 8, "aB3" * 14
TEXTS = [
    None,
    "",
    "nothing here",
    "é🚀 password = 'hunter22' and token=abc, token=token:abcdefg",
    f"AKIAAKIA {ID} x AKIA{'A' * 15} 0123456789abcdef01234567 " + "0123456789abcdef" * 2,
    "api_key:" + "f" * 30,
    f"{KEY} alone",
    f"{ID} then {KEY}",
    f"{ID} {'far ' * 200} {KEY}",
    "login: bob and https://db.example.com/x",
    "login: bob, password: opensesame at https://db.example.com/x",
    "secret=abcdef " * 300,
]


def rows():
    return [(n, t) for n, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "token=abcdef")]


def test_base_spans(spark):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows()], "doc_id long, text string, kind int, spans string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in credentials.digest(df).collect())
    want = []
    for k, t in rows():
        s = base(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in s)
        want.append((k is not None, k or 0, *(sum(x[1] == n for x in s) for n in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert credentials.digest(df.limit(0)).collect() == []


def test_weak_parts_need_their_complement(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in credentials.digest(df).collect()}
    assert spans[6] == ""
    assert spans[7] == f"access:0:20,mixed:26:{26 + len(KEY)}"
    assert "mixed" not in spans[8] and "access" in spans[8]
    assert spans[9] == ""
    assert [s.split(":")[0] for s in spans[10].split(",")] == ["account", "assign", "endpoint"]


def test_redact(spark):
    df = spark.createDataFrame([(n, t, "é") for n, t in rows()], "doc_id long, text string, start string")
    out = credentials.redact(df)
    assert out.columns == df.columns and out.count() == len(rows())
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[2] == "nothing here" and texts[1] == ""
    assert texts[7] == "[secret] then [secret]"
    assert "hunter22" not in texts[3] and texts[3].startswith("é🚀 [secret]")
    assert texts[11] == "[secret] " * 300


def test_long_runs_and_odd_names(spark):
    run = "aB" * 500_000
    rows = [(1, run, {"x": 1}, 7), (2, f"{ID} {run}3", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string, int>, spans int")
    got = {r.doc_id: r for r in credentials.redact(df).collect()}
    assert got[1].text == run and got[2].text == "[secret] [secret]" and got[1]["a.b"] == {"x": 1} and got[2].spans == 8


def test_as_sql(spark):
    assert compare(spark, lambda s, d: credentials.digest(documents(s, d)), credentials.ORACLE_SQL, "/root/testdata/sf0.01") == 1000
