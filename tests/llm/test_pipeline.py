import corpus_pipeline
from test_credentials import base
from test_lines import brute as line_brute
from test_packing import packing
from test_quality import brute as quality_brute
from test_setjoin import brute as set_brute

from tidewell.llm import quality
from tidewell.llm.workspace import documents

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs, kept = documents(spark, SF), []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, docs, SF).cache())
        docs = kept[-1]
    rules, lines, groups, secrets, packed = kept
    for df in kept[:-1]:
        assert df.columns == documents(spark, SF).columns
    before = {r.doc_id: r for r in documents(spark, SF).collect()}

    learned = quality.fit(documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id: r.kept for r in quality.judge(documents(spark, SF), learned).collect()}
    ruled = {r.doc_id: r for r in rules.collect()}
    assert set(ruled) == {k for k in before if judged[k]} and not any(quality_brute(r.text)[5] for r in ruled.values())

    lined = {r.doc_id: r for r in lines.collect()}
    want = {k: t for k, _, t in line_brute([(k, r.text) for k, r in ruled.items()])}
    assert {k for k in want if want[k].split()} <= set(lined) <= set(ruled) and all(r.text.split() for r in lined.values())
    assert sum(lined[k].text == want[k] for k in lined) >= 0.98 * len(lined) and len(lined) < len(ruled)

    grouped = {r.doc_id: r for r in groups.collect()}
    assert set(grouped) == {c for _, _, c in set_brute([(k, r.text) for k, r in lined.items()])}

    masked = {r.doc_id: r for r in secrets.collect()}
    assert set(masked) == set(grouped)
    for k, r in masked.items():
        assert r.n_chars == len(r.text) and (("[secret]" in r.text) >= bool(base(grouped[k].text)))
        for a, _, b in base(grouped[k].text):
            assert grouped[k].text[a:b] not in r.text

    rows = packed.collect()
    assert sorted(r.doc_id for r in rows) == sorted(masked) and min(r.n_tokens for r in rows) > 0
    assert all(r.n_tokens == len(masked[r.doc_id].text.encode().split()) <= r.bucket_len for r in rows)
    used = {}
    for r in rows:
        used[r.batch_id] = used.get(r.batch_id, 0) + r.bucket_len
    assert all(v <= packing.BUDGET for v in used.values())


def test_odd_rows(spark):
    """Null texts, rows that share doc_id or both, clashing and dotted names, maps, and an empty table."""
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(1, text, 1, {"a": 1}, 5), (1, text, 2, {}, 6), (1, text.replace("word", "other"), 3, None, 7), (2, text + " more", 4, {}, 8), (3, None, 5, {}, 9), (None, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, `a.b` map<string, int>, row0 int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "n-gram Jaccard join":
            assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in out.collect()) == [(0, ""), (1, "other"), (1, "word0"), (3, "")]
        elif name == "line dedup":  # null and empty texts have no word; the only line of 2 is similar to one of 1
            assert sorted((r.doc_id, r.text[:5]) for r in out.collect()) == [(1, "other"), (1, "word0"), (1, "word0")], name
        else:
            assert out.count() == len(rows), name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
