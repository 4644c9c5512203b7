import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import toxicity
from tidewell.llm.workspace import documents

TERMS = ["idiot", "scum", "worthless", "disgusting", "clown"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("adlnostx-")), max_size=3))
def test_automaton_and_trie_as_brute_force(term, edits):
    word = term
    for at, c in edits:
        word = word[:at] + word[at + 1 :] if c == "-" else word[:at] + c + word[at + (at % 2) :]
    trie = toxicity.Trie()
    for t in TERMS:
        trie.add(t)
    near = [(d, t) for t in TERMS if (d := distance(word, t)) <= toxicity.tolerance(len(t)) and d > 0]
    if word in TERMS:
        return
    assert trie.near(word) == (min(near)[1] if near and min(near)[0] > 0 and toxicity.tolerance(len(min(near)[1])) else None)


def test_quotation():
    m = toxicity.Matcher(TERMS, [])
    direct = toxicity.measure(m, "you are an idiot and a clown of a man")
    told = toxicity.measure(m, 'the report lists "idiot" and "clown" as examples of abuse')
    assert direct[3] > told[3] > 0
    assert toxicity.measure(m, "what an 1diot, a cloown, scumm") [2] > 0
    assert toxicity.measure(m, "") == [0.0] * len(toxicity.FEATURES)


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    right = wrong = missed = 0
    for r in labels.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.7)
        if g.held_out:
            right += g.predicted and r.toxic
            wrong += g.predicted and not r.toxic
            missed += r.toxic and not g.predicted
    assert right >= 0.9 * (right + missed) and right >= 0.95 * (right + wrong), (right, wrong, missed)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "you idiot", 1), (2, "", 1)], "doc_id long, text string, score int")
    none = toxicity.fit(df, spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert none.terms == [] and [r.score for r in toxicity.score(df, none).collect()] == [0.0] * 4
    model = toxicity.Model(["idiot"], [], [3.0, 3.0, 1.0, 1.0, 1.0, -2.5])
    assert sorted((r.doc_id or 0, r.predicted) for r in toxicity.score(df, model).collect()) == [(0, 1), (1, 0), (2, 0), (2, 0)]
    assert toxicity.score(df.limit(0), model).collect() == []


def test_planted_and_unseen_misspellings(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    filler = "the and attion to thanedble anea eriner and that therere is of ering in an honand " * 4
    rows = [(1, filler), (2, filler + "idiot moron scum"), (3, filler + "1diot mmoron worthles"), (4, filler + "IDIOT! pathetic, stupid."), (5, "")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[2] > 0.9 and got[4] > 0.9 and got[3] > got[1] and got[1] < 0.3 and got[5] < 0.3
    print(model.weights, model.exempt[:40], model.terms[:20], model.stems, got)
