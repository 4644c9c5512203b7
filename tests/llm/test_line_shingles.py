import random

from test_lines import WORD

from tidewell.llm import lines


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.dedup(df).collect()}


def test_one_typo_is_a_duplicate(spark):
    first = "please read the terms of use of this site before you order a book"
    got = kept(spark, [first, first.replace("order", "ordfr"), first.replace("site", "page")])
    assert got == {0: first, 1: "", 2: ""}


def test_equal_beginnings_are_no_duplicates(spark):
    links = [f"https://www.{x}" for x in ("apple.example/fruit", "zebra.example/animals", "quartz.example/stones")]
    chinese = ["今天天气很好我们一起去公园散步看花吧", "今天天气很好我们一起去图书馆读新出的小说"]
    numbered = ["Introduction to the old maps", "Introduction 27"]
    texts = links + chinese + numbered
    assert kept(spark, texts) == dict(enumerate(texts))


def test_as_brute_force_at_every_offset(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    pool = [[word() for _ in range(rng.randint(6, 30))] for _ in range(150)]
    every = []
    for line in pool:
        every.append(" ".join(line))
        for _ in range(rng.randint(0, 3)):
            other = list(line)
            other[rng.randrange(len(other))] = word()
            every.append(" ".join(other))
    every = [x for x in dict.fromkeys(every) if WORD.search(x)]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in every]
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: x if find(i) == i else "" for i, x in enumerate(every)}
    got = kept(spark, every)
    gone = [i for i in want if not want[i]]
    assert len(gone) > 100
    assert all(got[i] == want[i] for i in want if want[i])
    assert sum(not got[i] for i in gone) >= 0.95 * len(gone), sum(not got[i] for i in gone) / len(gone)
