import random

from oracle import connect, rows

from tidewell.llm import credentials

KEY, ID = "aB3" * 14, "AKIA" + "Z9" * 8
PATH = "Articles/2023/TheLongTitleOfTheArticleHere"
URL = f"https://example.org/{PATH}"


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in credentials.digest(df).collect()}


def test_an_url_does_not_confirm_itself(spark):
    texts = [f"see {URL} for more", f"{URL} {URL}", f"{URL}?key={KEY} or {KEY[:-1]}", f"{KEY} {URL}", f"{URL} {KEY}", f"{URL} {ID}", f"https://h.example/{'a' * 3}?token=abcdefgh12345 there"]
    got = spans_of(spark, texts)
    n = len(URL)
    assert got[0] == got[1] == ""
    assert "endpoint" in got[2] and got[2].count("mixed") == 1  # the run that stands for itself, not those inside the address
    assert got[3] == f"mixed:0:{len(KEY)},endpoint:{len(KEY) + 1}:{len(KEY) + 1 + n}"
    assert got[4] == f"endpoint:0:{n},mixed:{n + 1}:{n + 1 + len(KEY)}"
    assert got[5] == f"access:{n + 1}:{n + 1 + len(ID)}"  # no run inside the address is taken for the secret of the identifier
    assert got[6].startswith("assign:") and "endpoint" not in got[6]  # an assignment inside an address does not confirm it


def test_plain_addresses_stay_in_the_text(spark):
    texts = [f"see {URL} for more", f"Read http://docs.example.com/{PATH}/Part2#Section4, then {URL}."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in credentials.redact(df).collect()} == dict(enumerate(texts))


def test_mixtures_as_sql(spark, tmp_path):
    rng = random.Random(6)
    parts = [URL, KEY, ID, "login: bob", "password: opensesame", f"http://x.example/{KEY}", "0123456789abcdef01234567", "words " * 30, "é🚀"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(300)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    df = credentials.digest(spark.read.parquet(str(tmp_path / "documents.parquet")))
    result = connect(str(tmp_path)).execute(credentials.ORACLE_SQL)
    columns = [d[0] for d in result.description]
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, result.fetchall())
