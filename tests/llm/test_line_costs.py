import random

from tidewell.llm import lines

TEXTS = ["please read the terms of use of this site\nanother line", "please read the terms of use of this site", " \n\x0b\n\t\x0c\r", "ä 😀 " * 9, None, ""]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_packed_signatures_hold_32_bits_of_each_hash(spark):
    signed = lines.signed(lines._keyed(docs(spark), "doc_id", "text"), lines.LENGTH)
    want = {(r.h, r.width): [r[f"m{n}"] % 2**32 for n in range(lines.HASHES)] for r in signed.collect()}
    packed = lines._packed(signed).collect()
    assert len(packed) == len(want) >= 3
    for r in packed:
        halves = [half for n in range(lines.HASHES // 2) for half in (r[f"p{n}"] % 2**64 >> 32, r[f"p{n}"] % 2**32)]
        assert halves == want[r.h, r.width]


def test_texts_are_split_after_the_join(spark):
    """Before it the lines would be sent beside their text."""
    plan = lines.dedup(docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("split(") < plan.find("Join LeftOuter, (doc#")


def test_lines_are_counted_in_what_is_left(spark):
    got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in lines.digest(docs(spark)).collect()}
    assert got == {0: (2, 0), 1: (1, 1), 2: (0, 0), 3: (1, 0), 4: (0, 0), 5: (0, 0)}


def test_parts_have_no_pairs_that_are_joined_already(spark, monkeypatch):
    """Pairs of one component are left out before their signatures are read."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = some(60)
    alike = [base + some(40) for _ in range(60)]
    texts = [f"{x}\n{x}ij\n{x}kl" for x in alike]
    put, tables = lines.Workspace.put, {}

    def kept(ws, df, name):
        out = put(ws, df, name)
        if name in ("roots-0", "parts", "star-1"):
            tables[name] = [tuple(r) for r in out.select(*{"roots-0": ["node", "root"], "parts": ["key", "h"], "star-1": ["a", "b"]}[name]).collect()]
        return out

    monkeypatch.setattr(lines.Workspace, "put", kept)
    lines.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    root, groups = dict(tables["roots-0"]), {}
    for key, h in tables["parts"]:
        groups.setdefault(key, set()).add(root.get(h, h))
    assert groups and all(len(x) > 1 for x in groups.values())
    assert all(root.get(a, a) != root.get(b, b) for a, b in tables["star-1"])


def test_only_texts_of_pairs_are_sent(spark, monkeypatch):
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdé ") for _ in range(30)) for _ in range(400)]
    some += [some[0] + "f", some[0].replace("é", "e") + "f"]
    texts = spark.createDataFrame(list(enumerate(some)), "h long, line string")
    want = {(0, b) for b in (1, 400, 401) if (lambda x, y: len(x & y) * 100 >= 75 * len(x | y))(*({some[i][k : k + 5] for k in range(len(some[i]) - 4)} for i in (0, b)))}
    met, sent = lines._met, []

    def counted(rows, table, on, how="inner"):
        sent.append(table.count())
        return met(rows, table, on, how)

    monkeypatch.setattr(lines, "_met", counted)
    got = lines._verified(spark.createDataFrame([(0, 1), (0, 400), (0, 401)], "a long, b long"), texts, 5).collect()
    assert {tuple(r) for r in got} == want and (0, 400) in want and (0, 1) not in want
    assert len(sent) == 2 and max(sent) < 40


def test_ranks_are_by_company_and_then_by_the_least_hash(spark):
    rows = [(5, 2), (5, 3), (-7, 5), (9, 4), (2**63 - 1, 2**40), (-(2**63), 1)]
    rank = {r.h: r["rank"] for r in lines._company(spark.createDataFrame(rows, "h long, n long")).collect()}
    assert sorted(rank, key=rank.get) == [-(2**63), 9, 5, -7, 2**63 - 1]


def test_lines_that_come_once_are_not_sent_for_their_root(spark, monkeypatch):
    rng = random.Random(6)
    some = ["".join(rng.choice("abcdefghij ") for _ in range(40)) for _ in range(400)]
    texts = [*some, some[0], some[1] + "k"]
    met, sent = lines._met, []

    def counted(rows, table, on, how="inner"):
        if how == "left" and table.columns == ["h", "root"]:
            sent.append(rows.count())
        return met(rows, table, on, how)

    monkeypatch.setattr(lines, "_met", counted)
    out = lines.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id for r in out.where("n_removed_lines > 0").collect()} == {400, 401}
    assert 3 <= sent[-1] < 60


def test_signatures_are_of_every_offset_and_a_piece_is_what_is_copied(spark):
    rng = random.Random(9)
    sizes = [1, 4, 5, 6, 15, 16, 24, 25, *(lines.PIECE * k + d for k in (1, 2) for d in range(-2, 16))]
    every = ["".join(rng.choice("abcé😀") for _ in range(n)) for n in sizes]
    signed = lines.signed(lines._keyed(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), "doc_id", "text"), 5)
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "explode(sequence(begin" in x] and not [x for x in plan.split("\n") if "explode(sequence(begin" in x and "raw" in x]
    runs = [(x, w, x[i : i + w].encode("utf-32-be")) for x in every for w in (5, 7) if (w == 5 and len(x) <= 24) or (w == 7 and len(x) >= 16) for i in range(max(1, len(x) - w + 1))]
    table = spark.createDataFrame(runs, "line string, width int, run binary").selectExpr("xxhash64(line) h", "width", "xxhash64(run) x")
    least = ", ".join(f"min(x ^ {(n + 1) * 0x9E3779B97F4A7C15 % 2**63}) m{n}" for n in range(lines.HASHES))
    want = {tuple(r) for r in spark.sql(f"select h, width, {least} from {{t}} group by h, width", t=table).collect()}
    assert {tuple(r) for r in signed.drop("n", "spot").collect()} == want
