"""Fuzzy line dedup by MinHash, in DataFrame functions only.

The shingles of a line are its runs of ``LENGTH`` characters, from every character on; two lines are
similar if the Jaccard similarity of these sets is at least ``SHARE``. Candidates come from signatures:
the least values of ``HASHES`` hash functions over the line's runs of ``GRAM`` characters, of every
offset (of short lines over their shingles). Each three hashes of ``BANDS`` make a band; lines that
share a band are a group.

Groups are linked without listing their pairs. In each group every line is compared exactly with one
pivot, the line that has most company in all its groups. Groups whose lines are in one component by
then are done, however large. The others are split by one more hash of the signature, in turn by each of
four that the band has not, and every line meets the pivots of its parts: those lack the pivot that it is
unlike. So the work
is in proportion to the lines, also in a group of thousands of near copies; two similar lines are missed if
neither meets the other or a line of its component as a pivot (tests measure how many).
Components are found by distributed star rounds. Of each component the first line, by (doc_id, place),
stays; all other occurrences go, those of equal lines included.

Lines are known by a 64-bit hash. Texts of candidates are read again, of one occurrence each.

Defined cases: a null text stays null and has no lines. Lines without a word are no lines: they are
neither compared nor removed. A line shorter than a shingle only equals itself. Rows of one doc_id
and text are treated alike. Null doc_ids come first. Other columns, of any name and type, are carried
along. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.substrings import maybe
from tidewell.llm.workspace import Workspace

LENGTH = 5
#: Similar: SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Characters of the runs that signatures are made of. Longer than a shingle, as unrelated lines of one language share many shingles.
GRAM = 7
#: Lines of at most SHORT[1] characters have a signature of shingles, those of at least SHORT[0] one of longer runs: similar lines have one in common.
SHORT = (16, 24)
HASHES = 12
#: Threes of hashes, no two of which share more than one. At a similarity of 0.7 of the runs 97 % of pairs share a band.
BANDS = [(i, 4 + j, 8 + (i + j) % 4) for i in range(4) for j in range(4)]
#: The hashes that split the groups of a band further: at a similarity of 0.7 of the runs 99 % of a group's pairs share a part.
FURTHER = [((i + 1) % 4, (i + 2) % 4, 4 + (j + 1) % 4, 8 + (i + j + 1) % 4) for i in range(4) for j in range(4)]
#: Candidates agree in so many hashes at least; at a similarity of 0.7 of the runs 99 % of pairs do.
AGREED = 5
#: Offsets whose hashes are computed together. More do not fit into a method that the JVM compiles.
STEP = 8
#: Offsets of a piece: the line is copied for each of its pieces, and only a piece for each STEP offsets.
PIECE = 16 * STEP
SPACE = " \t\n\x0b\x0c\r"


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.col(f"`{text}`")
    return df.select(_doc(key, text), F.col(f"`{key}`").alias("id"), whole.alias("text"))


def _doc(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(f"`{key}`").isNull()).alias("doc")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, id, place, line, h) of every line with a word."""
    every = docs.select("doc", "id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return every.where(_worded(F.col("line"))).withColumn("h", F.xxhash64("line"))


def _worded(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACE)) != ""


def _spot() -> Column:
    return F.xxhash64("doc", "place")


def signed(docs: DataFrame, length: int) -> DataFrame:
    """Distinct lines: h, width of the runs, n (occurrences), spot (of one of them), m0, m1, ... (the signature).

    A line with two signatures has n = 0 in one of its rows. Characters become four bytes each, so that
    a run at any offset is a slice; the least values of STEP offsets at a time are found in one row.
    """
    short, long = SHORT
    size = F.length("line")
    few, many = F.lit(length), F.lit(max(GRAM, length))
    widths = F.when(size < short, F.array(few)).when(size > long, F.array(many)).otherwise(F.array(few, many))
    rows = _lines(docs).select("h", _spot().alias("spot"), size.alias("size"), F.encode("line", "UTF-32").alias("raw"), F.explode(widths).alias("width"))
    last = "greatest(0, size - width)"
    rows = rows.select("h", "spot", "size", "width", "raw", F.explode(F.expr(f"sequence(0, {last}, {PIECE})")).alias("begin"))
    rows = rows.select("h", "spot", "size", "width", "begin", F.expr(f"substring(raw, 4 * begin + 1, 4 * ({PIECE - 1} + width))").alias("piece"))
    rows = rows.select("h", "spot", "size", "width", "begin", "piece", F.explode(F.expr(f"sequence(begin, least({last}, begin + {PIECE - 1}), {STEP})")).alias("at"))
    here = F.expr(f"if(at = 0 and (width = {length} or size > {long}), 1, 0)").alias("here")
    rows = rows.select("h", "spot", "width", here, F.expr(f"substring(piece, 4 * (at - begin) + 1, 4 * ({STEP - 1} + width))").alias("part"), F.expr(f"4 * ({last} - at)").alias("most"), F.expr("4 * width").alias("bytes"))
    # beyond the last offset the last one again: the least stays the same
    hashes = [F.expr(f"xxhash64(substring(part, least({4 * k}, most) + 1, bytes))").alias(f"x{k}") for k in range(STEP)]
    rows = rows.select("h", "spot", "width", "here", *hashes)
    # a hash function for each constant: the order of values after XOR with it
    masks = [(k + 1) * 0x9E3779B97F4A7C15 % 2**63 for k in range(HASHES)]
    least = [F.least(*[F.col(f"x{k}").bitwiseXOR(F.lit(m)) for k in range(STEP)]).alias(f"m{n}") for n, m in enumerate(masks)]
    rows = rows.select("h", "spot", "width", "here", *least)
    return rows.groupBy("h", "width").agg(F.sum("here").alias("n"), F.min("spot").alias("spot"), *[F.min(f"m{n}").alias(f"m{n}") for n in range(HASHES)])


def _banded(signatures: DataFrame) -> DataFrame:
    """(h, width, band, key): the bands of each signature."""
    keys = F.array(*[F.xxhash64("width", F.lit(n), *[f"m{k}" for k in band]) for n, band in enumerate(BANDS)])
    # a column of its own, as what stands in a generator is not compiled
    return signatures.select("h", "width", keys.alias("keys")).select("h", "width", F.posexplode("keys").alias("band", "key"))


def _packed(signatures: DataFrame) -> DataFrame:
    """(h, width, spot, p0, p1, ...): 32 bits of each hash of the signature, two in a long."""
    low = [F.col(f"m{n}").bitwiseAND(F.lit(2**32 - 1)) for n in range(HASHES)]
    return signatures.select("h", "width", "spot", *[F.shiftleft(x, 32).bitwiseOR(y).alias(f"p{n}") for n, (x, y) in enumerate(zip(low[::2], low[1::2]))])


def _fenced(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df with further columns, each computed once: nothing moves below a generator, into the lambdas."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _met(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row a key: its part of a partition is hashed, and neither side is sorted."""
    return rows.join(table.hint("shuffle_hash"), on, how)


def _shingles(raw: Column, unit: int, length: int) -> Column:
    """Hashes of a line's shingles, equal ones as often as they come. raw: its bytes, ``unit`` of them a character.

    A shingle is a slice then. In a lambda of its own the line is not copied for each of them, so a long line costs no more a character.
    """
    starts = lambda p: F.sequence(F.lit(1), F.octet_length(p) - (unit * length - 1), F.lit(unit))
    return F.get(F.transform(F.array(raw), lambda p: F.transform(starts(p), lambda i: F.xxhash64(F.substr(p, i, F.lit(unit * length))))), F.lit(0))


def _verified(pairs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Pairs (a, b: a table) that are similar."""
    # most lines with company have no pair: their texts are not sent
    texts = maybe(texts, pairs.select(F.explode(F.array("a", "b")).alias("h")), "h").where("likely")
    one, two = (texts.select(F.col("h").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
    both = _met(_met(pairs, one, "a"), two, "b")
    # a byte is a character if neither line has others
    plain = (F.octet_length("la") == F.length("la")) & (F.octet_length("lb") == F.length("lb"))
    both = both.select("a", "b", "la", "lb", plain.alias("plain"))
    raw = {f"r{x}": F.when(F.col("plain"), F.col(f"l{x}").cast("binary")).otherwise(F.encode(f"l{x}", "UTF-32")) for x in "ab"}
    both = _fenced(both, ["a", "b", "plain"], **raw)
    both = both.where(F.least(F.octet_length("ra"), F.octet_length("rb")) >= F.when(F.col("plain"), length).otherwise(4 * length))
    # a width for each kind is a constant in the lambda
    hashes = {f"s{x}": F.when(F.col("plain"), _shingles(F.col(f"r{x}"), 1, length)).otherwise(_shingles(F.col(f"r{x}"), 4, length)) for x in "ab"}
    both = _fenced(both, ["a", "b"], **hashes)
    # sets are compiled in a projection, not in a generator; the union is not larger than without any repetition
    shared = F.size(F.array_intersect("sa", "sb"))
    most = F.size("sa") + F.size("sb") - shared
    either = F.when(SHARE[1] * shared >= SHARE[0] * most, most).otherwise(F.size(F.array_union("sa", "sb")))
    met = _fenced(both.select("a", "b", shared.alias("shared"), either.alias("either")), ["a", "b"], shared=F.col("shared"), either=F.col("either"))
    return met.where((F.col("shared") > 0) & (SHARE[1] * F.col("shared") >= SHARE[0] * F.col("either"))).select("a", "b")


def _company(members: DataFrame) -> DataFrame:
    """(h, rank): lines that have more company in their groups have a higher rank, of equals those of a lesser hash.

    A long, as decimals are slow to compare: 23 bits of the company and 40 of the hash.
    """
    few = F.least(F.sum("n"), F.lit(2**23 - 1))
    return members.groupBy("h").agg(few.alias("few")).select("h", F.shiftleft("few", 40).bitwiseOR(F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(2**63 - 1)), 24)).alias("rank"))


def _star(members: DataFrame, company: DataFrame, packed: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(a, b): every member (key, h, width, n) of a group and its pivot b, once each, if their signatures agree.

    Members with a root are not paired with a pivot of the same.
    """
    # copies are more alike the line with most company than one another.
    # The order is of lines, not of groups: no two lines are pivots of each other
    rooted = "root" in members.columns
    pivot = [F.max_by("h", "rank").alias("b"), *[F.max_by("root", "rank").alias("rb")] * rooted]
    first = _met(members, company, "h").groupBy("key").agg(*pivot)
    star = _met(members.withColumnRenamed("h", "a"), first, "key").where("a <> b")
    star = (star.where("root <> rb") if rooted else star).select("a", "b", "width").distinct()
    one, two = (packed.select(F.col("h").alias(x), "width", *[F.col(f"p{n}").alias(f"{x}{n}") for n in range(HASHES // 2)]) for x in "ab")
    unlike = [F.col(f"a{n}").bitwiseXOR(F.col(f"b{n}")) for n in range(HASHES // 2)]
    agreed = sum(((half == 0).cast("int") for x in unlike for half in (F.shiftrightunsigned(x, 32), F.shiftleft(x, 32))), F.lit(0))
    return ws.put(_met(_met(star, one, ["a", "width"]), two, ["b", "width"]).where(agreed >= AGREED).select("a", "b").distinct(), name)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (and their roots) of groups of three lines or more that are not in one component."""
    placed = _met(members.where("n > 2"), roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    apart = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return _met(placed, apart, "key").select(*members.columns, "root")


def _finer(members: DataFrame, packed: DataFrame) -> DataFrame:
    """Members (key, h, width, root, n) of the groups' parts that are not in one component: lines that agree in one more hash, for each of FURTHER."""
    halves = (half for n in range(HASHES // 2) for half in (F.shiftrightunsigned(f"p{n}", 32), F.col(f"p{n}").bitwiseAND(F.lit(2**32 - 1))))
    hashes = F.array(*halves).alias("hashes")
    others = F.get(F.array(*[F.array(*map(F.lit, x)) for x in FURTHER]), F.col("band"))
    every = _met(members, packed, ["h", "width"]).select("key", "h", "width", "root", hashes, F.explode(others).alias("other"))
    split = every.select("h", "width", "root", F.xxhash64("key", "other", F.get("hashes", F.col("other"))).alias("key"))
    apart = split.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return _met(split, apart.select("key", "n"), "key")


def line_roots(docs: DataFrame, signatures: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """(node, root) of lines that have a similar other one."""
    banded = _banded(signatures)
    groups = ws.put(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    members = ws.put(_met(maybe(banded, groups, "key").where("likely").drop("likely"), groups, "key"), "members")
    ws.drop("groups")
    company = ws.put(_company(members), "company")
    candidates = _met(maybe(signatures.drop("n"), company, "h").where("likely").drop("likely"), company, "h", "left_semi")
    packed = ws.put(_packed(candidates), "candidates")
    star = _star(members, company, packed, ws, "star")
    again = maybe(_lines(docs).select("h", _spot().alias("spot"), "line"), packed, "spot").where("likely").drop("likely")
    # texts, not sets: a set of hashes has eight times the bytes of its line
    texts = ws.put(again.join(company, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "texts")
    ws.tidy()
    links = ws.put(_verified(star, texts, length), "links-0")
    roots = ws.put(components(links, ws, "first"), "roots-0")

    # what is apart from others of its group meets the pivots of the group's parts
    open_ = ws.put(_open(members, roots), "open")
    ws.drop("members")
    parts = ws.put(_finer(open_, packed), "parts")
    again = _star(parts, _company(parts), packed, ws, "star-1")
    # the company within the parts may turn a pair round
    again = _met(again, star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    more = ws.put(_verified(ws.put(again, "star-2"), texts, length), "links-1")
    ws.drop("company", "open", "parts", "star", "star-1", "star-2")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return ws.put(components(known.unionByName(more), ws, "second"), "roots-1")


def _wanted(signatures: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, root) of lines that come twice or are similar to others."""
    # n is positive in one row of a line; a line that comes once and has no root is not sent
    some = maybe(signatures.where("n > 0").select("h", "n"), roots, "h").where("n > 1 or likely").drop("likely")
    return _met(some, roots, "h", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"))


def removed_places(docs: DataFrame, ws: Workspace, length: int = LENGTH) -> DataFrame:
    """(doc, removed): places of the lines that go, a row for each document that loses any."""
    signatures = ws.put(signed(docs, length), "signatures")
    ws.tidy()
    roots = line_roots(docs, signatures, ws, length)
    ws.tidy()
    wanted = ws.put(_wanted(signatures, roots.withColumnRenamed("node", "h")), "wanted")
    occurrences = maybe(_lines(docs).select("doc", "id", "place", "h"), wanted, "h").where("likely").drop("likely")
    every = ws.put(_met(occurrences, wanted, "h").drop("h"), "occurrences")
    seat = F.struct("id", "doc", "place")
    stay = ws.put(every.groupBy("root").agg(F.min(seat).alias("stays")), "stays")
    gone = _met(every, stay, "root").where(~seat.eqNullSafe(F.col("stays")))
    out = ws.put(gone.groupBy("doc").agg(F.collect_set("place").alias("removed")), "removed")
    ws.drop("signatures", "candidates", "texts", "stays", "wanted", "occurrences")
    ws.tidy()
    return out


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """df without the lines that go; columns as they were, and ``n_removed_lines``.

    Every row stays, also where it loses all its lines.
    """
    ws = Workspace(df.sparkSession, "lines")
    named = [f"c{n}" for n in range(len(df.columns))]
    docs = _keyed(df, key, text)
    removed = removed_places(docs, ws, length)
    whole = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, named)])
    rows = df.select(_doc(key, text), whole.alias("row"))
    rows = maybe(rows, removed, "doc")
    own = named[df.columns.index(text)]
    same = rows.where(~F.col("likely")).select("row", F.col(f"row.{own}").alias("left"), F.lit(0).alias("n"))
    some = _met(rows.where("likely"), removed, "doc", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    # split after the join: the lines beside the text would be sent, too
    some = _fenced(some, ["row", "removed"], lines=F.split(F.col(f"row.{own}"), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    # the places of lines that stay, as a column of their own, so that a look-up is one step
    some = some.select("row", "lines", "removed", F.inline(F.array(F.struct(F.when(F.col("lines").isNotNull(), places).alias("places")))))
    left = F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n")
    some = some.select("row", F.when(F.size("removed") == 0, F.col(f"row.{own}")).otherwise(left).alias("left"), F.size("removed").alias("n"))
    out = same.unionByName(some)
    return out.select(*[(F.col("left") if n == own else F.col(f"row.{n}")).alias(c) for c, n in zip(df.columns, named)], F.col("n").cast("long").alias("n_removed_lines"))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each row of df: key, n_lines (with a word), n_removed_lines, kept_sha256 of the text left."""
    out = dedup(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id", "text", length)
    out = out.withColumn("text", F.coalesce("text", F.lit("")))
    # only lines with a word go
    n = F.size(F.filter(F.split("text", "\n", -1), _worded)).cast("long") + F.col("n_removed_lines")
    return out.select(F.col("doc_id").alias(key), n.alias("n_lines"), "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))
