"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong spans (assignments, access identifiers, long hex runs) are always reported. Weak candidates
(names of accounts, mixed runs of characters that may be keys, endpoints) are reported only where a
complementary part starts within the same scope and does not overlap them, so that no text confirms itself; a
mixed run that begins inside an endpoint is a piece of it and no part. An interval join on the start of the parts, done as
range frames over the parts of a document. One shuffle, by row, of the parts and of the columns that
are kept; no pair of parts is ever emitted.

Defined cases: a null text is an empty one and has no spans. Every row gets one row of result, also
where rows repeat or share a doc_id. Only the named columns are read; redact() carries the others
along, of any name and type (with the text, through the one shuffle). Rows are numbered where they are
read, so an input must come in the same order when a lost task reads it again, as files do. Time is in
proportion to the text, also for a long run without a space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of part. ``least``: the shortest that counts, of the given group of the pattern."""

    name: str
    pattern: str
    role: str
    least: int
    group: int = 0
    needs: tuple[str, ...] = ()  # any of these roles in scope; none: strong
    also: tuple[str, ...] = ()  # classes of characters that the match must all have
    outside: tuple[str, ...] = ()  # names of kinds inside which it does not count


SECRET, IDENTIFIER, ENDPOINT = "secret", "identifier", "endpoint"

#: In the order in which spans of the same start are listed.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", SECRET, 6, 2),
    Kind("access", r"AKIA[A-Z0-9]+", IDENTIFIER, 20),
    Kind("hex", r"[0-9a-f]{24,}", SECRET, 24),
    Kind("account", r"""(?i)(user_?name|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", IDENTIFIER, 3, 2, (SECRET,)),
    Kind("mixed", r"[A-Za-z0-9+/]{32,}", SECRET, 32, 0, (IDENTIFIER, ENDPOINT), ("[a-z]", "[A-Z]", "[0-9]"), ("endpoint",)),
    Kind("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+""", ENDPOINT, 10, 0, (SECRET,)),
)

#: Parts whose starts are at most so many code points apart are in one scope.
SCOPE = 400


def _parts(text: Column, number: int, kind: Kind) -> Column:
    """Matches in order as (kind, nth, gap before it, length, whether it counts).

    split() and regexp_extract_all() find the same leftmost matches, so positions follow from the
    lengths of what lies between.
    """
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    matches = F.filter(pairs, lambda x: x["m"].isNotNull())

    def part(x: Column, nth: Column) -> Column:
        counted = F.regexp_extract(x["m"], kind.pattern, kind.group) if kind.group else x["m"]
        counts = F.length(counted) >= kind.least
        for also in kind.also:  # one class at a time: a search for them in any order goes back and forth on long runs
            counts = counts & x["m"].rlike(also)
        return F.struct(F.lit(number).alias("kind"), nth.alias("nth"), x["gap"].alias("gap"), F.length(x["m"]).alias("size"), counts.alias("counts"))

    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,counts:boolean>>")
    return F.when(text.rlike(kind.pattern), F.transform(matches, part)).otherwise(none)


def linked_spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> DataFrame:
    """A row for each row of df: the columns in ``keep`` and ``spans``.

    ``spans`` is an array of (start, kind, end), by start and then kind (its number in ``kinds``);
    starts and ends are code points, ends exclusive.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(keep)]).alias("kept"), whole.alias("text"))
    rows = rows.select("row", "kept", F.posexplode_outer(F.concat(*[_parts(F.col("text"), n, k) for n, k in enumerate(kinds)])).alias("pos", "part"))
    # what is kept travels once for each row, however many parts it has
    rows = rows.select("row", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("kept")).alias("kept"), "part.*").repartition("row")
    sofar = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(sofar)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    for number, kind in enumerate(kinds):
        if kind.outside:
            around = F.col("kind").isin([n for n, k in enumerate(kinds) if k.name in kind.outside])
            covered = F.max(F.when(around & F.col("counts"), F.col("end"))).over(upto)
            rows = rows.withColumn("covered", covered).withColumn("counts", F.col("counts") & ~((F.col("kind") == number) & (F.coalesce("covered", F.lit(0)) > F.col("start")))).drop("covered")
    role = F.element_at(F.array(*[F.lit(k.role) for k in kinds]), F.col("kind") + 1)
    rows = rows.withColumn("role", F.when(F.col("counts"), role))
    before, after = (Window.partitionBy("row").orderBy("start").rangeBetween(*x) for x in ((-scope, 0), (0, scope)))
    there = {}
    for r in sorted({x for k in kinds for x in k.needs}):
        own = F.col("role") == r
        ends_before = F.min(F.when(own, F.col("end"))).over(before) <= F.col("start")
        begins_after = F.max(F.when(own, F.col("start"))).over(after) >= F.col("end")
        there[r] = (F.coalesce(ends_before, F.lit(False)) | F.coalesce(begins_after, F.lit(False))).alias(r)
    rows = rows.select("row", "kept", "kind", "start", "end", "counts", *there.values())
    reported = F.col("counts")
    for number, kind in enumerate(kinds):
        if kind.needs:
            linked = F.lit(False)
            for r in kind.needs:
                linked = linked | F.col(r)
            reported = reported & ((F.col("kind") != number) | linked)
    span = F.when(reported, F.struct("start", "kind", "end"))
    found = rows.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.sort_array(F.collect_list(span)).alias("spans"))
    return found.select(*[F.col(f"kept.c{n}").alias(c) for n, c in enumerate(keep)], "spans")


def _listed(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """linked_spans as counts of the strong kinds, their digest, and all spans as text."""
    found = linked_spans(df, text, (key,))
    strong = [n for n, k in enumerate(KINDS) if not k.needs]
    base = F.filter("spans", lambda s: s["kind"].isin(strong))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(F.col(f"`{key}`"), *[count(n).alias(f"n_{KINDS[n].name}") for n in strong], F.sha2(_listed(base, KINDS), 256).alias("base_sha256"), _listed(F.col("spans"), KINDS).alias("spans"))


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """df with every reported span of its texts replaced by ``mask``; overlapping spans become one mask.

    A null text stays null. Columns, their order and the number of rows stay as they are.
    """
    # a column of the input may be called spans
    inner = [f"c{n}" for n in range(len(df.columns))]
    own = inner[df.columns.index(text)]
    found = linked_spans(df.toDF(*inner), own, tuple(inner))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col(own), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(F.concat(acc["out"], gap, F.lit(mask)).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    rest = lambda acc: F.concat(acc["out"], F.substr(F.col(own), (acc["at"] + 1).cast("int")))
    masked = F.when(F.size("spans") == 0, F.col(own)).otherwise(F.aggregate("spans", start, step, rest))
    return found.select(*[(masked if n == own else F.col(n)).alias(c) for n, c in zip(inner, df.columns, strict=True)])


def _sql(kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> str:
    """The digest in DuckDB SQL, over the view documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    scans, reported = [], ["counts"]
    for n, k in enumerate(kinds):
        counted = f"regexp_extract(m, {quoted(k.pattern)}, {k.group})" if k.group else "m"
        counts = f"length({counted}) >= {k.least}" + "".join(f" AND regexp_matches(m, {quoted(also)})" for also in k.also)
        scans.append(
            f"SELECT doc_id, {n} AS kind, nth, gap, m, {counts} AS counts FROM (SELECT doc_id, unnest(range(len(ms))) AS nth, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap "
            f"FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {quoted(k.pattern)}) AS ms, string_split_regex(coalesce(text, ''), {quoted(k.pattern)}) AS gaps FROM documents))"
        )
        if k.needs:
            reported.append(f"(kind <> {n} OR " + " OR ".join(f"coalesce(near_{r}, false)" for r in k.needs) + ")")
    roles = "CASE " + " ".join(f"WHEN counts AND kind = {n} THEN '{k.role}'" for n, k in enumerate(kinds)) + " END"
    names = "CASE kind " + " ".join(f"WHEN {n} THEN '{k.name}'" for n, k in enumerate(kinds)) + " END"
    needed = sorted({x for k in kinds for x in k.needs})
    near = ", ".join(f"(coalesce(min(CASE WHEN role = '{r}' THEN e END) OVER before <= s, false) OR coalesce(max(CASE WHEN role = '{r}' THEN s END) OVER after >= e, false)) AS near_{r}" for r in needed)
    covers = lambda k: ", ".join(str(n) for n, o in enumerate(kinds) if o.name in k.outside)
    inside = " OR ".join(f"(kind = {n} AND coalesce(max(CASE WHEN kind IN ({covers(k)}) AND counts THEN e END) OVER (PARTITION BY doc_id ORDER BY s RANGE UNBOUNDED PRECEDING) > s, false))" for n, k in enumerate(kinds) if k.outside) or "false"
    strong = [n for n, k in enumerate(kinds) if not k.needs]
    counted = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {n}) AS BIGINT) AS n_{kinds[n].name}" for n in strong)
    return f"""
WITH found AS ({" UNION ALL ".join(scans)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS e FROM found),
found_at AS (SELECT doc_id, kind, e - length(m) AS s, e, counts FROM placed),
alone AS (SELECT doc_id, kind, s, e, counts AND NOT ({inside}) AS counts FROM found_at),
parts AS (SELECT *, {roles} AS role FROM alone),
linked AS (SELECT *, {near} FROM parts WINDOW before AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {scope} PRECEDING AND CURRENT ROW), after AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {scope} FOLLOWING)),
spans AS (SELECT doc_id, kind, s, {names} || ':' || s || ':' || e AS span FROM linked WHERE {" AND ".join(reported)}),
listed AS (SELECT doc_id, {counted}, coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind IN ({", ".join(map(str, strong))})), '') AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kinds[n].name}, 0) AS n_{kinds[n].name}" for n in strong)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)"""


ORACLE_SQL = _sql()
