"""Functions of other dialects by their own names in free SQL.

``DEFINED`` are SQL functions of a query's own session. Spark puts their bodies in place of the calls, so that they are
optimised and compiled as any other expression; no Python runs. ``RENAMED`` are names (with the number of arguments, or
None for any) of what Spark has under another name and takes values of any type or number. Only those that a statement
names are made.

Defined cases: a null argument gives null, unless said otherwise. Positions count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

RENAMED: dict[tuple[str, int | None], str] = {
    ("make_array", None): "array",
    ("array_has", None): "array_contains",
    ("array_concat", None): "concat",
    ("array_to_string", None): "array_join",
    ("approx_distinct", None): "approx_count_distinct",
    ("starts_with", None): "startswith",
    ("ends_with", None): "endswith",
    ("trunc", 1): "trunc_number",
}

# how many capturing groups a pattern has: brackets that are neither escaped nor followed by a question mark
_GROUPS = r"size(regexp_extract_all(pattern, '(?<!\\\\)[(](?![?])', 0))"
_MICROS = "unix_micros(CAST({} AS TIMESTAMP))"
_WIDTH = "unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + width)"
#: Series are made in runs of so many, so that no array of a whole series is ever in memory.
RUN = 4096

#: name: (parameters and result, body). ``trunc_number`` stands for trunc of one number.
DEFINED: dict[str, tuple[str, str]] = {
    "strpos": ("(text STRING, part STRING) RETURNS INT", "instr(text, part)"),
    "to_hex": ("(n BIGINT) RETURNS STRING", "lower(hex(n))"),
    "gcd": ("(a BIGINT, b BIGINT) RETURNS BIGINT", "abs(aggregate(sequence(1, 92), named_struct('x', a, 'y', b), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END).x)"),
    "lcm": ("(a BIGINT, b BIGINT) RETURNS BIGINT", "CASE WHEN a = 0 OR b = 0 THEN 0L ELSE abs(a div gcd(a, b) * b) END"),
    "trunc_number": ("(x DOUBLE) RETURNS DOUBLE", "CASE WHEN abs(x) >= 4503599627370496D THEN x ELSE x - x % 1D END"),
    "string_to_array": ("(text STRING, mark STRING) RETURNS ARRAY<STRING>", r"split(text, '\\Q' || mark || '\\E')"),
    "regexp_match": (
        "(text STRING, pattern STRING) RETURNS ARRAY<STRING>",
        f"CASE WHEN text RLIKE pattern THEN CASE WHEN {_GROUPS} = 0 THEN array(regexp_extract(text, pattern, 0)) ELSE transform(sequence(1, {_GROUPS}), g -> regexp_extract(text, pattern, g)) END END",
    ),
    "digest": (
        "(value BINARY, method STRING) RETURNS BINARY",
        "unhex(CASE lower(method) WHEN 'md5' THEN md5(value) WHEN 'sha224' THEN sha2(value, 224) WHEN 'sha256' THEN sha2(value, 256) WHEN 'sha384' THEN sha2(value, 384) WHEN 'sha512' THEN sha2(value, 512) ELSE CASE WHEN method IS NOT NULL THEN raise_error('no such digest: ' || method) END END)",
    ),
    **{f"sha{bits}": ("(value BINARY) RETURNS BINARY", f"unhex(sha2(value, {bits}))") for bits in (224, 256, 384, 512)},
    "date_bin": (
        "(width INTERVAL DAY TO SECOND, at TIMESTAMP_NTZ, origin TIMESTAMP_NTZ DEFAULT TIMESTAMP_NTZ'1970-01-01 00:00:00') RETURNS TIMESTAMP_NTZ",
        f"CAST(timestamp_micros({_MICROS.format('at')} - pmod({_MICROS.format('at')} - {_MICROS.format('origin')}, {_WIDTH})) AS TIMESTAMP_NTZ)",
    ),
    "to_timestamp_seconds": ("(n BIGINT) RETURNS TIMESTAMP", "timestamp_seconds(n)"),
    "to_timestamp_millis": ("(n BIGINT) RETURNS TIMESTAMP", "timestamp_millis(n)"),
    "to_timestamp_micros": ("(n BIGINT) RETURNS TIMESTAMP", "timestamp_micros(n)"),
}

#: Table functions. A series that its step does not lead to is empty, as is one with a null.
TABLES: dict[str, tuple[str, str]] = {
    "generate_series": (
        "(first BIGINT, last BIGINT, step BIGINT DEFAULT 1) RETURNS TABLE(value BIGINT)",
        f"""SELECT first + step * (run * {RUN} + nth) FROM (SELECT explode(CASE WHEN step > 0 AND first <= last OR step < 0 AND first >= last
        THEN sequence(0L, (last - first) div step div {RUN}) ELSE array() END) AS run) LATERAL VIEW explode(sequence(0L, {RUN - 1}L)) e AS nth WHERE run * {RUN} + nth <= (last - first) div step""",
    ),
}


def renamed(name: str, arguments: int) -> str | None:
    return RENAMED.get((name, arguments)) or RENAMED.get((name, None))


def define(spark: SparkSession, names: Iterable[str]) -> None:
    """Makes the functions of these names, and those that they call, in the session."""
    every, done = DEFINED | TABLES, set()

    def one(name: str) -> None:
        if name in every and name not in done:
            done.add(name)
            head, body = every[name]
            for called in re.findall(r"(\w+)\(", body):
                one(called)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{head} RETURN {body}")

    for name in sorted(set(names)):
        one(name)
