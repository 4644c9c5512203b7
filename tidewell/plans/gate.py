"""The gate of free SQL: read-only queries over the tables in scope, and nothing else.

The statement is only parsed here, never run: Spark runs commands as soon as they are given to sql().
The parsed plan is walked through children, inner children and subqueries, and every node must be on a
list of query nodes. Names of three parts are then replaced, in the text, by views of the tables that
the scope allows; any other name does not resolve, just as an unknown table does not.

This module alone uses Spark's internal handles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tidewell.functions import sqlnames

#: Nodes of the parser that make up queries.
ALLOWED = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit LimitAll Offset Distinct Deduplicate Union Intersect Except Join LateralJoin
    AsOfJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable
    UnresolvedTableValuedFunction UnresolvedTVFAliases OneRowRelation$ OneRowRelation Generate Window WithWindowDefinition Pivot Unpivot
    UnresolvedHaving Expand Sample Range LocalRelation UnresolvedHint CTERelationRef CTERelationDef WithCTE View Tail
    RepartitionByExpression Repartition RebalancePartitions UnresolvedOrdinal UnresolvedTableAliases""".split()
)
#: Table functions: Spark's, and those that the session gets by the names of other dialects.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split()) | set(sqlnames.TABLES)
#: Functions that run code of the caller's choice or read what is not in the tables.
REFUSED = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length read_files".split())


class Refused(Exception):
    """The statement is no read-only query; the caller's mistake."""


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.length())]


@contextmanager
def active(spark: SparkSession) -> Iterator[None]:
    """The parser takes its settings (double-quoted names) from the session that is active in the JVM."""
    kind = spark._jvm.org.apache.spark.sql.classic.SparkSession
    before = kind.getActiveSession()
    kind.setActiveSession(spark._jsparkSession)
    try:
        yield
    finally:
        if before.isDefined():
            kind.setActiveSession(before.get())


def parse(spark: SparkSession, sql: str):
    with active(spark):
        try:
            return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except (PySparkException, Py4JJavaError) as error:
            raise Refused(f"not a query: {(str(error).strip() or 'empty').splitlines()[0]}") from error


def _plans(plan) -> list:
    """All plans in a plan: its own, in expressions, and those a node keeps to itself."""
    found, todo, seen = [], [plan], set()
    while todo:
        p = todo.pop()
        if (key := p.hashCode(), p.getClass().getName(), p.toString()) in seen:
            continue
        seen.add(key)
        found.append(p)
        todo += _seq(p.children()) + [c for c in _seq(p.innerChildren()) if hasattr(c, "innerChildren") and _is_plan(c)]
        for e in _seq(p.expressions()):
            todo += _subplans(e)
    return found


def _is_plan(node) -> bool:
    name = node.getClass().getName()
    return ".plans.logical." in name or ".analysis." in name and not _is_expression(node)


def _is_expression(node) -> bool:
    own = node.getClass()
    while own is not None:
        if own.getName() == "org.apache.spark.sql.catalyst.expressions.Expression":
            return True
        own = own.getSuperclass()
    return False


def _subplans(expression) -> list:
    found, todo = [], [expression]
    while todo:
        e = todo.pop()
        todo += _seq(e.children())
        own = e.getClass()
        while own is not None and own.getSimpleName() not in ("PlanExpression", "SubqueryExpression", "Expression", "Object"):
            own = own.getSuperclass()
        if own is not None and own.getSimpleName() in ("PlanExpression", "SubqueryExpression"):
            found.append(e.plan())
    return found


def _expressions(plan) -> list:
    found, todo = [], _seq(plan.expressions())
    while todo:
        e = todo.pop()
        found.append(e)
        todo += _seq(e.children())
    return found


def relations(spark: SparkSession, sql: str) -> list[tuple[tuple[str, ...], int, int]]:
    """(name parts, first character, last character) of every table named; Refused if it is no query."""
    return names(spark, sql)[0]


def names(spark: SparkSession, sql: str) -> tuple[list[tuple[tuple[str, ...], int, int]], list[tuple[str, int, int]]]:
    """What a query names: tables as relations() has them, and functions as (name, number of arguments, first character)."""
    found, calls = set(), set()
    for p in _plans(parse(spark, sql)):
        name = p.getClass().getSimpleName()
        if name not in ALLOWED:
            raise Refused(f"only queries are allowed: {name}")
        if name == "UnresolvedRelation":
            parts = tuple(_seq(p.multipartIdentifier()))
            origin = p.origin()
            found.add((parts, origin.startIndex().get(), origin.stopIndex().get()))
        if name == "UnresolvedTableValuedFunction":
            parts = [x.lower() for x in _seq(p.name())]
            if parts[-1] not in TABLE_FUNCTIONS:
                raise Refused(f"no such table function: {parts[-1]}")
            calls.add((parts[-1], 0, -1))  # made in the session, never renamed
        for e in _expressions(p):
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                parts = [x.lower() for x in _seq(e.nameParts())]
                if parts[-1] in REFUSED or len(parts) > 1:
                    raise Refused(f"not allowed: {'.'.join(parts)}")
                calls.add((parts[-1], e.arguments().length(), e.origin().startIndex().get()))
            if "Identifier" in kind and "Expression" in kind and kind.startswith("ExpressionWith"):
                raise Refused("IDENTIFIER() is not allowed")
    return sorted(found, key=lambda x: x[1]), sorted(calls)


def named_in_with(spark: SparkSession, sql: str) -> set[str]:
    """The names that WITH clauses anywhere in the statement define, in lower case."""
    found: set[str] = set()
    for p in _plans(parse(spark, sql)):
        if p.getClass().getSimpleName() == "UnresolvedWith":
            found |= {r._1().lower() for r in _seq(p.cteRelations())}
    return found


def rewrite(spark: SparkSession, sql: str, view_of: Callable[[tuple[str, ...]], str | None]) -> str:
    """The query with tables' names replaced by view_of(parts); None leaves a name as it is.

    Functions of other dialects get Spark's names, or are made in the session.
    """
    tables, calls = names(spark, sql)
    edits: list[tuple[int, int, str]] = []
    last = len(sql)
    for parts, first, stop in reversed(tables):
        view = view_of(parts)
        if view is None or stop >= last:
            continue
        text = sql[first : stop + 1]
        named = re.match(r"""(?:[^\s"`(),;]+|"(?:[^"]|"")*"|`(?:[^`]|``)*`)+""", text)
        edits.append((first, first + (named.end() if named else len(text)), view))
        last = first
    wanted = set()
    for name, arguments, first in calls:
        other = sqlnames.renamed(name, arguments)
        if other and first >= 0 and sql[first : first + len(name)].lower() == name:
            edits.append((first, first + len(name), other))
        wanted.add(other or name)
    sqlnames.define(spark, wanted)
    out = sql
    for first, end, text in sorted(edits, reverse=True):
        out = out[:first] + text + out[end:]
    return out
