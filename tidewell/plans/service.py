"""The reads of the system: free SQL, tables in scope, and pages of current rows, as JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.naming import quoted
from tidewell.operators.current import PAGE, current_rows, page
from tidewell.plans import gate
from tidewell.plans.cache import Cache
from tidewell.session import scoped
from tidewell.sources.tablelog import METADATA, Catalog, NoSuchTable

CATALOG = "lake"


class QueryError(Exception):
    """An error with the code that a web interface would answer with."""

    code = 500


class CatalogError(QueryError):
    code = 502


class ExecutionError(QueryError):
    code = 400


class EncodingError(QueryError):
    code = 500


@contextmanager
def _reading() -> Iterator[None]:
    """What goes wrong while the catalog is read is the catalog's fault, not the query's."""
    try:
        yield
    except (QueryError, NoSuchTable):
        raise
    except Exception as error:
        raise CatalogError(f"the catalog cannot be read: {(str(error).strip() or type(error).__name__).splitlines()[0]}") from error


def is_metadata(name: str) -> bool:
    """Whether a name ends, after its last dollar sign, as one of the metadata tables."""
    return "$" in name and name.rsplit("$", 1)[1] in METADATA


def to_json(df: DataFrame, most_rows: int | None = None) -> str:
    """An array of objects: columns in order, nulls shown; no rows: []."""
    rows = df if most_rows is None else df.limit(most_rows + 1)
    if not df.columns:
        return "[" + ",".join(["{}"] * rows.count()) + "]"
    whole = F.struct(*[F.col(quoted(c)) for c in df.columns])
    try:
        encoded = rows.select(F.to_json(whole, {"ignoreNullFields": "false"}))
    except AnalysisException as error:  # the rows themselves are analysed already
        raise EncodingError(f"the result has no form in JSON: {error}") from error
    texts = [r[0] for r in encoded.collect()]
    if most_rows is not None and len(texts) > most_rows:
        raise ExecutionError(f"the result has more than {most_rows} rows")
    return "[" + ",".join(texts) + "]"


#: Codes of answers and their messages.
ANSWERS = {
    1000: "OK",
    1001: "Created",
    1002: "Deleted",
    2000: "Bad Request",
    2001: "Not Found",
    2002: "Conflict",
    2003: "Internal Server Error",
    2004: "Upstream Error",
    2005: "Unauthorized",
    2006: "Forbidden",
}


def envelope(rows: str) -> str:
    """The answer around rows that are JSON already; they are not parsed again."""
    return f'{{"response_code":1000,"response_message":"{ANSWERS[1000]}","rows":{rows}}}'


def failure(error: QueryError) -> tuple[int, str]:
    """(status, answer) for a failed query: an absent catalog is upstream's fault, a refused query the caller's."""
    code = {502: 2004, 400: 2000}.get(error.code, 2003)
    return error.code, json.dumps({"response_code": code, "response_message": ANSWERS[code], "error": str(error)})


class QueryService:
    """``most_rows`` guards the driver in free SQL: a longer result is an error, not a cut one."""

    def __init__(self, spark: SparkSession, catalog: Catalog, cache: Cache | None = None, most_rows: int | None = 1_000_000) -> None:
        self.spark, self.catalog, self.most_rows = spark, catalog, most_rows
        self.cache = cache or Cache(ttl=0)

    def _frame(self, namespace: str, name: str) -> DataFrame:
        if is_metadata(name):
            table, kind = name.rsplit("$", 1)
            return self.catalog.table(namespace, table).metadata(kind)
        return self.catalog.table(namespace, name).scan()

    def frame(self, sql: str, namespaces: Iterable[str]) -> DataFrame:
        """The query as a DataFrame of a session of its own, which sees the tables in scope as they are now."""
        allowed, own = set(namespaces), scoped(self.spark)
        views: dict[tuple[str, str], str] = {}
        named: set[str] | None = None

        def view_of(parts: tuple[str, ...]) -> str | None:
            nonlocal named
            if len(parts) == 1:
                if named is None:
                    named = gate.named_in_with(own, sql)
                    for name in named:
                        _hide(own, name)
                if parts[0].lower() in named:
                    return None
            if len(parts) != 3 or parts[0] != CATALOG or parts[1] not in allowed:
                raise ExecutionError(f"table not found: {'.'.join(parts)}")
            where = parts[1], parts[2]
            if where not in views:
                try:
                    with _reading():
                        df = self._frame(*where)
                except NoSuchTable:
                    raise ExecutionError(f"table not found: {'.'.join(parts)}") from None
                views[where] = f"v_{uuid.uuid4().hex}"
                _register(own, df, views[where])
            return views[where]

        try:
            text = gate.rewrite(own, sql, view_of)
            with gate.active(own):
                return own.sql(text)
        except gate.Refused as error:
            raise ExecutionError(str(error)) from error
        except AnalysisException as error:
            raise ExecutionError(str(error)) from error

    def query(self, sql: str, namespaces: Iterable[str]) -> str:
        allowed = sorted(set(namespaces))

        def compute() -> str:
            df = self.frame(sql, allowed)
            try:
                return to_json(df, self.most_rows)
            except PySparkException as error:
                raise ExecutionError(str(error)) from error

        return self.cache.through("query", ",".join(allowed), sql, compute)

    def list_tables(self, namespaces: Iterable[str], names: dict[str, str] | None = None) -> str:
        """Tables in scope, in order; ``names``: what to call the source of a namespace."""
        allowed = set(namespaces)

        def compute() -> str:
            with _reading():
                listed = self.catalog.tables(allowed)
            found = [{"namespace": ns, "table": t} | ({"source": names[ns]} if names and ns in names else {}) for ns, t in listed if not is_metadata(t)]
            return json.dumps(found)

        return self.cache.through("tables", ",".join(sorted(allowed)), json.dumps(names, sort_keys=True), compute)

    def read_table(self, namespace: str, name: str, offset: int = 0, limit: int = PAGE) -> str:
        """A page of a table's current rows; never cached."""
        if is_metadata(name):
            raise ExecutionError(f"{name} has no rows of its own")
        table = self.catalog.table(namespace, name)
        try:
            with _reading():
                keys, rows = table.keys(), table.scan()
        except NoSuchTable as error:
            raise ExecutionError(f"table not found: {namespace}.{name}") from error
        own = scoped(self.spark)  # names that differ in case only, without touching the caller's session
        own.conf.set("spark.sql.caseSensitive", "true")
        _register(own, rows, "page")
        return to_json(page(current_rows(own.table("page"), keys), offset, limit))


def _hide(own: SparkSession, name: str) -> None:
    """Where a WITH clause's name does not reach, it is a view that fails, never a table of the shared catalog."""
    missing = F.raise_error(F.lit(f"table not found: {name}"))
    own.range(1).where(missing.cast("string").isNull()).toDF(f"_{uuid.uuid4().hex}").createOrReplaceTempView(quoted(name))


def _register(own: SparkSession, df: DataFrame, name: str) -> None:
    """A view of the same files in another session: a schema and paths are all that it takes."""
    files = df.inputFiles()
    if files:
        own.read.schema(df.schema).parquet(*files).createOrReplaceTempView(name)
    else:
        own.createDataFrame(df.collect(), df.schema).createOrReplaceTempView(name)  # a table's log: small, and at the driver already
