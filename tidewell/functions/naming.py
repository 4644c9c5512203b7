"""Names of target namespaces and tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def namespace_of(source_id: str) -> str:
    """``cdc_`` and the source's UUID in hex."""
    return "cdc_" + uuid.UUID(str(source_id)).hex


def sanitise(name: str) -> str:
    """Lower case; each code point outside ASCII letters and digits is one underscore."""
    return re.sub("[^A-Za-z0-9]", "_", name).lower()


def table_of(schema: str, table: str) -> str:
    return f"{sanitise(schema)}__{sanitise(table)}"


def sanitised(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def table_name(schema: Column, table: Column) -> Column:
    return F.concat(sanitised(schema), F.lit("__"), sanitised(table))


def quoted(name: str) -> str:
    """A column name as Spark must read it to find exactly that column."""
    return "`" + name.replace("`", "``") + "`"
