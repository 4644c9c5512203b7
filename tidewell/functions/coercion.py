"""Text to typed values, strictly: what the target type's text form does not allow is an error.

Spark's casts are more lenient than the wire format (surrounding spaces, ``yes``, timestamps without an
offset), so each cast stands behind a check of the form. ``strict`` raises on the executors;
``checked`` gives the value and whether it was refused, for a side output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Source type names and what they become; any other is kept as text.
TYPES = {
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "timestamp with time zone": T.TimestampType(),
}
TRUE, FALSE = ("t", "true", "TRUE", "1"), ("f", "false", "FALSE", "0")

_NUMBER = r"[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|NaN|nan)"
_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}(\.\d{1,9})?"
_FORMS = {
    "smallint": r"[+-]?\d+",
    "int": r"[+-]?\d+",
    "bigint": r"[+-]?\d+",
    "float": _NUMBER,
    "double": _NUMBER,
    "date": _DAY,
    "timestamp_ntz": f"{_DAY} {_TIME}",
    "timestamp": f"{_DAY} {_TIME}" + r"[+-]\d{2}(:?\d{2})?",
}


def target_type(source_type: str) -> T.DataType:
    return TYPES.get(source_type, T.StringType())


def _value(text: Column, kind: str) -> Column:
    """The value, or null where the text is not of the type's form or range."""
    if kind == "boolean":
        return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)
    return F.when(text.rlike(f"^(?:{_FORMS[kind]})$") & ~text.endswith("\n"), text.try_cast(kind))


def strict(text: Column, kind: T.DataType) -> Column:
    """The typed value; null stays null; anything refused raises."""
    name = kind.simpleString()
    if name == "string":
        return text
    if name not in _FORMS and name != "boolean":
        raise TypeError(f"no text form for {name}")
    value = _value(text, name)
    refused = F.raise_error(F.concat(F.lit(f"not a {name}: "), text)).cast(kind)
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(value.isNotNull(), value).otherwise(refused)


def checked(text: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(value or null, whether the text was refused)."""
    name = kind.simpleString()
    if name == "string":
        return text, F.lit(False)
    value = _value(text, name)
    return value, text.isNotNull() & value.isNull()
