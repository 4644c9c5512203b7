"""Row changes and the changelog tables they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import coercion, naming

OPERATIONS = ("insert", "update", "delete", "read")
#: The columns every changelog begins with.
FIXED = ("_op", "_source_id", "_position", "_commit_timestamp_us")
#: Microseconds from 1970-01-01 to 2000-01-01, where the log's clock begins.
EPOCH_SHIFT = 946_684_800_000_000

_IMAGE = T.MapType(T.StringType(), T.StringType(), True)
#: A change, as a row: images hold text, null apart from the empty text.
EVENT = T.StructType(
    [
        T.StructField("schema", T.StringType(), False),
        T.StructField("table", T.StringType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("before", _IMAGE, True),
        T.StructField("after", _IMAGE, True),
        T.StructField("position", T.StringType(), False),
        T.StructField("commit_position", T.StringType(), False),
        T.StructField("commit_timestamp_us", T.LongType(), False),
    ]
)


def schema(columns: list[tuple[str, str]]) -> T.StructType:
    """The changelog of a table with these (name, source type) columns; these are always nullable."""
    fixed = [T.StructField(c, T.LongType() if c == FIXED[3] else T.StringType(), False) for c in FIXED]
    return T.StructType(fixed + [T.StructField(n, coercion.target_type(t), True) for n, t in columns])


def image(op: str | Column = "op") -> Column:
    """Deletes keep the image before the change, all others the one after."""
    return F.when(F.col(op) == "delete", F.col("before")).otherwise(F.col("after"))


def unix_micros(log_micros: Column) -> Column:
    """The log's clock to microseconds since 1970; at the end of the range it stays there."""
    most = 2**63 - 1
    return F.when(log_micros > most - EPOCH_SHIFT, F.lit(most)).otherwise(log_micros + EPOCH_SHIFT)


def rows(events: DataFrame, source_id: str, target: T.StructType) -> DataFrame:
    """Events of one table as rows of its changelog.

    Columns are found by name in the image; one that an event lacks is null, one that the table lacks
    is left out. A text that its column's type refuses raises, and with it the batch.
    """
    own = image()
    typed = [coercion.strict(own[f.name], f.dataType).alias(f.name) for f in target.fields[len(FIXED) :]]
    fixed = [F.col("op"), F.lit(source_id), F.col("position"), F.col("commit_timestamp_us")]
    return events.select(*[c.alias(n) for c, n in zip(fixed, FIXED)], *typed)


def checked(events: DataFrame, target: T.StructType) -> DataFrame:
    """Events with ``refused``: names of the columns whose type refuses the event's text."""
    own = image()
    wrong = [F.when(coercion.checked(own[f.name], f.dataType)[1], F.lit(f.name)) for f in target.fields[len(FIXED) :]]
    return events.withColumn("refused", F.array_compact(F.array(*wrong)))


def refused(events: DataFrame, target: T.StructType) -> DataFrame:
    """Events with a text that its column's type refuses, and the names of these columns: a dead-letter output."""
    return checked(events, target).where(F.size("refused") > 0)


def decoded(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines of JSON as events, with ``error``: the line itself where it is no change, else null."""
    shape = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in EVENT.fields], T.StructField("_broken", T.StringType(), True)])
    read = lines.withColumn("__e", F.from_json(F.col(text), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    missing = [F.col("__e")[f.name].isNull() for f in EVENT.fields if not f.nullable]
    bad = F.col("__e").isNull() | F.col("__e")["_broken"].isNotNull()
    for m in missing:
        bad = bad | m
    return read.select(*[F.when(~bad, F.col("__e")[f.name]).alias(f.name) for f in EVENT.fields], F.when(bad, F.coalesce(F.col(text), F.lit(""))).alias("error"))


def selected(events: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Events of the chosen tables (schema, table); None: of all. The choice is small and joined by broadcast up to Spark's own threshold."""
    if tables is None:
        return events
    return events.join(tables.select("schema", "table").distinct(), ["schema", "table"], "left_semi")


def targets(events: DataFrame, source_id: str) -> DataFrame:
    """(namespace, table) that each event goes to."""
    return events.withColumn("namespace", F.lit(naming.namespace_of(source_id))).withColumn("target", naming.table_name(F.col("schema"), F.col("table")))
