"""COPY text: typed columns to lines and back, in built-in expressions.

A line is the columns, escaped, between tabs; ``\\N`` is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of COPY text: what stands for a control character.
ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def escape(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.coalesce(out, F.lit("\\N"))


def unescape(field: Column) -> Column:
    # Doubled backslashes stand aside as U+0000, which no text of a database holds.
    out = F.replace(field, F.lit("\\\\"), F.lit("\0"))
    for plain, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.when(field != "\\N", F.replace(out, F.lit("\0"), F.lit("\\")))


def _text(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    return value.cast("string")


def to_lines(df: DataFrame) -> DataFrame:
    """One column ``line`` of COPY text of all columns, in the order of the rows."""
    fields = [escape(_text(f.name, f.dataType)) for f in df.schema.fields]
    return df.select(F.concat_ws("\t", *fields).alias("line"))


def typed(lines: Column, schema: T.StructType) -> list[Column]:
    """The columns of ``schema`` from a column of lines; a value that doesn't fit its type is an error."""
    fields = F.split(lines, "\t", -1)
    out = []
    for i, f in enumerate(schema.fields):
        value = unescape(F.get(fields, F.lit(i)))
        if isinstance(f.dataType, T.BinaryType):
            value = F.unhex(F.substring(value, F.lit(3), F.length(value)))
        elif isinstance(f.dataType, T.BooleanType):
            value = F.when(value == "t", True).when(value == "f", False)
        else:
            value = value.cast(f.dataType)
        out.append(value.alias(f.name))
    return out
