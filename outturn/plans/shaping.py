"""Plain result columns, so a query and its SQL check compare value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, arrays joined by ``|``, whole numbers as bigint, doubles rounded."""
    columns = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), "|")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            value = F.round(value.cast("double"), digits)
        elif isinstance(field.dataType, _WHOLE):
            value = value.cast("bigint")
        columns.append(value.alias(field.name))
    return df.select(*columns)
