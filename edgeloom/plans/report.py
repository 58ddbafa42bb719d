"""Engine-neutral presentation of a result for cross-engine comparison.

Dates become ``YYYY-MM-DD`` text and timestamps ``YYYY-MM-DD HH:MM:SS.ffffff``
text (pandas receives Spark dates as ``date`` objects but DuckDB dates as
timestamps); small integers widen to BIGINT. It is a final projection only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def report(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
