"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round real columns at the very end, so float summation order does not show."""
    # The trailing + 0.0 turns a negative zero into a plain one.
    return df.select(*[
        (F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])
