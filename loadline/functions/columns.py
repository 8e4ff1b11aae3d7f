"""Adding several SQL-text columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_exprs(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})
