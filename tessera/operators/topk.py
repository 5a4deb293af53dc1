"""Top-k per group and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank; rows beyond k are dropped before the shuffle too."""
    if not by:
        return df.orderBy(*order).limit(k)
    over = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(over)).where(F.col(rank) <= k)
