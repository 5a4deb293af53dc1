"""User-defined functions, all on Arrow batches.

They are made inside functions so that executors need not import this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def vowel_count():
    """Scalar: vowels of a text."""

    @F.pandas_udf("long")
    def vowels(s: pd.Series) -> pd.Series:
        return s.fillna("").str.count("[aeiou]")

    return vowels


def spread():
    """Aggregate: largest less smallest value of a group."""

    @F.pandas_udf("double")
    def between(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return between


def running_balance() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Grouped map: cumulative cents in the order of keys, never under zero."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total, out = 0, []
        rows = rows.sort_values("event_id")
        for c in rows["cents"]:
            total = max(0, total + int(c))
            out.append(total)
        return pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "balance": out})

    return run


def batches_of(transform: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A transform of frames as one of batches, for mapInPandas."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield transform(f)

    return run


def halves():
    """Table function: a text's two halves with their place."""

    @F.udtf(returnType="place int, half string")
    class Halves:
        def eval(self, text: str):
            if text is not None:
                middle = len(text) // 2
                yield 0, text[:middle]
                yield 1, text[middle:]

    return Halves


def kind_counts():
    """Table function over a partitioned table: the partition's key and a count for each named kind.

    Arguments: the table, partitioned by its first column, with the kind in its second, and
    the kinds as text with commas. Its columns depend on both. Rows are counted as they come.
    """

    @F.udtf
    class KindCounts:
        @staticmethod
        def analyze(rows: AnalyzeArgument, kinds: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or kinds.value is None:
                raise ValueError("a table and a constant list of kinds are needed")
            key = rows.dataType.fields[0]
            counts = [StructField(f"n_{k.strip()}", LongType()) for k in kinds.value.split(",")]
            return AnalyzeResult(StructType([StructField(key.name, key.dataType), *counts]))

        def __init__(self):
            self.key, self.counts = None, None

        def eval(self, row: Row, kinds: str):
            if self.counts is None:
                self.key, self.counts = row[0], dict.fromkeys((k.strip() for k in kinds.split(",")), 0)
            if row[1] in self.counts:
                self.counts[row[1]] += 1

        def terminate(self):
            if self.counts is not None:
                yield self.key, *self.counts.values()

    return KindCounts
