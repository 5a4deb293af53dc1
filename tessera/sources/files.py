"""File sources and sinks with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Options that make text formats return what was written.
OPTIONS = {
    "csv": {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "orc": {},
    "parquet": {},
}


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """A table of files. The schema is stated: inferring one reads all data once more."""
    return spark.read.options(**OPTIONS[kind]).schema(schema).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    df.write.options(**OPTIONS[kind]).partitionBy(*partition_by or []).mode(mode).format(kind).save(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, by: list[str]) -> None:
    """A warehouse table whose later joins and aggregations on ``by`` need no shuffle."""
    df.write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite").saveAsTable(name)
