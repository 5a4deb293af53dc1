"""Results that are read more than once, written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tessera.streaming.runner import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a plain scan of what it was written to; a lost executor costs another read."""
    path = f"{shared_folder(df.sparkSession)}/tessera-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
