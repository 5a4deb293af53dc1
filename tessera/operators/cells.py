"""An index of vectors in k-means cells, for approximate nearest neighbours.

Centres are fitted on a bounded sample; every row is placed in the cell of its nearest
centre and written with it. A query meets the rows of the cells whose centres are
nearest to it. How many cells that takes for a recall is measured on the sample, whose
own neighbours are known.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.nearest import block_product


def _kmeans(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from rows spread over the sample; a centre without rows stays."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = _near(x, centres, 1)[:, 0]
        n = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _near(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    away = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.argsort(away, axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass
class CellIndex:
    """Rows (id, vector, cell) at ``path``, and the centres of the cells.

    Vectors have one length; rows whose vector is null are left out.
    """

    rows: DataFrame
    centres: np.ndarray
    sample: np.ndarray

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, vector_col: str, path: str, cells: int = 64, sample: int = 8192) -> CellIndex:
        """Fit at most ``cells`` centres on ``sample`` rows, the least by a hash of their ids, and write all rows below ``path``."""
        spark = rows.sparkSession
        slim = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        held = slim.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        x = _matrix(held.column("vector").combine_chunks()) if held.num_rows else np.zeros((0, 0))
        centres = _kmeans(x, min(cells, max(len(x) // 32, 1))) if len(x) else np.zeros((0, 0))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = _near(_matrix(batch.column(1)), centres, 1)[:, 0] if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

        slim.mapInArrow(place, "id long, vector array<float>, cell int").write.partitionBy("cell").parquet(f"{path}/rows")
        model = json.dumps({"centres": centres.tolist(), "sample": x.tolist()})
        spark.createDataFrame([(model,)], "model string").write.parquet(f"{path}/model")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CellIndex:
        model = json.loads(spark.read.schema("model string").parquet(f"{path}/model").first()["model"])
        rows = spark.read.schema("id long, vector array<float>, cell int").parquet(f"{path}/rows")
        return cls(rows, np.array(model["centres"]), np.array(model["sample"]))

    def probes(self, k: int, recall: float, queries: int = 512) -> int:
        """The least number of cells that gives the sampled rows ``recall`` of their ``k`` nearest among themselves."""
        x, n = self.sample, len(self.centres)
        if len(x) <= k or n <= 1:
            return n
        asked = np.arange(0, len(x), max(len(x) // queries, 1))
        near, cell = _near(x[asked], self.centres, n), _near(x, self.centres, 1)[:, 0]
        rank = np.argsort(near, axis=1)  # of each cell, for each query
        s = x[asked] @ x.T
        s[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-s, k, axis=1)[:, :k]
        needed = np.sort(np.take_along_axis(rank, cell[best], axis=1).ravel()) + 1
        return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1])

    def search(self, queries: DataFrame, k: int, id_col: str, vector_col: str, probes: int, row_block: int = 4096, query_block: int = 256) -> DataFrame:
        """query_id, id, similarity and rank of the ``k`` rows of the probed cells with the largest dot product, other than the query itself; ties go to the smaller id."""
        centres = self.centres
        counts = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _near(_matrix(batch.column(1)), centres, probes).astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["id", "vector", "cells"])

        def gather(name: str):
            def run(key: tuple, own: pa.Table) -> pa.Table:
                ids, values = own.column("id").to_pylist(), own.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float64()))], names=["cell", f"{name}_ids", f"{name}_values"])

            return run

        def blocks(df: DataFrame, held: dict[int, int], size: int, name: str) -> DataFrame:
            # A cell of many rows is many blocks.
            parts = F.create_map(*[F.lit(v) for c, n in held.items() for v in (c, -(-n // size))]) if held else F.lit(None).cast("map<int, int>")
            part = F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(parts, F.col("cell")), F.lit(1)))
            return df.withColumn("part", part).groupBy("cell", "part").applyInArrow(gather(name), f"cell int, {name}_ids array<long>, {name}_values array<double>")

        slim = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        asked = slim.mapInArrow(probe, "id long, vector array<float>, cells array<int>").select("id", "vector", F.explode("cells").alias("cell"))
        many = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        met = blocks(self.rows, counts, row_block, "r").join(blocks(asked, many, query_block, "q"), "cell").select("q_ids", "q_values", "r_ids", "r_values")
        found = met.mapInArrow(block_product(k), "query_id long, id long, similarity double")
        over = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
        return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
