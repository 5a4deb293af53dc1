"""Exact nearest neighbours of a stated query set, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _blocks(df: DataFrame, id_col: str, vector_col: str, size: int, name: str) -> DataFrame:
    """Rows gathered into blocks of about ``size``: ids, and vectors end to end."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)], pa.list_(pa.float64()))], [f"{name}_ids", f"{name}_values"])

    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col).mapInArrow(gather, f"{name}_ids array<long>, {name}_values array<double>")


def block_product(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of q_ids, q_values, r_ids, r_values: query_id, id and similarity of the ``k`` best of a block of rows for each query of a block."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, r_ids, r = (np.array(batch.column(c)[i].values) for c in range(4))
                if not len(q_ids) or not len(r_ids):
                    continue
                s = q.reshape(len(q_ids), -1) @ r.reshape(len(r_ids), -1).T
                s[q_ids[:, None] == r_ids[None, :]] = -np.inf
                # Those that reach the k-th largest product; of more, by ties, the smaller ids.
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if k < s.shape[1] else np.full((len(q_ids), 1), -np.inf)
                which, place = np.nonzero((s >= least) & np.isfinite(s))
                order = np.lexsort((r_ids[place], -s[which, place], which))
                which, place = which[order], place[order]
                first = np.arange(len(which)) - np.searchsorted(which, which) < k
                which, place = which[first], place[first]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[which]), pa.array(r_ids[place]), pa.array(s[which, place])], ["query_id", "id", "similarity"])

    return product


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str, query_block: int = 256, row_block: int = 4096, held: int = 16_384, held_bytes: int = 64 << 20) -> DataFrame:
    """query_id, id, similarity and rank of the ``k`` rows with the largest dot product, other than the query itself.

    Vectors have one length. Blocks of queries meet blocks of rows; a pair of blocks
    is one matrix product and leaves k rows per query, which a window merges. Ties
    go to the smaller id.

    Up to ``held`` queries of up to ``held_bytes`` in all are broadcast to the blocks of
    rows. More are dealt over groups of about that many, and rows over as many parts as a shuffle has; blocks of a
    group and a part meet by an equi-join, so that no task holds more than a group.
    """

    r, q = _blocks(rows, id_col, vector_col, row_block, "r"), _blocks(queries, id_col, vector_col, query_block, "q")
    longest = queries.agg(F.max(F.size(vector_col))).first()[0] or 0
    held = max(min(held, held_bytes // (8 * max(longest, 1))), 1)
    if queries.limit(held + 1).count() <= held:
        pairs = r.crossJoin(F.broadcast(q))
    else:
        groups, parts = -(-queries.count() // held), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def dealt(df: DataFrame, ids: str, own: str, n: int, other: str, m: int) -> DataFrame:
            return df.withColumn(own, F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        pairs = dealt(r, "r_ids", "part", parts, "group", groups).join(dealt(q, "q_ids", "group", groups, "part", parts), ["group", "part"])
    pairs = pairs.select("q_ids", "q_values", "r_ids", "r_values")
    found = pairs.mapInArrow(block_product(k), "query_id long, id long, similarity double")
    over = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
