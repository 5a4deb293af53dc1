"""Vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators.cells import CellIndex
from tessera.operators.nearest import nearest
from tessera.streaming.runner import shared_folder
from tessera.tables import table


def label_cosine(spark: SparkSession, d: str) -> DataFrame:
    """V1: each vector's cosine with the mean of its label's vectors; means are one partial aggregate per component."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg((F.sum(F.col("x").cast("double")) / F.count("*")).alias("x"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    return e.join(means, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    """V2: the 5 nearest of every vector whose id is divisible by 50, against all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = nearest(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the index, the approximate neighbours, and the exact ones, of vectors whose id is divisible by 50."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    path = f"{shared_folder(spark)}/tessera-tables/cells-{uuid.uuid4().hex}"
    index = CellIndex.build(e, "vec_id", "embedding", path)
    asked = e.where("vec_id % 50 = 0")
    found = index.search(asked, 5, "vec_id", "embedding", index.probes(5, 0.97))
    return index.rows, found, nearest(asked, e, 5, "vec_id", "embedding")


def knn_indexed(spark: SparkSession, d: str) -> DataFrame:
    """V2 by an index of k-means cells, written and read again; as many cells are probed as a recall of 0.97 takes on the sample."""
    return _indexed(spark, d)[1].select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


def knn_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """V2: whether the index holds every vector, and gives at least 0.9 of the exact neighbours."""
    rows, found, exact = _indexed(spark, d)
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = both.agg(F.countDistinct("query_id").alias("queries"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("recalled"))
    return recall.crossJoin(rows.agg(F.count(F.lit(1)).alias("indexed")))


QUERIES = {f.__name__: f for f in (label_cosine, knn, knn_indexed, knn_index_recall)}
ORACLE_SQL = {
    "knn_index_recall": "SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, true AS recalled, count(*) AS indexed FROM embeddings WHERE embedding IS NOT NULL",
    "label_cosine": """
        WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        p AS (SELECT label, i, sum(CAST(x AS DOUBLE)) / count(*) AS x FROM x GROUP BY 1, 2),
        m AS (SELECT label, list(x ORDER BY i) AS mean FROM p GROUP BY 1)
        SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean), 6) AS cosine FROM embeddings e JOIN m ON e.label = m.label""",
    "knn": """
        WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS s
                   FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
        SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 6) AS similarity FROM s QUALIFY rank <= 5""",
}
