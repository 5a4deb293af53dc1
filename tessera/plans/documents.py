"""Similarity of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.similarity import shingles, similar_sets
from tessera.tables import table


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similar_sets(table(spark, d, "documents"), "doc_id", shingles(F.col("text"), 5), 0.8)


def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """D2 over all documents: pairs of different sets of five-word shingles whose Jaccard likeness is 0.8 or more."""
    return _similar(spark, d)[1]


def similar_classes(spark: SparkSession, d: str) -> DataFrame:
    """D2 by document: the least doc_id with the same shingles, and how many other sets are alike."""
    members, pairs = _similar(spark, d)
    ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class_id", "left").select(F.col("id").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


QUERIES = {f.__name__: f for f in (similar_documents, similar_classes)}
_SETS = r"""
        w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM w WHERE len(w) > 0),
        c AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS class_id FROM s),
        r AS (SELECT class_id, len(x) AS n, unnest(x) AS t FROM c WHERE doc_id = class_id),
        b AS (SELECT a.class_id AS left_id, b.class_id AS right_id, count(*) AS common, any_value(a.n + b.n) AS sizes
              FROM r a JOIN r b ON a.t = b.t AND a.class_id < b.class_id GROUP BY 1, 2),
        p AS (SELECT left_id, right_id, common, CAST(sizes - common AS BIGINT) AS total FROM b WHERE 10 * common >= 8 * (sizes - common))"""
ORACLE_SQL = {
    "similar_documents": f"WITH {_SETS} SELECT * FROM p",
    "similar_classes": f"""WITH {_SETS}, l AS (SELECT unnest([left_id, right_id]) AS class_id FROM p), k AS (SELECT class_id, count(*) AS n FROM l GROUP BY 1)
        SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM c LEFT JOIN k USING (class_id)""",
}
