"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, late_sessions, minhash, mixing, near_copies, packing, quality, rollups, scratch, sharding, simhash, substring_dedup, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as hosts, their languages as paths."""
    scored = quality.score(_documents(spark, sf_dir), _labels(spark, sf_dir), host="source", path="lang", sample=20_000)
    return scored.select("doc_id", "evidence", "host_share", "path_share", "posterior", "kept")


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_documents(spark, sf_dir), length=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with estimated counts; a second batch revises every one to its real counts.

    A third deletes all documents, a fourth enters them again, the folders are folded
    into one, and a retry of the first batch changes nothing.
    """
    docs = _documents(spark, sf_dir)
    store = rollups.Store(spark, scratch.new_path(spark, "rollups"))
    estimated = rollups.estimate_tokens(docs)
    counted = scratch.materialize(rollups.count_tokens(docs), "counts")
    store.commit("load", rollups.changes(None, estimated))
    store.commit("count", rollups.changes(estimated, counted))
    store.commit("remove", rollups.changes(counted, None))
    store.commit("return", rollups.changes(None, counted))
    store.compact()
    store.commit("load", rollups.changes(None, estimated))
    scratch.drop(counted)
    return store.totals()


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 in turn, at most 3 copies."""
    mixed = mixing.mix(_documents(spark, sf_dir), weights=(1.0, 2.0, 3.0), cap=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_groups(_documents(spark, sf_dir), shingle=4, seed=42, budget=4)
    return grouped.select("doc_id", "fingerprint", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: 16 shards in two regions of two racks, then one more."""
    placed = sharding.assign(_documents(spark, sf_dir), sharding.topology(16), sharding.topology(17, 16))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), most=1024, end_id=0)


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of users, in batches of half an hour of which some turns come up to three late."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    versions = late_sessions.late_sessions(late_sessions.conversation_events(conversations), gap=240)
    return versions.select("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; those divisible by 7 change their label first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    found = hard_negatives.hard_negatives(relabelled, F.col("id") % 100 == 0, scale=256, positives=5, negatives=5, least=80)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, and read back by their index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages, least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def near_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of all documents by MinHash bands and the trie, as in the pipeline: the row of each that stays, by group."""
    return near_copies.near_copies(_documents(spark, sf_dir), shingle=5, similarity=0.8).select("doc_id", "component_id", F.col("keeper").alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_fingerprints": op2_minhash_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_rollups": op5_token_rollups,
    "op6_mixing": op6_mixing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_late_sessions": op11_late_sessions,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
    "near_copy_groups": near_copy_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        earliest AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
        hit AS (SELECT doc_id, i FROM win JOIN earliest USING (s) WHERE least < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
            FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
               h AS text_sha256
        FROM t
    """,
    "op11_late_sessions": r"""
        WITH poly AS (
            SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
        turns AS (
            SELECT conv_id, turn, unnest([1, 2]) AS k, unnest([CAST(conv_id AS VARCHAR), conv_id || ':' || turn]) AS s
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        crc AS (
            SELECT DISTINCT s, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) AS v
            FROM turns, poly),
        hashed AS (
            SELECT o.conv_id, o.turn, c.v AS c, h.v AS h
            FROM conversations o JOIN crc c ON c.s = CAST(o.conv_id AS VARCHAR) JOIN crc h ON h.s = o.conv_id || ':' || o.turn),
        timed AS (
            SELECT 2 * CAST(floor(conv_id / 8) AS BIGINT) + c % 2 AS u, c // 2 % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM hashed),
        e AS (SELECT u, s, h, CAST(floor(s / 1800) AS BIGINT) + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS b FROM timed),
        so_far AS (
            SELECT k.b AS upto, e.*, CASE WHEN s - lag(s) OVER (PARTITION BY k.b, u ORDER BY s) <= 240 THEN 0 ELSE 1 END AS starts
            FROM (SELECT DISTINCT b FROM e) k JOIN e ON e.b <= k.b),
        islands AS (SELECT *, sum(starts) OVER (PARTITION BY upto, u ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM so_far),
        v AS (
            SELECT u, upto AS b, min(s) AS lo, max(s) AS hi, count(*) AS n, count(*) FILTER (b = upto) AS n_new, CAST(sum(h) AS BIGINT) AS h_sum
            FROM islands GROUP BY u, upto, island HAVING count(*) FILTER (b = upto) > 0),
        gone AS (
            SELECT v.u, v.b, v.lo, min(w.b) AS by_b, arg_min(w.lo, w.b) AS by_lo
            FROM v JOIN v w ON w.u = v.u AND w.b > v.b AND w.lo <= v.lo AND w.hi >= v.hi GROUP BY v.u, v.b, v.lo),
        took AS (SELECT u, by_b AS b, by_lo AS lo, count(*) AS n FROM gone GROUP BY u, by_b, by_lo)
        SELECT v.u AS "user", v.b AS batch, v.lo AS start_s, v.hi AS end_s, v.n AS n_events, n_new, coalesce(took.n, 0) AS n_retracted, h_sum,
               by_b AS retracted_batch, by_lo AS retracted_start_s
        FROM v LEFT JOIN gone USING (u, b, lo) LEFT JOIN took USING (u, b, lo)
    """,
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
            FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
        n AS (
            SELECT p.a, p, ps, b, s, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b) AS k
            FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps)
        SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
        FROM n WHERE k <= 5
    """,
    "op13_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        h AS (SELECT page_id, t, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS most FROM p),
        five AS (
            SELECT page_id, t, most, list_transform(range(32), lambda i:
                (CAST('0x' || substring(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) AS d
            FROM h)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(d, lambda v: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> most THEN most END AS refers_to
        FROM five
    """,
    # All pairs by brute force: at this size the bands miss none.
    "near_copy_groups": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS x FROM w),
        c AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS class_id FROM s),
        r AS (SELECT class_id, len(x) AS n, unnest(x) AS t FROM c WHERE doc_id = class_id),
        b AS (SELECT a.class_id AS u, b.class_id AS v, count(*) AS common, any_value(a.n + b.n) AS sizes FROM r a JOIN r b ON a.t = b.t AND a.class_id < b.class_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM b WHERE 10 * common >= 8 * (sizes - common) UNION SELECT v, u FROM b WHERE 10 * common >= 8 * (sizes - common)),
        walk(a, z) AS (SELECT DISTINCT class_id, class_id FROM c UNION SELECT a, v FROM walk JOIN e ON u = z)
        SELECT doc_id, least_id AS component_id, doc_id = least_id AS kept FROM c JOIN (SELECT a, min(z) AS least_id FROM walk GROUP BY a) ON a = class_id
    """,
}
