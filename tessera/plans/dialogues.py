"""Queries on conversations: one row per turn, keyed by conversation and turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, tokens
from tessera.operators.topk import top_k
from tessera.tables import table

def _turns():
    return W.partitionBy("conv_id").orderBy("turn")


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def conv_summary(spark: SparkSession, d: str) -> DataFrame:
    """Turns by role, characters and last role of each conversation."""
    return (
        _conv(spark, d)
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("turns"),
            F.count_if(F.col("role") == "user").cast("bigint").alias("user_turns"),
            F.count_if(F.col("role") == "assistant").cast("bigint").alias("assistant_turns"),
            F.sum(F.length("text")).cast("bigint").alias("chars"),
            F.max_by("role", "turn").alias("last_role"),
        )
    )


def role_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each role's share of a conversation's characters."""
    per = _conv(spark, d).groupBy("conv_id", "role").agg(F.sum(F.length("text")).cast("bigint").alias("chars"))
    return per.select("conv_id", "role", "chars", (F.col("chars") / F.sum("chars").over(W.partitionBy("conv_id"))).alias("share"))


def role_transitions(spark: SparkSession, d: str) -> DataFrame:
    """C3"""
    pairs = _conv(spark, d).select("role", F.lead("role").over(_turns()).alias("next_role")).where("next_role IS NOT NULL")
    return pairs.groupBy("role", "next_role").agg(F.count("*").alias("n"))


def reply_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C4: each user turn with the assistant's reply."""
    nxt = _conv(spark, d).select("conv_id", "turn", "role", "text", F.lead("role").over(_turns()).alias("next_role"), F.lead("text").over(_turns()).alias("reply"))
    return nxt.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "reply")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as one string; its turns are ordered inside its group."""
    line = F.concat_ws(": ", "role", "text")
    turns = _conv(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return turns.select("conv_id", F.array_join(F.col("x.line"), "\n").alias("body"))


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """How often each turn has one of some words."""
    hits = F.size(F.regexp_extract_all(F.lower("text"), F.lit("the|que|der|les"), F.lit(0)))
    return _conv(spark, d).select("conv_id", "turn", hits.cast("bigint").alias("hits")).where("hits > 0")


def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """Term frequency and document frequency by conversation; counts are exact, the weight is rounded."""
    words = _conv(spark, d).select("conv_id", F.explode(tokens(F.col("text"))).alias("word"))
    tf = words.groupBy("conv_id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = _conv(spark, d).agg(F.countDistinct("conv_id").alias("n"))
    joined = tf.join(df, "word").crossJoin(F.broadcast(n))  # n is one row
    return joined.select("conv_id", "word", "tf", "df", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6).alias("weight"))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    """C8"""
    pairs = _conv(spark, d).select(F.explode(ngrams(tokens(F.col("text")), 2)).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n"))


def longest_turns(spark: SparkSession, d: str) -> DataFrame:
    """C9"""
    turns = _conv(spark, d).select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))
    return top_k(turns, 2, [F.col("chars").desc(), F.col("turn")], ["conv_id"]).withColumn("rank", F.col("rank").cast("bigint"))


def turn_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard likeness of the word sets of each turn and the one before it, as counts; pairs stay within a conversation."""
    w = F.array_distinct(tokens(F.col("text")))
    pairs = _conv(spark, d).select("conv_id", "turn", w.alias("w"), F.lag(w).over(_turns()).alias("v")).where("v IS NOT NULL")
    shared, either = F.size(F.array_intersect("w", "v")).cast("bigint"), F.size(F.array_union("w", "v")).cast("bigint")
    return pairs.select("conv_id", "turn", shared.alias("shared"), either.alias("either"), F.round(F.try_divide(shared, either), 6).alias("jaccard"))


QUERIES = {f.__name__: f for f in (conv_summary, role_shares, role_transitions, reply_pairs, rendered, keyword_hits, tf_idf, bigrams, longest_turns, turn_overlap)}
ORACLE_SQL = {
    "turn_overlap": """
        WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations),
        p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t),
        n AS (SELECT conv_id, turn, CAST(len(list_intersect(w, v)) AS BIGINT) AS shared, CAST(len(list_distinct(list_concat(w, v))) AS BIGINT) AS either FROM p WHERE v IS NOT NULL)
        SELECT conv_id, turn, shared, either, round(shared / nullif(either, 0), 6) AS jaccard FROM n""",
    "conv_summary": """
        SELECT conv_id, count(*) AS turns,
               CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS user_turns,
               CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS assistant_turns,
               CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) AS last_role
        FROM conversations GROUP BY conv_id""",
    "role_shares": """
        WITH p AS (SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2)
        SELECT conv_id, role, chars, chars / sum(chars) OVER (PARTITION BY conv_id) AS share FROM p""",
    "role_transitions": """
        SELECT role, next_role, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
        WHERE next_role IS NOT NULL GROUP BY 1, 2""",
    "reply_pairs": """
        SELECT conv_id, turn, text AS prompt, reply FROM (
            SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'""",
    "rendered": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1",
    "keyword_hits": "SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), 'the|que|der|les')) AS BIGINT) AS hits FROM conversations WHERE hits > 0",
    "tf_idf": """
        WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM conversations),
        tf AS (SELECT conv_id, word, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
        SELECT conv_id, word, tf, df, round(tf * ln((SELECT count(DISTINCT conv_id) FROM conversations) / df), 6) AS weight FROM tf JOIN df USING (word)""",
    "bigrams": """
        WITH w AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations),
        b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w)
        SELECT bigram, count(*) AS n FROM b GROUP BY 1""",
    "longest_turns": """
        SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank
        FROM conversations QUALIFY rank <= 2""",
}
