"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip_html, tokens, upper_eszett
from tessera.tables import table, tables

_ADDRESS = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def string_functions(spark: SparkSession, d: str) -> DataFrame:
    """F1"""
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.length(n).cast("bigint").alias("length"), F.substring(n, 2, 3).alias("part"), F.reverse(n).alias("reversed"), F.lpad(n, 20, "*").alias("padded"), F.replace(n, F.lit(" "), F.lit("_")).alias("joined"), F.instr(n, " ").cast("bigint").alias("at"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.left(n, F.lit(4)).alias("start"), F.initcap(F.split_part(n, F.lit(" "), F.lit(1))).alias("capital"))


def case_functions(spark: SparkSession, d: str) -> DataFrame:
    """F2"""
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lower(t).alias("low"), upper_eszett(t).alias("up"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """F3"""
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("md5"), F.sha2("c_name", 256).alias("sha256"))


def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """F4"""
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"))


def regex_functions(spark: SparkSession, d: str) -> DataFrame:
    """links and digits of a page."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(h, F.lit('href="[^"]*"'), F.lit(0))).cast("bigint").alias("links"), F.length(F.regexp_replace(h, "[0-9]+", "#")).cast("bigint").alias("masked"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """F6"""
    words = table(spark, d, "conversations").select(F.explode(F.split("text", "[ \\n]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def date_functions(spark: SparkSession, d: str) -> DataFrame:
    """F7"""
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).cast("bigint").alias("y"), F.month(t).cast("bigint").alias("m"), F.day(t).cast("bigint").alias("d"), F.quarter(t).cast("bigint").alias("q"), F.date_trunc("month", t).cast("timestamp_ntz").alias("month"), F.date_add(t.cast("date"), 45).alias("later"), F.datediff(F.lit("2000-01-01").cast("date"), t.cast("date")).cast("bigint").alias("days"), F.date_format(t, "yyyy-MM-dd").alias("text"))


def time_functions(spark: SparkSession, d: str) -> DataFrame:
    """time parts, and whole hours and minutes since a moment."""
    t, origin = F.col("ts"), F.lit("2023-12-31 17:30:00").cast("timestamp_ntz")
    parts = {"h": F.hour(t), "min": F.minute(t), "s": F.second(t)}
    since = {f"{u}s": F.timestamp_diff(u.upper(), origin, t) for u in ("hour", "minute")}
    return table(spark, d, "events").select("event_id", *[c.cast("bigint").alias(n) for n, c in {**parts, **since}.items()])


def address_counts(spark: SparkSession, d: str) -> DataFrame:
    """e-mail addresses in each document, and different ones."""
    found = F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(0))
    counts = F.size(found).cast("bigint").alias("addresses"), F.size(F.array_distinct(found)).cast("bigint").alias("kinds")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *counts)


def json_functions(spark: SparkSession, d: str) -> DataFrame:
    """F8: one value by path, by schema and as a variant."""
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").alias("path"), F.from_json(p, "k bigint")["k"].alias("typed"), F.variant_get(F.parse_json(p), "$.k", "bigint").alias("variant"))


def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """lambdas over the components of a vector, in thousandths."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000))
    return table(spark, d, "embeddings").select("vec_id", F.size(F.array_distinct(x)).cast("bigint").alias("kinds"), F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.size(F.filter(x, lambda v: v > 0)).cast("bigint").alias("positive"), F.aggregate(F.zip_with(F.slice(x, 1, 8), F.slice(x, 9, 8), lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("crossed"), F.array_max(x).alias("top"))


def math_functions(spark: SparkSession, d: str) -> DataFrame:
    """F10"""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("abs"), F.ceil("c_acctbal").cast("bigint").alias("up"), F.floor("c_acctbal").cast("bigint").alias("down"), F.signum("c_acctbal").cast("bigint").alias("sign"), F.pmod(k, F.lit(7)).cast("bigint").alias("mod"), F.round(F.sqrt(k.cast("double")), 6).alias("root"), k.bitwiseAND(F.lit(6)).alias("anded"), k.bitwiseXOR(F.lit(5)).alias("xored"), F.shiftleft(k, 2).alias("shifted"), F.bit_count(k).cast("bigint").alias("ones"))


def null_functions(spark: SparkSession, d: str) -> DataFrame:
    """F11"""
    return spark.sql("""
        SELECT p_partkey, try_cast(p_name AS int) AS number, try_divide(CAST(p_size AS double), p_partkey % 5) AS ratio, nullif(p_type, 'SMALL') AS kind,
               coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand, CAST(greatest(p_size, 10) AS bigint) AS most, CAST(least(p_size, 10) AS bigint) AS least FROM {part}""", **tables(spark, d, "part"))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """F12"""
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.md5(strip_html(F.col("html"))).alias("text_md5"))


def token_lists(spark: SparkSession, d: str) -> DataFrame:
    """number of words and of different words of each turn."""
    w = tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(w).cast("bigint").alias("words"), F.size(F.array_distinct(w)).cast("bigint").alias("kinds"))


_FNS = (string_functions, case_functions, hashes, edit_distance, regex_functions, address_counts, word_counts, date_functions, time_functions, json_functions, array_functions, math_functions, null_functions, page_fields, token_lists)
QUERIES = {f.__name__: f for f in _FNS}
ORACLE_SQL = {
    "string_functions": """
        SELECT p_partkey, length(p_name) AS length, substring(p_name, 2, 3) AS part, reverse(p_name) AS reversed, lpad(p_name, 20, '*') AS padded,
               replace(p_name, ' ', '_') AS joined, CAST(instr(p_name, ' ') AS BIGINT) AS at, trim('  ' || p_name || ' ') AS trimmed, left(p_name, 4) AS start,
               upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] AS capital FROM part""",
    "case_functions": "SELECT conv_id, turn, lower(text) AS low, upper(replace(text, 'ß', 'ss')) AS up FROM conversations",
    "hashes": "SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha256 FROM customer",
    "edit_distance": "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part",
    "regex_functions": """
        SELECT page_id, CAST(len(regexp_extract_all(html, 'href="[^"]*"')) AS BIGINT) AS links, length(regexp_replace(html, '[0-9]+', '#', 'g')) AS masked FROM pages""",
    "address_counts": f"""
        WITH f AS (SELECT doc_id, regexp_extract_all(text, '{_ADDRESS}') AS x FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(len(x) AS BIGINT) AS addresses, CAST(len(list_distinct(x)) AS BIGINT) AS kinds FROM f""",
    "time_functions": """
        SELECT event_id, hour(ts) AS h, minute(ts) AS min, second(ts) AS s, date_sub('hour', TIMESTAMP '2023-12-31 17:30:00', ts) AS hours,
               date_sub('minute', TIMESTAMP '2023-12-31 17:30:00', ts) AS minutes FROM events""",
    "word_counts": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1",
    "date_functions": """
        SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q,
               CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(o_orderdate AS DATE) + 45 AS later,
               date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders""",
    "json_functions": """
        SELECT event_id, json_extract_string(props, '$.k') AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS typed,
               CAST(props ->> '$.k' AS BIGINT) AS variant FROM events""",
    "array_functions": """
        WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT)) AS x FROM embeddings)
        SELECT vec_id, CAST(len(list_distinct(x)) AS BIGINT) AS kinds, CAST(list_sum(x) AS BIGINT) AS total,
               CAST(len(list_filter(x, lambda v: v > 0)) AS BIGINT) AS positive,
               CAST(list_sum(list_transform(list_zip(x[1:8], x[9:16]), lambda p: p[1] * p[2])) AS BIGINT) AS crossed, list_max(x) AS top FROM x""",
    "math_functions": """
        SELECT c_custkey, abs(c_acctbal) AS abs, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, CAST(sign(c_acctbal) AS BIGINT) AS sign,
               CAST(c_custkey % 7 AS BIGINT) AS mod, round(sqrt(CAST(c_custkey AS DOUBLE)), 6) AS root, c_custkey & 6 AS anded, xor(c_custkey, 5) AS xored,
               c_custkey << 2 AS shifted, CAST(bit_count(c_custkey) AS BIGINT) AS ones FROM customer""",
    "null_functions": """
        SELECT p_partkey, try_cast(p_name AS INTEGER) AS number, CAST(p_size AS DOUBLE) / nullif(p_partkey % 5, 0) AS ratio, nullif(p_type, 'SMALL') AS kind,
               coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand, CAST(greatest(p_size, 10) AS BIGINT) AS most, CAST(least(p_size, 10) AS BIGINT) AS least FROM part""",
    "page_fields": """
        SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM pages""",
    "token_lists": """
        WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations)
        SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS BIGINT) AS kinds FROM w""",
}
