"""Operators and stages on tables that are not rows of one Parquet file."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, minhash, mixing, near_copies, packing, quality, scratch, sharding, simhash, substring_dedup

LONG = " ".join(f"word{i}" for i in range(70))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("derived"))
    rows = [(i, f"{LONG} own{i // 2}", "en", "ab"[i % 2], i) for i in range(6)] + [(None, None, None, None, None), (9, "", "de", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


DERIVED = {
    "explode": lambda d: d.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x"),
    "join": lambda d: d.join(d.select(F.lit("en").alias("lang")), "lang"),
    "union": lambda d: d.unionByName(d),
    "sample": lambda d: d.sample(True, 2.0, 3),
    "random": lambda d: d.where(F.rand(1) < 0.7),
    "self-join": lambda d: d.join(d.select(F.col("doc_id").alias("doc_id2")), F.col("doc_id") >= F.col("doc_id2")).drop("doc_id2"),
    "limit": lambda d: d.orderBy("doc_id").limit(5),
    "twice": lambda d: d.sparkSession.read.parquet(*[d.inputFiles()[0]] * 2),
}

OPERATORS = {
    "op1": lambda s, d, f: quality.score(d, s.read.parquet(f"{f}/labels.parquet")),
    "op2": lambda s, d, f: minhash.compare_with_next(d),
    "op3": lambda s, d, f: substring_dedup.substring_dedup(d, rows=True),
    "op4": lambda s, d, f: exact_dedup.exact_dedup(d),
    "op6": lambda s, d, f: mixing.mix(d),
    "op7": lambda s, d, f: simhash.near_groups(d),
    "op9": lambda s, d, f: sharding.assign(d, sharding.topology(4)),
    "near": lambda s, d, f: near_copies.near_copies(d),
}


@pytest.mark.parametrize("how", DERIVED)
def test_rows_told_apart(spark, base, how):
    """Every row counts once: as many results as rows, all with places of their own, and one keeper for equal texts."""
    docs = scratch.materialize(DERIVED[how](spark.read.parquet(f"{base}/documents.parquet")), "plain")
    rows = docs.collect()
    ids = Counter(r["doc_id"] for r in rows)
    texts = {"".join((r["text"] or "").split()) for r in rows}
    # What the operators see is the derived table; the plain one has the same rows, as seeds and inputs are fixed.
    derived = DERIVED[how](spark.read.parquet(f"{base}/documents.parquet"))
    for name in ("op4", "op3", "near") if how in ("explode", "sample") else ("op4", "op3"):
        got = OPERATORS[name](spark, derived, base).collect()
        assert Counter(r["doc_id"] for r in got) == ids, name
        if "row" in got[0].__fields__:
            assert len({r["row"] for r in got}) == len(got), name
        if name == "op4":
            assert sum(r["kept"] for r in got) == len(texts)
            assert all(r["kept"] or r["group_size"] > 1 for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_exploded_rows(spark, base, name):
    docs = DERIVED["explode"](spark.read.parquet(f"{base}/documents.parquet"))
    got = OPERATORS[name](spark, docs, base).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({i: 2 for i in (*range(6), 9, None)})


def test_stages_keep_clashing_columns(spark, base):
    """Columns with names that stages use, or used, for themselves."""
    names = ["tessera_row", "tessera_copy", "tessera_copies", "row", "row_", "copies", "copy", "_tessera_row", "node", "_metadata"]
    docs = spark.read.parquet(f"{base}/documents.parquet").select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, base)
        assert got.columns == docs.columns, name
        assert all(r[n] == n for r in got.collect() for n in names)
    removed = substring_dedup.remove_repeats(docs.withColumn("spans", F.lit(1)))
    assert removed.columns == [*docs.columns, "spans"] and removed.count() == 8
    assert packing.pack(docs).count() > 0


def test_very_long_text(spark, base, tmp_path):
    """Stages read a text of a million characters whole: its tail decides."""
    body = " ".join(f"w{i}" for i in range(150_000))
    other = " ".join(f"w{i}" if i < 100_000 else f"x{i}" for i in range(150_000))
    spark.createDataFrame([(1, body, "en", "a", 0), (2, body + " tail", "en", "a", 0), (3, body + " tail", "en", "a", 0), (4, other, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    assert corpus_pipeline.exact_stage(spark, docs, base).count() == 3
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, base).collect()) == [1, 4]
    assert corpus_pipeline.quality_stage(spark, docs, base).count() in (0, 4)
    assert corpus_pipeline.mixing_stage(spark, docs, base).count() == 4
