import hashlib
import re
from collections import defaultdict

import pytest
from parity import compare, connect

from tessera.llm import exact_dedup, queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, g in groups.items():
        best = min(g)
        for j, x in enumerate(sorted(g)):
            out.append((x[3], best[3], len(g), j == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cutting", [{}, {"mean": 64, "least": 17, "most": 100}])
def test_brute_force(docs_of, corpus, cutting):
    got = exact_dedup.exact_dedup(docs_of(corpus), **cutting).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus)


def test_fast_hash_clash(docs_of, spark):
    """Contents under one fast hash are told apart by their digest."""
    real = exact_dedup.recipes

    def clashing(*args, **kw):
        from pyspark.sql import functions as F

        same = real(*args, **kw)
        return same.withColumn("signature", F.lit(1).cast("long")).withColumn("chunks", F.transform("chunks", lambda c: F.struct(F.lit(7).cast("long").alias("h"), c["digest"].alias("digest"), c["length"].alias("length"))))

    exact_dedup.recipes = clashing
    try:
        rows = [(1, "one text"), (2, "two texts"), (3, "onetext"), (4, ""), (5, None)]
        got = exact_dedup.exact_dedup(docs_of(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    finally:
        exact_dedup.recipes = real


def test_empty(docs_of):
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0


def test_sql(spark):
    compare(queries.op4_exact_dedup(spark, SF), connect(SF), queries.ORACLE_SQL["op4_exact_dedup"])
