from collections import Counter

import pytest
from test_packing import ids_of

from tessera.llm import queries, rollups, scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "source string, lang string, tokenizer string, tokens long"


@pytest.fixture
def store(spark):
    return rollups.Store(spark, scratch.new_path(spark, "rollups"))


def totals(store):
    return {tuple(r[k] for k in rollups.KEYS): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_batches(spark, store):
    assert totals(store) == {}
    first = frame(spark, [("a", "en", "v1", 10), ("a", "en", "v1", 5), ("a", None, "v1", 7), (None, "en", "v1", 1), ("b", "de", "v2", None)])
    assert store.commit("1", rollups.changes(None, first))
    want = {("a", "en", "v1"): (2, 15), ("a", None, "v1"): (1, 7), (None, "en", "v1"): (1, 1), ("b", "de", "v2"): (1, 0)}
    assert totals(store) == want
    assert not store.commit("1", rollups.changes(None, first)) and totals(store) == want

    revised = rollups.changes(frame(spark, [("a", "en", "v1", 10), ("a", None, "v1", 7)]), frame(spark, [("a", "en", "v1", 12), ("c", None, "v1", 7)]))
    assert store.commit("2", revised)
    assert store.commit("3", rollups.changes(frame(spark, [(None, "en", "v1", 1)]), None))
    want = {("a", "en", "v1"): (2, 17), ("c", None, "v1"): (1, 7), ("b", "de", "v2"): (1, 0)}
    assert totals(store) == want
    for _ in range(2):
        store.compact()
        assert totals(store) == want
        assert not store.commit("2", revised) and totals(store) == want
    assert store.commit("4", rollups.changes(None, first.where("false")))
    assert totals(store) == want


def test_two_writers(spark, store):
    """Of two writers of one batch, staged at the same time, one gets it in."""
    path = f"{store.path}/log/{store._name('x')}"
    staged = [store._staged() for _ in range(2)]
    for s in staged:
        rollups.changes(None, frame(spark, [("a", "en", "v", 3)])).write.parquet(f"{s}/totals")
    assert [store._rename(s, path) for s in staged] == [True, False]
    assert totals(store) == {("a", "en", "v"): (1, 3)}


def test_lost_writer(spark, store):
    """What a writer staged but didn't commit doesn't count, and its batch can be committed again."""
    frame(spark, [("a", "en", "v", 3)]).write.parquet(f"{store._staged()}/totals")
    assert totals(store) == {}
    assert store.commit("x", rollups.changes(None, frame(spark, [("a", "en", "v", 3)])))


def test_counts(docs_of, corpus, spark):
    got = rollups.count_tokens(docs_of(corpus)).groupBy(*rollups.KEYS).sum("tokens").collect()
    want = Counter()
    for _, t, lang, source in corpus:
        want[source, lang, "byte_bpe_50k"] += len(ids_of(t)) - 1
        want[source, lang, "words"] += len((t or "").encode().split())
    assert {tuple(r)[:3]: r[3] for r in got} == dict(want)
    assert rollups.count_tokens(docs_of([])).count() == 0


def test_query(spark):
    got = {tuple(r[k] for k in rollups.KEYS): (r["n_docs"], r["n_tokens"]) for r in queries.op5_token_rollups(spark, SF).collect()}
    docs, n = Counter(), Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for t, tokens in (("byte_bpe_50k", len(ids_of(r["text"])) - 1), ("words", len(r["text"].encode().split()))):
            docs[r["source"], r["lang"], t] += 1
            n[r["source"], r["lang"], t] += tokens
    assert got == {k: (docs[k], n[k]) for k in docs}
