import zlib
from collections import Counter

from tessera.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        t = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 1, zlib.crc32(t), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert 30 < sum(r["grown_shard"] == 16 for r in rows) < 90


def test_shares_follow_weights(docs_of, spark):
    tree = [("a", "a0", 0, 1.0), ("a", "a1", 1, 2.0), ("b", "b0", 2, 3.0), ("b", "b0", 3, 2.0)]
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    n = Counter(r["shard"] for r in sharding.assign(docs, tree).collect())
    for s, w in enumerate((1, 2, 3, 2)):
        assert abs(n[s] / 40_000 - w / 8) < 0.01


def test_changed_weight_moves_its_subtree_only(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'' AS text")
    tree = sharding.topology(16)
    heavier = [(r, k, s, 2.0 if s == 5 else w) for r, k, s, w in tree]
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(docs, t).collect()} for t in (tree, heavier))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    region, rack = ({s: row[i] for *row, s, _ in tree} for i in (0, 1))
    # At each level rows move only into the child above shard 5.
    assert moved and all(region[y] == region[5] for _, y in moved)
    assert all(rack[y] == rack[5] for x, y in moved if region[x] == region[5])
    assert all(y == 5 for x, y in moved if rack[x] == rack[5])


def test_growth_by_many(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'' AS text")
    before = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, sharding.topology(16)).collect()}
    old = 16
    for n in (17, 18, 25):
        after = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, sharding.topology(n, 16)).collect()}
        assert all(after[i] == before[i] or after[i] >= old for i in after)
        assert sum(after[i] == n - 1 for i in after) > 3000 / n / 2
        before, old = after, n


def test_hard_rows(docs_of, corpus):
    rows = sharding.assign(docs_of(corpus), sharding.topology(3), parts=2).collect()
    assert len(rows) == len(corpus) and all(r["grown_shard"] is None for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.assign(docs_of([]), sharding.topology(16)).count() == 0


def test_plan_is_native(spark):
    plan = queries.op9_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_files(docs_of, corpus, spark, tmp_path):
    tree = sharding.topology(5)
    docs = docs_of(corpus)
    sharding.write(docs, f"{tmp_path}/out", tree, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = Counter((r["doc_id"], r["text"], r["shard"]) for r in sharding.place(docs, tree).collect())
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == want


def test_rows_without_an_id_are_many_sub_groups(spark):
    """A third of the rows have no doc_id and one text: they share a shard, and many tasks number them."""
    docs = spark.range(6000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, 'one', string(id)) AS text")
    rows = sharding.assign(docs, sharding.topology(4), parts=32)
    own = rows.where("doc_id IS NULL")
    assert own.select("shard").distinct().count() == 1 and own.count() == 2000
    # Slots of a sub-group follow each other, so rows of one sub-group would be one stretch of slots.
    slots = sorted(r["slot"] for r in own.collect())
    assert sum(b - a > 1 for a, b in zip(slots, slots[1:], strict=False)) >= 20
