import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import minhash, queries, scratch

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def edited(text, following):
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def check(rows, docs):
    """rows: op2's; docs: (doc_id, text) with different ids."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    errors = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        e, r = edited(t, nxt), got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for x, near in ((e, r["near_edited"]), (nxt, r["near_next"])):
            a, b = shingles(t), shingles(x)
            errors.append(near - len(a & b) / len(a | b))
            assert 0 <= near <= 1
            assert a != b or near == 1.0
    return np.array(errors)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    errors = check(queries.op2_minhash_fingerprints(spark, SF).collect(), docs)
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.05 and abs(errors).max() < 0.2


def test_hard_rows(docs_of, corpus):
    seen, rows = set(), []
    for i, t, *_ in corpus:
        if i not in seen:
            seen.add(i)
            rows.append((i, t))
    errors = check(minhash.compare_with_next(docs_of(rows)).collect(), rows)
    assert abs(errors).max() < 0.25


def test_equal_texts_and_words(docs_of):
    rows = [(1, "a b c d e f"), (2, " a b\tc d e\n f"), (3, "a b"), (4, "a  b"), (5, None), (6, ""), (7, " \n"), (8, "b a")]
    got = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(docs_of(rows)).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] == got[6] == got[7]
    assert len({got[i] for i in (1, 3, 5, 8)}) == 4


def test_next_row(docs_of):
    rows = [(10, "x"), (3, "y"), (None, "z"), (7, "w"), (7, "w")]
    got = minhash.with_next(docs_of(rows)).select("doc_id", "text", "next_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "z", "y"), (3, "y", "w"), (7, "w", "w"), (7, "w", "x"), (10, "x", "z")], key=str)
    assert minhash.compare_with_next(docs_of([])).count() == 0
    one = minhash.compare_with_next(docs_of([(1, "abcd efgh")])).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize(("bins", "bits"), [(128, 8), (64, 1), (256, 4), (64, 16)])
def test_likeness_is_unbiased(spark, bins, bits):
    """Pairs of known likeness, over many sets."""
    n, share, errors = 200, 0.5, []
    rows = []
    for k in range(60):
        both = [f"s{k}x{i}" for i in range(n)]
        rows.append((" ".join(both), " ".join(both[: int(n * (1 + share) / 2)] + [f"t{k}x{i}" for i in range(int(n * (1 - share) / 2))])))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(minhash.likeness(*[minhash.fingerprint(F.col(c), bins, bits, 1) for c in "ab"], bins, bits).alias("x")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        x, y = set(a.split()), set(b.split())
        errors.append(r["x"] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.05


def test_plan_is_native(spark):
    plan = queries.op2_minhash_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_fingerprint(text, bins=256, bits=4, k=5, draws=12):
    """One-permutation MinHash with optimal densification, step by step."""

    def h(*values):
        seed = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8 if abs(v) >> 31 or isinstance(v, Long) else 4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
        return Long(seed - (seed >> 63 << 64))

    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    hashes = {h(" ".join(w))} if len(w) <= k else {h(*w[i : i + k]) for i in range(len(w) - k + 1)}
    first = {}
    for x in sorted(hashes):
        first.setdefault((x % 2**64) >> 56, x)
    out = ""
    for i in range(bins):
        asked = [i, *(h(i, a) % bins for a in range(draws))]
        ranked = min((h(i, "rank", b), x) for b, x in first.items())[1]
        value = next((first[b] for b in asked if b in first), ranked)
        out += f"{h(value, i) % 16:x}"
    return out


class Long(int):
    """Hashed as eight bytes."""


def test_against_plain_fingerprints(docs_of, corpus):
    rows = [(k, t) for k, (_, t, *_) in enumerate(corpus) if len(t or "") < 20_000]
    got = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(docs_of(rows)).collect()}
    assert len(rows) > 50 and all(got[i] == plain_fingerprint(t) for i, t in rows)


def test_ids_that_are_text_or_repeat(spark):
    """A third of the rows share an id, a third have none: many ranges get them, and each row follows another once."""
    n = 300
    ids = ["same" if i % 3 == 0 else None if i % 3 == 1 else f"é{i:04d}" for i in range(n)]
    docs = scratch.materialize(spark.createDataFrame([(d, f"text {i} of some words {i * 7}") for i, d in enumerate(ids)], "doc_id string, text string").repartition(6), "texts")
    rows = minhash.with_next(docs).select("doc_id", "text", "next_text").collect()
    assert len(rows) == n and len({r["text"] for r in rows}) == len({r["next_text"] for r in rows}) == n
    by_text = {r["text"]: r for r in rows}
    start = min(rows, key=lambda r: (r["doc_id"] is not None,))["text"]
    seen, at = [], start
    for _ in range(n):
        seen.append(by_text[at]["doc_id"])
        at = by_text[at]["next_text"]
    assert at == start  # one ring
    turn = next(i for i in range(n) if seen[i] is None and seen[i - 1] is not None)
    ring = seen[turn:] + seen[:turn]
    assert ring == sorted(ids, key=lambda d: (d is not None, d or ""))
    plan = minhash.with_next(docs)
    ranges = plan.select("doc_id", F.spark_partition_id().alias("p")).where("doc_id IS NULL").distinct().count()
    assert ranges >= 2
