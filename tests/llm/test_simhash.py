import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    s = [" ".join(w)] * bool(w) if len(w) <= k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, budget=4):
    known = sorted(set(fps))
    root = {f: f for f in known}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    best = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            best[find(f)] = min(best.get(find(f), i), i)
    return [best.get(find(f)) for f in fps]


def test_brute_force(docs_of, corpus):
    got = simhash.near_groups(docs_of(corpus)).select("doc_id", "fingerprint", "component_id").collect()
    fps = [fingerprint(t) for _, t, *_ in corpus]
    want = [(i, f"{f:016x}", c) for (i, *_), f, c in zip(corpus, fps, components(fps, [r[0] for r in corpus]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_keeper_each(docs_of, corpus):
    got = simhash.near_groups(docs_of([r for r in corpus if r[0] != 5])).collect()  # 5 stands for two components
    assert sum(r["keeper"] for r in got) == len({r["component_id"] for r in got})
    assert all(r["doc_id"] == r["component_id"] for r in got if r["keeper"])


@pytest.mark.parametrize("budget", [0, 1, 4, 7])
def test_trie_finds_all_links(budget):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**64, 12, dtype=np.uint64)
    v = [int(c) for c in centre] + [0, 2**64 - 1]
    for c in centre.tolist():
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            v.append(x)
    v = np.unique(np.array(v, np.uint64))
    for top in (0, 5, 12):
        got = set()
        for a, b in simhash.trie_links(v, top, budget):
            got |= set(zip(a.tolist(), b.tolist(), strict=True))
        shift = 64 - top
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= budget and int(v[i]) >> shift == int(v[j]) >> shift}
        assert got == want


def test_chains_and_hubs(spark):
    """A long chain, a star and a clique contract to their smallest node."""
    rng = random.Random(2)
    chain = [(-500 + i, -499 + i) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    clique = [(a, b) for a in range(2000, 2030) for b in range(a + 1, 2030)]
    edges = chain + star + clique
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for nodes in (range(-500, -299), range(1000, 1301), range(2000, 2030)):
        assert all(got.get(n, n) == min(nodes) for n in nodes)
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_subtree(spark):
    """One family with most of all fingerprints: parts stay small, and no link between them is lost."""
    rng = np.random.default_rng(8)
    fps = {0x123456789ABCDEF0, 0, 1, 2**64 - 1}
    for _ in range(500):
        x = 0x123456789ABCDEF0
        for b in rng.integers(0, 64, 3).tolist():
            x ^= 1 << b
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 100)}
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    first = [64 * b // 5 for b in range(6)]
    sizes = [[r["count"] for r in simhash._dealt(df, first, 64, most).groupBy("b", "k", "i", "j").count().collect()] for most in (10**6, 60)]
    assert max(sizes[0]) > 200 and max(sizes[1]) <= 100
    want = dict(zip(sorted(fps), components(sorted(fps), sorted(fps)), strict=True))
    for most in (10**6, 60):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, most=most)).collect()}
        group = {}
        for f in fps:
            s = f - (f >> 63 << 64)
            group.setdefault(roots.get(s, s), set()).add(want[f])
        assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want.values()))


def test_empty(docs_of):
    assert simhash.near_groups(docs_of([])).count() == 0


def test_query(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [fingerprint(r["text"]) for r in docs]
    assert got == {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(docs, fps, components(fps, [r["doc_id"] for r in docs]), strict=True)}
