import random
from collections import defaultdict

import numpy as np
import pytest

from parity import compare, connect

from tessera.llm import near_copies, queries


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def planted():
    """Originals of several lengths, copies with some words changed, and others that share much but not enough."""
    rng = random.Random(21)
    docs, group = {}, {}
    for g in range(30):
        base = words(rng, rng.choice([40, 120, 300, 900]))
        docs[100 * g] = " ".join(base)
        for c in range(1, 7):
            w = list(base)
            for _ in range(max(1, len(w) // rng.choice([70, 100, 200]))):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            docs[100 * g + c] = " ".join(w)
        half = list(base)
        for i in range(0, len(half), 5):
            half[i] = words(rng, 1)[0]
        docs[100 * g + 50] = " ".join(half)
        group |= dict.fromkeys(range(100 * g, 100 * g + 7), 100 * g)
    return docs, group


def test_planted(docs_of, planted):
    docs, group = planted
    got = {r["doc_id"]: r for r in near_copies.near_copies(docs_of(list(docs.items()))).collect()}
    assert len(got) == len(docs)
    missed = [i for i, g in group.items() if i != g and likeness(docs[i], docs[g]) >= 0.8 and got[i]["component_id"] != got[g]["component_id"]]
    assert len(missed) <= 2
    for g in range(0, 3000, 100):  # a fifth of the words differ: not a copy
        assert got[g + 50]["component_id"] == g + 50 and got[g + 50]["keeper"]
    parts = defaultdict(list)
    for i, r in got.items():
        parts[r["component_id"]].append(i)
    for root, members in parts.items():
        assert root == min(members) and [i for i in members if got[i]["keeper"]] == [root]
        for i in members:  # every link is one of alike texts
            assert len(members) == 1 or max(likeness(docs[i], docs[j]) for j in members if j != i) >= 0.8


def test_hot_group(docs_of):
    """Many near copies of one text are one group, and the work doesn't form all pairs."""
    rng = random.Random(3)
    base = words(rng, 200)
    rows = []
    for i in range(1500):
        w = list(base)
        w[rng.randrange(200)] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    got = near_copies.near_copies(docs_of(rows)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["keeper"] for r in got) == 1


def test_hard_rows(docs_of, corpus):
    rows = near_copies.near_copies(docs_of(corpus)).collect()
    assert len(rows) == len(corpus)
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[400] == got[401] == got[402] == min(i for i, t, *_ in corpus if i is not None and not (t or "").encode().split())
    assert {got[i] for i in (*range(200, 205), 210, 211)} == {200}
    assert len({got[i] for i in (404, 405, 406, 408, 409)}) == 5
    assert near_copies.near_copies(docs_of([])).count() == 0


def groups_of(docs, similarity=0.8):
    """Component of each doc_id by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def test_against_all_pairs(docs_of, planted):
    """Near the threshold, too, links are those of all pairs: none is wrong, and nearly none is lost."""
    rng = random.Random(5)
    docs = dict(planted[0])
    for g in range(60):
        base = words(rng, rng.choice([30, 80, 200, 500]))
        docs[10_000 + 10 * g] = " ".join(base)
        for c in range(1, 6):
            w = list(base)
            for i in rng.sample(range(len(w)), max(1, round(len(w) * rng.choice([0.01, 0.02, 0.025, 0.03])))):
                w[i] = words(rng, 1)[0]
            docs[10_000 + 10 * g + c] = " ".join(w)
    want = groups_of(docs)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(list(docs.items()))).collect()}
    assert all(want[got[i]] == want[i] for i in docs)  # no wrong link
    assert sum(got[i] != want[i] for i in docs) <= 0.01 * len(docs)


def test_open_bucket(docs_of, spark, monkeypatch):
    """Two groups in shared buckets, joined only through members that are no bucket's first row; blocks of a few sets."""
    rng = random.Random(8)
    base, docs = words(rng, 120), {}
    for i in range(120):  # a chain: neighbours are alike, the ends are not
        w = list(base)
        w[:i] = [f"new{k}" for k in range(i)]
        docs[i] = " ".join(w)
    want = groups_of(docs)
    whole = near_copies.open_links
    monkeypatch.setattr(near_copies, "open_links", lambda *a: whole(*a, held_bytes=4000))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(list(docs.items()))).collect()}
    assert len(set(want.values())) == 1 and got == want


def test_likeness():
    a = np.arange(0, 100, dtype=np.uint64)
    assert near_copies.likeness(a, a) == 1 and near_copies.likeness(a, a[:80]) == 0.8 and near_copies.likeness(a[:0], a) == 0 and near_copies.likeness(a[:0], a[:0]) == 1
    assert near_copies.likeness(a[:60], a[40:]) == 0.2


def edited(rng, base, kind, share):
    """``base`` with a new passage at its end or inside, or without its tail: ``share`` is the likeness left."""
    n = len(base)
    if kind == "truncate":
        return base[: round(n * share)]
    new = words(rng, round(n * (1 / share - 1)))
    at = n if kind == "append" else rng.randrange(n // 4, 3 * n // 4)
    return base[:at] + new + base[at:]


@pytest.mark.parametrize("kind", ["append", "insert", "truncate"])
def test_passages(docs_of, kind):
    """Copies with a passage more or less are found from a likeness of 0.8 up."""
    rng = random.Random(kind)
    docs = {}
    for g in range(80):
        base = words(rng, rng.choice([150, 400, 1000]))
        docs[10 * g] = " ".join(base)
        for c, share in enumerate((0.82, 0.88, 0.94), 1):
            docs[10 * g + c] = " ".join(edited(rng, base, kind, share))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(list(docs.items()))).collect()}
    found = defaultdict(list)
    for i in docs:
        if i % 10:
            like = likeness(docs[i], docs[i - i % 10])
            if like >= 0.8:
                found[like >= 0.85].append(got[i] == got[i - i % 10])
    assert min(map(len, found.values())) >= 50
    assert np.mean(found[False]) > 0.95 and np.mean(found[True]) > 0.99


def test_candidates():
    """Texts with four fifths of their shingles in common agree in some band, by the smallest of their hashes."""
    rng = np.random.default_rng(4)
    missed = 0
    for n in (20, 60, 300, 2000):
        for _ in range(100):
            both = rng.integers(1, 2**63, n).astype(np.uint64)
            low, full = np.zeros((2, 256), np.uint64), np.zeros((2, 256), bool)
            for i, own in enumerate((both, both[: n * 4 // 5])):
                for x in np.sort(own)[::-1]:
                    low[i, int(x) % 256], full[i, int(x) % 256] = x, True
            a, b = near_copies.filled(low, full).reshape(2, 32, 8)
            missed += not (a == b).all(axis=1).any()
    assert missed <= 8


def test_words_alike_in_sum(docs_of, twin_words):
    """Texts of one word each, which hashes may confuse, are no copies."""
    rows = [(10 * n + k, word) for n, pair in enumerate(twin_words) for k, word in enumerate(pair)]
    got = near_copies.near_copies(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(r["keeper"] and r["component_id"] == r["doc_id"] for r in got)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(queries.near_copy_groups(spark, sf), connect(sf), queries.ORACLE_SQL["near_copy_groups"])
