import hashlib
import re

import pytest
from parity import compare, connect

from tessera.llm import queries, substring_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, length):
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - length + 1):
            s = tuple(w[k : k + length])
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            s = tuple(w[k : k + length])
            if s in first and (i is None or first[s] < i):
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "anchor"), [(50, 12), (50, 50), (7, 3), (1, 1), (20, 1)])
def test_brute_force(docs_of, corpus, length, anchor):
    got = substring_dedup.substring_dedup(docs_of(corpus), length=length, anchor=anchor)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(corpus, length)
    for r in got.select("n_removed", "spans").collect():
        assert r["n_removed"] == sum(s["end"] - s["begin"] for s in r["spans"])
        assert all(a["end"] < b["begin"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_repetitive_texts(docs_of):
    """Windows that overlap themselves, and a passage with many different surroundings."""
    rows = [(i, "la " * (60 + i)) for i in range(4)]
    p = " ".join(f"w{i}" for i in range(55))
    rows += [(10 + i, " ".join(f"a{i}{j}" for j in range(i)) + " " + p + " " + " ".join(f"b{i}{j}" for j in range(7))) for i in range(30)]
    rows += [(50, p[: p.rindex(" w52")]), (51, p[p.index(" w3") :])]
    got = substring_dedup.substring_dedup(docs_of(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


@pytest.mark.parametrize("place", [0, 25, 49])
def test_words_alike_in_sum(docs_of, twin_words, place):
    """A word that hashes may confuse with another makes a window of its own."""
    rows = []
    for n, pair in enumerate(twin_words):
        for k, word in enumerate(pair):
            words = [f"w{n}x{i}" for i in range(49)]
            rows.append((10 * n + k, " ".join([*words[:place], word, *words[place:]])))
    got = substring_dedup.substring_dedup(docs_of(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)
    assert all(r["n_removed"] == 0 for r in got.collect())


def test_empty(docs_of):
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0


def test_sql(spark):
    compare(queries.op3_substring_dedup(spark, SF), connect(SF), queries.ORACLE_SQL["op3_substring_dedup"])


def test_texts(docs_of):
    """Texts with repeats lose them, all others and all other columns stay."""
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a  b {p}\nc"), (2, p), (3, f"x {p} y"), (4, "as  it\tis "), (5, None), (5, p)]
    docs = docs_of(rows)
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, rows[0][1]), (2, ""), (3, "x y"), (4, rows[3][1]), (5, None), (5, "")], key=str)
