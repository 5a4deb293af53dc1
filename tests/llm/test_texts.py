import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ranks, scratch, texts

TEXTS = st.lists(st.none() | st.text(alphabet="ab é😀 \t\n\x0b\x0c\r\x1f ", max_size=40), min_size=1, max_size=8)


@settings(deadline=None, max_examples=200)
@given(TEXTS, st.integers(1, 60))
def test_words_of_blocks(rows, limit):
    seen = []
    for lo, hi, data, offsets in texts.blocks(pa.array(rows, pa.string()), limit):
        assert lo == len(seen) and hi > lo
        raw = data.tobytes()
        starts, ends, first = texts.words(data, offsets)
        hashes = texts.word_hashes(data, starts, ends)
        points = texts.code_points(data, offsets)
        for i in range(hi - lo):
            got = [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            seen.append((got, points[i]))
            for w, h in zip(got, hashes[first[i] : first[i + 1]], strict=True):
                one = np.frombuffer(w.encode(), np.uint8)
                assert h == texts.word_hashes(one, np.array([0]), np.array([len(one)]))[0]
    assert seen == [(re.findall("[^\x20\x09-\x0d]+", t or ""), len(t or "")) for t in rows]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 45))
def test_rolling_and_minimum(values, k):
    h, q = np.array(values, np.uint64), 0xD1342543DE82EF95
    want = [sum(v * q ** (k - 1 - j) for j, v in enumerate(values[i : i + k])) % 2**64 for i in range(len(values) - k + 1)]
    assert texts.rolling(h, k, q).tolist() == want
    assert texts.window_min(h, k).tolist() == [min(values[i : i + k]) for i in range(len(values) - k + 1)]


def test_hashes_tell_words_apart(twin_words):
    """Words of any length by any one byte, and those that sums of bytes confuse; runs by order as well."""
    words = [w for pair in twin_words for w in pair] + [("x" * i + c + "x" * (n - 1 - i)) for n in (1, 7, 8, 9, 16, 127, 128, 129, 300) for i in {0, n // 2, n - 1} for c in "yz"]
    words += ["a" * n for n in range(1, 140)] + ["\x00" * n for n in range(1, 20)]
    words = list(dict.fromkeys(words))
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = texts.word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    for k in (1, 2, 5):
        runs = texts.chained(h[:60], k)
        assert len(runs) == 61 - k and len(set(runs.tolist())) == 61 - k
        assert k == 1 or not set(runs.tolist()) & set(texts.chained(h[:60][::-1].copy(), k).tolist())
    assert len(texts.chained(h[:3], 4)) == 0


def test_digests_of_words():
    rows = ["  a b\tc ", "", " \n", "d", "é f"]
    (_, _, data, offsets), = texts.blocks(pa.array(rows, pa.string()))
    starts, ends, _ = texts.words(data, offsets)
    parts, joined, begin, end = texts.joined_words(data.tobytes(), offsets, starts, ends)
    assert parts == [b"a b c", b"", b"", b"d", "é f".encode()] and joined == "a b c d é f".encode()
    assert [joined[a:b].decode() for a, b in zip(begin, end, strict=True)] == ["a", "b", "c", "d", "é", "f"]
    got = texts.digests(joined, begin[[0, 0]], end[[1, 1]])
    assert got.shape == (2, 2) and (got[0] == got[1]).all() and texts.digests(joined, begin[:0], end[:0]).shape == (0, 2)


def test_sliced_and_large_columns():
    column = pa.array(["skip", "a b", None, "c"], pa.large_string()).slice(1)
    (lo, hi, data, offsets), *rest = texts.blocks(column)
    assert not rest and (lo, hi) == (0, 3) and data.tobytes() == b"a bc" and offsets.tolist() == [0, 3, 3, 4]
    assert list(texts.blocks(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("parts", [1, 3, 50])
@pytest.mark.parametrize("running", [True, False])
def test_positions(spark, parts, running):
    rows = [(None if i % 5 == 0 else i % 3, i, i % 7) for i in range(200)] + [(9, 1, 1)] * 3
    df = spark.createDataFrame(rows, "g int, id int, x int")
    got = ranks.positions(df, df, ["g"], ["id"], ["x", "id"], parts, "at", running).collect()
    assert len(got) == len(rows)
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, g or 0))
    start = 0
    for g in groups:
        mine = sorted(r["at"] for r in got if r["g"] == g)
        assert mine == list(range(start, start + len(mine)))
        start += len(mine) if running else 0


def test_rows_keep_their_place(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    first = {r["id"]: r["at"] for r in scratch.identified(docs, "at").collect()}
    assert len(set(first.values())) == 100
    later = scratch.identified(docs.where("id % 3 = 0"), "at").repartition(5).collect()
    assert all(first[r["id"]] == r["at"] for r in later)
    before = scratch.mark()
    a, b = (scratch.materialize(docs, "kept") for _ in range(2))
    scratch.release(before, b)
    assert b.count() == 100
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        a.count()
