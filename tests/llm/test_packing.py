import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, queries

SF = "/root/testdata/sf0.01"
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, most=1024):
    """rows: pieces; texts: of all documents by id, different ids."""
    per = defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
    assert set(per) == set(texts)
    for i, t in texts.items():
        ids = np.array(ids_of(t), "<u4")
        at = 0
        for r in sorted(per[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= most
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 for r in rows)
    by_length = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_length] == sorted(r["length"] for r in rows)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.op10_packing(spark, SF).collect(), docs)


@pytest.mark.parametrize("fast", [None, "byte_bpe_50k.tiktoken"])
def test_hard_rows(docs_of, corpus, fast):
    texts = {i: t for i, t, *_ in corpus if i not in (5, None)} | {900: "an <|endoftext|> inside", 901: "tabs\t\tand  blanks   \n\n\n"}
    check(packing.pack(docs_of(list(texts.items())), most=64, fast=fast).collect(), texts, 64)


def test_repeated_rows_and_nulls(docs_of):
    rows = packing.pack(docs_of([(1, "same text"), (1, "same text"), (None, None)])).collect()
    assert sum(r["length"] for r in rows) == 2 * len(ids_of("same text")) + 1
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert packing.pack(docs_of([])).count() == 0


def test_lengths():
    for n in range(1, 300):
        got = packing.lengths(n, 64)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 64 for x in got)
