import gzip
import hashlib
import io
import random
from base64 import b32encode

import pytest
from parity import compare, connect
from pyarrow import fs
from pyspark.sql import functions as F

from tessera.llm import queries, scratch, warc

SF = "/root/testdata/sf0.01"
EXTRA = ["row", "key", "sha", "n", "file", "offset", "refers", "payload"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in EXTRA))


def brute(rows, least=0):
    most, out = {}, []
    for i, (page, _, html) in enumerate(rows):
        b = (html or "").encode()
        if len(b) >= least:
            most[b] = max(most.get(b, (-(10**9), -1)), (page if page is not None else -(10**9), i))
    for i, (page, _, html) in enumerate(rows):
        b = (html or "").encode()
        response = len(b) < least or most[b] == (page if page is not None else -(10**9), i)
        to = None if response or most[b][0] == -(10**9) else most[b][0]
        out.append((page, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    rows = [(i, f"https://{rng.choice(['www', 'm', 'Blog'])}.site{i % 5}.Example.com:8080/p/{i % 17}?q={i}#frag", f"<html>é {i} 日本" * rng.randint(0, 30)) for i in range(120)]
    rows += [(200 + i, "http://hot.example.org/", "<p>the same</p>") for i in range(90)]
    rows += [(300, None, None), (301, "", ""), (302, "no scheme at all", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (303, "http://a\r\nX: y/\x00\x7f", "x"), (304, "http://u:p@h.org", "y" * 3_000_000)]
    rows += [(None, "http://n.org/a", "null id"), (305, "http://n.org/b", "null id"), (None, None, "none"), (None, None, "none"), (7, "http://r.org/", "repeated"), (7, "http://r.org/", "repeated")]
    return rows


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, pages, least):
    """Equal payloads, nulls, empty and long pages, URLs that would break a header, repeated rows, clashing columns."""
    got = warc.round_trip(frame(spark, pages), least).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages, least)


def test_archives(spark, pages):
    """Files are gzip members one after the other that together are plain WARC; each capture's range is one record."""
    captures, index = warc.archive_pages(frame(spark, pages), roll=20_000)
    rows = captures.collect()
    assert len({r["file"] for r in rows}) > 1 and len({r["record_id"] for r in rows}) == len(rows) == len(pages)
    for file in {r["file"] for r in rows}:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_stream(path, compression=None) as f:
            raw = f.read()
        own = sorted((r["offset"], r["length"]) for r in rows if r["file"] == file)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, [*own[1:], (len(raw), 0)], strict=True))
        assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read() == b"".join(gzip.decompress(raw[a : a + n]) for a, n in own)
    assert sorted(map(tuple, index.captures().collect()), key=str) == sorted(map(tuple, rows), key=str)
    texts = sorted(r["payload"].decode() for r in warc.read_records(index.captures()).where("record_type = 'response'").collect())
    assert texts == sorted({h or "" for _, _, h in pages})


def test_lookup(spark, pages):
    """Keys that fill many blocks and files, and ones before, between and after all."""
    captures = scratch.materialize(warc.write_archives(frame(spark, pages), scratch.new_path(spark, "warc")), "captures")
    index = warc.CaptureIndex.build(captures, scratch.new_path(spark, "index"), block=7, parts=5)
    assert index.blocks.count() >= len(pages) // 7 and index.blocks.agg(F.max("n")).first()[0] <= 7
    held = captures.collect()
    keys = [None, "", "a", "zzzz", "org,example,hot)/", "com,example,site1)/none", "org,example,hot)/", *[r["key"] for r in held[::9]]]
    got = index.lookup(spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((tuple(r) for r in held if r["key"] in keys), key=str)


def test_keys():
    assert warc.sort_key("HTTPS://u:p@www.Example.com:443/A/b?c=D#e") == "com,example,www)/A/b?c=D"
    assert [warc.sort_key(u) for u in (None, "", "example.org", "http://a.b?x=1", "http://[::1]:80/p")] == ["", "", "org,example)/", "b,a)/?x=1", "[::1])/p"]


def test_broken_records():
    record = warc.pack_record(1, "http://a/", b"text", "urn:x", None, "1970-01-01T00:00:00Z")
    assert warc.read_record(record)["payload"] == b"text"
    for bad in (record[:-1], record.replace(b"text\r\n\r\n", b"texT\r\n\r\n"), b"", record[3:]):
        with pytest.raises(ValueError):
            warc.read_record(bad)


def test_empty(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_sql(spark):
    compare(queries.op13_warc(spark, SF), connect(SF), queries.ORACLE_SQL["op13_warc"])
