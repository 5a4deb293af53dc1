"""WARC archives of pages with a two-level capture index.

Tasks write pages as WARC 1.1 records, each a gzip member of its own, so that a
record can be read by its place alone. Of pages with one payload one is a response
and the others are revisits that refer to it. What a task has written is a row in a
table: a file counts only if that table names it, so repeated or lost tasks leave no
trace in the archive.

The index sorts captures by the reversed host and path of their URL and keeps them
as lines in compressed blocks. A sparse directory has the first key and the place of
each block, and the root the first key of each index file. A look-up searches the
root and the directory by bisection, reads the ranges of the blocks that may hold
its key, and then the ranges of the records that these name.

Files are read and written by ``pyarrow.fs``, so the folder is one of a file system
that it knows (shared folders, S3, GCS, HDFS).
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CAPTURE = "key string, record_id string, type string, file string, offset long, length long, refers_key string, refers_id string"
_RECORD = "page_id long, url string, record_id string, record_type string, refers_id string, refers_page_id long, payload_bytes long, payload_digest string, payload binary"


def sort_key(url: str | None) -> str:
    """The host's parts from the last to the first, then path and query: ``com,example,www)/a?b``. Null gives an empty key."""
    if not url:
        return ""
    scheme, mark, rest = url.partition("://")
    rest = (rest if mark else scheme).partition("#")[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, tail = rest[:cut].rpartition("@")[2], rest[cut:]
    name, colon, port = host.rpartition(":")
    host = name if colon and port.isdigit() else host
    return ",".join(reversed(host.lower().split("."))) + ")" + (tail if tail.startswith("/") else "/" + tail)


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, file: int, place: int) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{file}/{place}')}"


def _header(lines: Iterable[tuple[str, object]]) -> bytes:
    """Header lines; control characters of a value are percent-encoded, so that none ends its line."""
    return b"".join(f"{k}: {urllib.parse.quote(str(v), safe=''.join(map(chr, range(32, 127))))}\r\n".encode() for k, v in lines if v is not None) + b"\r\n"


def pack_record(page_id: int | None, url: str | None, payload: bytes, record_id: str, refers: tuple[str, int | None, str | None] | None, date: str) -> bytes:
    """One record; refers: the id, page and URL of the response that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers else http + payload
    head = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Page-ID", page_id),
    ]
    if refers:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers[0]}>"), ("WARC-Refers-To-Target-URI", refers[2]), ("Refers-To-Page-ID", refers[1])]
    return b"WARC/1.1\r\n" + _header([*head, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """A record's fields and payload; ValueError if it is cut off, or a response doesn't agree with its digest.

    url is the target URI as the record has it.
    """

    def fields(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n") if ": " in line)

    head, mark, rest = record.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc.get("Content-Length", 0))]
    if not mark or not head.startswith(b"WARC/1.1\r\n") or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(warc["Content-Length"]):
        raise ValueError(f"broken WARC record {warc.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    said = warc["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = warc["WARC-Type"] == "response"
    if whole and digest(payload) != said:
        raise ValueError(f"the payload of WARC record {warc['WARC-Record-ID']} doesn't agree with its digest")
    number = lambda name: int(warc[name]) if name in warc else None
    return {
        "page_id": number("Page-ID"), "url": warc.get("WARC-Target-URI"), "record_id": warc["WARC-Record-ID"].strip("<>"), "record_type": warc["WARC-Type"],
        "refers_id": warc["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in warc else None, "refers_page_id": number("Refers-To-Page-ID"),
        "payload_bytes": len(payload) if whole else None, "payload_digest": said, "payload": payload if whole else None,
    }


class _Files:
    """Writes members one after the other into new files of about ``roll`` bytes below ``folder``."""

    def __init__(self, folder: str, kind: str, roll: int):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.kind, self.roll, self.out = folder, kind, roll, None
        self.system.create_dir(self.path)

    def put(self, member: bytes) -> tuple[str, int]:
        """The file and the offset at which ``member`` stands."""
        if self.out is None or self.at and self.at + len(member) > self.roll:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.{self.kind}", 0
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(member)
        at, self.at = self.at, self.at + len(member)
        return f"{self.folder}/{self.name}", at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _ranges(places: list[tuple[str, int, int]], near: int = 1 << 16, most: int = 1 << 22) -> Iterator[bytes]:
    """The bytes at each (file, offset, length), in the order given; neighbouring ranges are one read of up to ``most`` bytes."""
    from pyarrow import fs

    opened: tuple[str, object] | None = None
    i = 0
    try:
        while i < len(places):
            file, begin, length = places[i]
            end, k = begin + length, i + 1
            while k < len(places) and places[k][0] == file and begin <= places[k][1] <= end + near and places[k][1] + places[k][2] - begin <= most:
                end = max(end, places[k][1] + places[k][2])
                k += 1
            if opened is None or opened[0] != file:
                if opened:
                    opened[1].close()
                system, path = fs.FileSystem.from_uri(file)
                opened = file, system.open_input_file(path)
            opened[1].seek(begin)
            data = opened[1].read(end - begin)
            for f, at, size in places[i:k]:
                part = data[at - begin : at - begin + size]
                if len(part) != size:
                    raise ValueError(f"{f} ends before {at + size}")
                yield part
            i = k
    finally:
        if opened:
            opened[1].close()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.strip().split(" ") for c in ddl.split(","))])


def _batched(rows: Iterable[tuple], ddl: str, size: int = 512) -> Iterator[pa.RecordBatch]:
    held, schema = [], _arrow(ddl)
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _table(held, schema)
            held = []
    if held:
        yield _table(held, schema)


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """row and refers (page_id, row, url of the response) of each row that is a revisit.

    rows: row, page_id, url and payload. Of equal payloads of ``least`` bytes or more the
    row with the largest page_id is the response; null is below all others, and of rows
    with one page_id the one that stands last in its file counts. Payloads are told apart
    by SHA-256 and length. What many pages share is counted by partial aggregates and
    joined back by a join that Spark can split.
    """
    slim = scratch.materialize(rows.select("row", "page_id", "url", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("sha")), "payloads")
    best = F.max(F.struct("page_id", "row", "url")).alias("refers")
    groups = slim.where(F.col("n") >= least).groupBy("sha", "n").agg(best, F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    shared = scratch.materialize(groups, "shared")
    found = slim.select("row", "n", "sha").join(shared, ["sha", "n"]).where(F.col("row") != F.col("refers.row")).select("row", "refers")
    out = scratch.materialize(found, "revisits")
    scratch.drop(slim, shared)
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, roll: int = 1 << 28, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write ``pages`` as archives of about ``roll`` bytes below ``folder``; returns the captures: key, record_id, type, file, offset, length, refers_key, refers_id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, "warc.gz", roll)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row, page_id, url, payload, refers = (batch.column(c)[i].as_py() for c in range(5))
                    url = None if url is None else url.decode("utf-8", "replace")
                    own, to = _record_id(page_id, row["file"], row["place"]), None
                    if refers is not None:
                        uri = None if refers["url"] is None else refers["url"].decode("utf-8", "replace")
                        to = _record_id(refers["page_id"], refers["row"]["file"], refers["row"]["place"]), refers["page_id"], uri
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(pack_record(page_id, url, payload, own, to, date)) + pack.flush()
                    yield sort_key(url), own, "revisit" if to else "response", *files.put(member), len(member), sort_key(to[2]) if to else None, to and to[0]

        try:
            yield from _batched(rows(), _CAPTURE)
        finally:
            files.close()

    pages = scratch.placed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("binary").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")))
    rows = scratch.identified(pages, "row")
    found = revisits(rows, least)
    # Payloads are shuffled once, if at all, and not sorted.
    told = rows.join(found.hint("shuffle_hash"), "row", "left").select("row", "page_id", "url", "payload", "refers")
    return scratch.materialize(scratch.map_arrow(scratch.spread(told), write, _CAPTURE), "captures")


class CaptureIndex:
    """Captures by sorted URL key: blocks of lines, a directory of blocks, a root of files.

    blocks: the directory, a row for each block: file, offset, length, n, first, last.
    """

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @classmethod
    def build(cls, captures: DataFrame, folder: str, block: int = 3000, parts: int | None = None, roll: int = 1 << 40) -> CaptureIndex:
        """Sort ``captures`` over ``parts`` files of blocks of ``block`` lines; captures of one key may fill many."""
        spark = captures.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ddl = "file string, offset long, length long, n long, first string, last string"

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = _Files(folder, "cdxj.gz", roll)

            def rows() -> Iterator[tuple]:
                lines: list[list] = []

                def flush() -> tuple:
                    member = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode(), 6)
                    return *files.put(member), len(member), len(lines), lines[0][0], lines[-1][0]

                for batch in batches:
                    for line in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                        lines.append(list(line))
                        if len(lines) == block:
                            yield flush()
                            lines = []
                if lines:
                    yield flush()

            try:
                yield from _batched(rows(), ddl)
            finally:
                files.close()

        ordered = captures.repartitionByRange(parts, "key", "record_id").sortWithinPartitions("key", "record_id")
        return cls(scratch.materialize(scratch.map_arrow(ordered, write, ddl), "directory"))

    def captures(self) -> DataFrame:
        """All captures, read block by block."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = sorted(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
                yield from _batched((tuple(x) for raw in _ranges(places) for x in _lines(raw)), _CAPTURE)

        dealt = self.blocks.select("file", "offset", "length").repartition(_parts(self.blocks.sparkSession))
        return scratch.map_arrow(dealt, read, _CAPTURE)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Captures whose key is a ``key`` of ``wanted``; null keys find none, and a key that stands twice counts once.

        The root, one key for each index file, goes with the tasks; its files are as many as
        ``build`` was given parts. Keys meet the directory of the file that may hold them, so
        a task holds the directory and the keys of one file.
        """
        root = sorted((r["first"], r["last"], r["file"]) for r in self.blocks.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
        firsts, lasts = [r[0] for r in root], [r[1] for r in root]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Files are ranges of keys: those whose first key is at most the key, and whose last at least.
                yield from _batched(((root[i][2], k) for k in batch.column(0).to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))), "file string, key string")

        def find(asked: pa.Table, own: pa.Table) -> pa.Table:
            keys = sorted(asked.column("key").to_pylist())
            blocks = sorted(zip(*(own.column(c).to_pylist() for c in ("first", "last", "file", "offset", "length")), strict=True), key=lambda b: (b[0], b[3]))
            starts, ends = [b[0] for b in blocks], [b[1] for b in blocks]
            needed: dict[int, list[str]] = {}
            for k in keys:
                for i in range(bisect_left(ends, k), bisect_right(starts, k)):
                    needed.setdefault(i, []).append(k)
            out = []
            order = sorted(needed)
            for i, raw in zip(order, _ranges([blocks[i][2:] for i in order]), strict=True):
                lines = _lines(raw)
                at = [x[0] for x in lines]
                out += [tuple(x) for k in needed[i] for x in lines[bisect_left(at, k) : bisect_right(at, k)]]
            return pa.Table.from_batches([_table(out, _arrow(_CAPTURE))])

        keys = scratch.map_arrow(wanted.select("key").where("key IS NOT NULL").distinct(), route, "file string, key string")
        return keys.groupBy("file").cogroup(self.blocks.groupBy("file")).applyInArrow(find, _CAPTURE)


def _lines(raw: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")]


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``captures``, by range reads: ``_RECORD``'s fields. A revisit has no payload and no size of its own."""
    ddl = _RECORD if payloads else _RECORD.removesuffix(", payload binary")
    names = [c.strip().split(" ")[0] for c in ddl.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = sorted(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            records = (read_record(zlib.decompress(raw, 31)) for raw in _ranges(places))
            yield from _batched((tuple(r[c] for c in names) for r in records), ddl, 64)

    # Neighbouring records are one task's, a few megabytes each, so that their ranges become one read.
    near = F.floor(F.col("offset") / (1 << 22))
    dealt = captures.select("file", "offset", "length").repartition(_parts(captures.sparkSession), "file", near).sortWithinPartitions("file", "offset")
    return scratch.map_arrow(dealt, read, ddl)


def archive_pages(pages: DataFrame, least: int = 0, folder: str | None = None, **options) -> tuple[DataFrame, CaptureIndex]:
    """Captures and index of ``pages`` (page_id, url, html), written below ``folder``.

    Null html is an empty payload, a null url a record without a target URI under the
    empty key. Null page_ids, repeated rows, and texts of any length are records like any
    other. An empty table gives an empty archive; other columns aren't read.
    """
    folder = folder or scratch.new_path(pages.sparkSession, "archive")
    captures = write_archives(pages, f"{folder}/warc", least=least, **options)
    return captures, CaptureIndex.build(captures, f"{folder}/index")


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from its archives.

    All records are reached by the index. A response's figures are those of the payload
    that was read; a revisit's are those of the response that it refers to, which is looked
    up by its URL's key. ValueError if one is missing or doesn't agree. Rows with nulls and
    repeated rows are as in ``archive_pages`` and ``revisits``.
    """
    captures, index = archive_pages(pages, least, folder, **options)
    every = scratch.materialize(index.captures(), "entries")
    records = scratch.materialize(read_records(every, payloads=False), "records")
    asked = every.where("type = 'revisit'").select(F.col("refers_key").alias("key"), F.col("refers_id").alias("record_id")).distinct()
    asked = scratch.materialize(asked, "asked")
    held = index.lookup(asked).join(asked, ["key", "record_id"], "left_semi")
    referred = read_records(held, payloads=False).select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("sha1"), F.col("page_id").alias("to"))
    referred = scratch.materialize(referred, "referred")
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type")
    plain = records.where("record_type = 'response'").select(*fields, F.lit(None).cast("long").alias("refers_to"))
    again = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_id").join(referred, "refers_id", "left")
    agrees = F.col("sha1").eqNullSafe(F.col("payload_digest"))
    checked = F.when(agrees, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no such response: "), "refers_id")).cast("long"))
    out = plain.unionByName(again.select("page_id", checked.alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to")))
    scratch.drop(every, asked, captures)
    return out
