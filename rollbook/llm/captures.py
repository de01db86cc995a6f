"""WARC archives with a two-level capture index.

Pages are written as records of gzip members, a file for each task. The index holds one line for each capture, sorted by
reversed-host URL key, in compressed blocks; a sparse directory holds the first key of each block. A capture is found by
a binary search in the directory, a range read of one block, a binary search in it, and a range read of the record.
"""

from __future__ import annotations

import base64
import bisect
import functools
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut_lineage

DATE = "1970-01-01T00:00:00Z"
_ENTRIES = "key string, page_id string, file string, offset bigint, length bigint"
_PARTS = "first string, last string, file string, directory bigint, size bigint"


@dataclass(frozen=True)
class Archive:
    """Where the records and the index are: `path` is a folder that driver and executors share."""

    path: str
    min_bytes: int = 0  # smaller payloads are written in full each time
    block: int = 256  # index lines in a compressed block
    file_bytes: int = 1 << 30  # a task begins another archive file beyond this


def url_key(url: str | None) -> str:
    """The host's parts reversed, then port, path and query: `http://www.a.org:80/b?c` is `org,a,www:80)/b?c`. Null is empty."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # no URL at all: a key of its own behind all others
        return "~" + url
    if not host:
        return "~" + url
    tail = parts.path or "/"
    if parts.query:
        tail += "?" + parts.query
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + tail


def digest32(hexadecimal: str) -> str:
    """A SHA-1 in base32, as WARC states it."""
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record_id(page_id: str | None, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{key}')}>"


def _header_value(text: str) -> str:
    """A value on one line; line ends in a URL are escaped, for they end a header."""
    return "".join(f"%{b:02X}" if b < 33 else chr(b) for b in text.encode()).encode("latin-1").decode() if any(c < "!" for c in text) else text


def record(page_id: str | None, url: str | None, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit of `refers_to` (a page id) holds the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id, url_key(url)), "WARC-Date": DATE,
        "WARC-Target-URI": _header_value(url) if url else None, "WARC-Payload-Digest": f"sha1:{digest32(sha1)}",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Page-ID": page_id, "X-Refers-To-Page-ID": refers_to, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None), "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of a record; an error if lengths or digest do not fit."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    warc = dict(x.split(": ", 1) for x in lines)
    size = int(warc["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http_head, _, payload = rest[:size].partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response":
        if len(payload) != int(http["Content-Length"]) or digest32(hashlib.sha1(payload).hexdigest()) != warc["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError(f"payload of {warc['WARC-Record-ID']} differs from its digest")
    return warc, http, payload


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, by its scheme, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _normal(path: str) -> str:
    """`file:/a` as `file:///a`."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _verdicts(pages: DataFrame, archive: Archive) -> DataFrame:
    """`pages` (page_id, url, html) with sha1 and refers_to: the largest page_id with an equal payload, where that is another.

    Copies are counted on their digests; only digests that occur several times are joined, as the small side. A digest
    with very many rows is a frequent key of the large side only, which Spark splits.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    large = F.octet_length("payload") >= archive.min_bytes
    groups = keyed.filter(large).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    repeated = groups.filter("n > 1").select(F.col("sha1").alias("__sha1"), "last")
    joined = keyed.join(repeated, (F.col("sha1") == F.col("__sha1")) & large, "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, archive: Archive) -> DataFrame:
    """Writes a record for each of `pages` (page_id, url, html) and returns where it is: key, page_id, file, offset, length.

    Of records with equal payloads of at least `min_bytes` that with the largest page_id is a response and the others
    revisit it; equal page_ids with equal payloads are all responses, and so are equal payloads without any page_id. A
    task writes files of its own under fresh names; the entries, written to the checkpoint folder, name those of the
    attempts that counted, so what a lost executor left behind is never read.
    """
    folder = f"{_normal(archive.path)}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at = None, None, "", 0
        try:
            for part in chunks(batches, 64):
                entries = []
                for row in part.to_pylist():
                    if out is None or at >= archive.file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store, place = _open(folder)
                        store.create_dir(place, recursive=True)
                        out = store.open_output_stream(f"{place}/{name}", compression=None)
                    member = record(row["page_id"], row["url"], row["payload"], row["sha1"], row["refers_to"])
                    out.write(member)
                    entries.append({"key": url_key(row["url"]), "page_id": row["page_id"], "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(entries, _ENTRY)
        finally:
            if out is not None:
                out.close()

    rows = _verdicts(pages, archive).select(F.col("page_id").cast("string"), "url", "payload", "sha1", F.col("refers_to").cast("string"))
    return cut_lineage(rows.mapInArrow(run, _ENTRIES))


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _sort_key(key: str, page_id: str | None) -> tuple[bytes, bytes]:
    """Order of index lines: by key, then page id, bytewise; without id first. Spark orders strings in the same way."""
    return key.encode(), b"" if page_id is None else b"\1" + page_id.encode()


def build_index(entries: DataFrame, archive: Archive) -> list[dict]:
    """Writes the index of `entries` and returns one row for each of its parts: first and last key, file, place of its directory.

    Lines are sorted in ranges of (key, page_id), so a host or URL with most of the captures spreads over many parts.
    Each part is one file: compressed blocks of lines, then the part's directory, which holds the first key, offset and
    length of every block. The rows returned are as few as partitions.
    """
    folder, block = f"{_normal(archive.path)}/index", archive.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, lines, out, last = [], [], None, None
        name, at = f"{uuid.uuid4().hex}.cdx", 0
        store, place = _open(folder)

        def flush() -> int:
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(packed)
            directory.append([lines[0][0], lines[0][1], at, len(packed)])
            lines.clear()
            return at + len(packed)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    store.create_dir(place, recursive=True)
                    out = store.open_output_stream(f"{place}/{name}", compression=None)
                lines.append(list(row))
                last = row
                if len(lines) == block:
                    at = flush()
        if out is None:
            return
        if lines:
            at = flush()
        packed = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(packed)
        out.close()
        yield pa.RecordBatch.from_pylist([{"first": json.dumps(directory[0][:2]), "last": json.dumps(list(last[:2])), "file": name, "directory": at, "size": len(packed)}], _PART)

    order = [F.col("key"), F.col("page_id")]
    sorted_rows = entries.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = [r.asDict() for r in cut_lineage(sorted_rows.mapInArrow(run, _PARTS)).collect()]
    return sorted(parts, key=lambda r: _sort_key(*json.loads(r["first"])))


_PART = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("directory", pa.int64()), ("size", pa.int64())])


class Index:
    """Reads an index: parts are given, their directories and blocks are read by range when a search needs them."""

    def __init__(self, parts: Sequence[dict], archive: Archive):
        self.parts = parts
        self.lasts = [_sort_key(*json.loads(p["last"])) for p in parts]
        self.store, self.place = _open(f"{_normal(archive.path)}/index")
        # Few at a time: queries come in order.
        self.directory = functools.lru_cache(4)(self._directory)
        self.lines = functools.lru_cache(16)(self._lines)

    def _range(self, name: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.place}/{name}") as f:
            return f.read_at(length, offset)

    def _directory(self, part: int) -> tuple[list[tuple[bytes, bytes]], list[tuple[int, int]]]:
        p = self.parts[part]
        rows = json.loads(zlib.decompress(self._range(p["file"], p["directory"], p["size"])))
        return [_sort_key(*r[:2]) for r in rows], [tuple(r[2:]) for r in rows]

    def _lines(self, part: int, block: int) -> tuple[list[tuple[bytes, bytes]], list[list]]:
        offset, length = self.directory(part)[1][block]
        rows = [json.loads(x) for x in zlib.decompress(self._range(self.parts[part]["file"], offset, length)).decode().split("\n")]
        return [_sort_key(*r[:2]) for r in rows], rows

    def find(self, key: str, page_id: str | None) -> Iterator[list]:
        """All lines with this key and page id: [key, page_id, file, offset, length]; they may go on in further blocks and parts."""
        want = _sort_key(key, page_id)
        for part in range(bisect.bisect_left(self.lasts, want), len(self.parts)):
            firsts, places = self.directory(part)
            block = max(0, bisect.bisect_left(firsts, want) - 1)
            while block < len(places):
                keys, rows = self.lines(part, block)
                low, high = bisect.bisect_left(keys, want), bisect.bisect_right(keys, want)
                yield from rows[low:high]
                if high < len(keys):
                    return
                block += 1


def read(wanted: DataFrame, parts: Sequence[dict], archive: Archive, kind: str = "bigint") -> DataFrame:
    """The captures of `wanted` (url, page_id), found through the index and read from the archives.

    Returns page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to. A page wanted several times is
    returned once for each of its captures, one not captured not at all. Every response is checked against its digest.
    `parts` has one small row for each partition of the index; queries are sorted as the index is, so a task reads few
    directories and blocks, each by its range.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, files = None, {}
        for batch in chunks(batches, 64):
            index = index or Index(parts, archive)
            # The records of some queries, in the order in which they lie in their files.
            found = sorted((line for key, page in zip(*(batch.column(i).to_pylist() for i in (0, 1))) for line in index.find(key, page)), key=lambda x: (x[2], x[3]))
            out = []
            for _, page, name, offset, length in found:
                if name not in files:
                    if len(files) >= 16:
                        files.pop(next(iter(files))).close()
                    store, place = _open(f"{_normal(archive.path)}/records")
                    files[name] = store.open_input_file(f"{place}/{name}")
                warc, http, payload = parse(files[name].read_at(length, offset))
                response = warc["WARC-Type"] == "response"
                out.append({
                    "page_id": warc.get("X-Page-ID"), "url": warc.get("WARC-Target-URI"), "record_type": warc["WARC-Type"], "payload": payload if response else None,
                    "payload_bytes": int(http["Content-Length"]), "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": warc.get("X-Refers-To-Page-ID"),
                })
            yield pa.RecordBatch.from_pylist(out, _CAPTURE)
        for f in files.values():
            f.close()

    order = [F.col("key"), F.col("page_id")]
    # Few bytes here stand for much reading, so the number of ranges is not left to their size.
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _keys(wanted).distinct().repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        run, "page_id string, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"
    )
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


_CAPTURE = pa.schema([
    ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()),
])


def _keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of rows with url and page_id; the keys are made as the writer made them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, batch.column(1)], ["key", "page_id"])

    return pages.select("url", F.col("page_id").cast("string").alias("page_id")).mapInArrow(run, "key string, page_id string")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an archive's folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def round_trip(pages: DataFrame, archive: Archive) -> DataFrame:
    """Writes `pages` (page_id, url, html) as an archive with its index and reads all of it back: page_id, payload_bytes,
    payload_digest (base32 SHA-1), record_type and refers_to of each row.

    All answers come from the records that the index leads to. Null and empty payloads have no bytes; null URLs have an
    empty key, and texts that are no URL one of their own. Rows without page_id are found by their URL. Very long texts
    are held 64 rows at a time. Repeated rows are records of their own and return each; an empty table gives an empty
    result; extra columns are ignored. The result is written to the checkpoint folder, so the archive may go after.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    pages = pages.select("page_id", "url", "html")
    parts = build_index(write(pages, archive), archive)
    found = read(pages, parts, archive, kind)
    return cut_lineage(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


#: The same in DuckDB's SQL; a SHA-1 in base32 is four groups of ten hex digits, eight letters each.
CAPTURES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p
),
e AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 8 * 10 + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to FROM e"""
