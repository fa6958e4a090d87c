"""Operator 1. WARC archives with a two-level capture index.

``write_archives`` writes a gzip member per record into WARC files in the shared folder; equal payloads of at least 100
bytes are stored once, the others as revisit records that refer to it. ``build_index`` sorts captures by reversed-host URL
keys into compressed blocks (first level) with a sparse directory of their first keys (second level). ``lookup`` finds a
key's blocks by binary search in the directory, the line by binary search in the block, and ``read_records`` then reads
the byte ranges of the archives.

How it is spread: tasks write archives of their own and only tell places; a place counts once its task has committed, so
archives of lost tasks are just never referred to. The directory has at most ``DIRECTORY`` entries (blocks grow with the
input) of at most ``KEY`` characters, so it is broadcast; blocks and queries meet by block. Payloads move once, to the
smallest page of their digest, which is aggregated before.

Defined results: a null html is empty; rows that repeat the smallest page_id of a payload are all responses; a row with a
null page_id never is what others refer to; a null or malformed url is a key of its own; control characters and spaces inside a url (line ends too) stand as percent escapes
in keys and headers; every row has its own record, also
rows that repeat a url or an id; columns not named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import columns, scratch, short_batches, written

LEAST_REVISIT = 100
LINES, DIRECTORY, KEY = 3000, 65_536, 256
ARCHIVE = 256 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")


def printable(url: str | None) -> str:
    """A url on one line: stripped, spaces and control characters inside it as percent escapes."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", (url or "").strip())


def url_key(url: str | None) -> str:
    """The reversed host in commas, a bracket, path and query; without scheme, port, user and fragment; one line always."""
    url = printable(url)
    scheme, mark, rest = url.partition("://")
    if not mark:
        scheme, rest = "", url
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].partition(":")[0].lower().rstrip("."), rest[cut:]
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {page_id if page_id is None or page_id < 0 else format(page_id, '020d')}"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit has the full payload's digest and length, not the payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {printable(url)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, body) of one gzip member; raises on a broken record."""
    data = zlib.decompress(member, 31)
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a WARC record of another length")
    return headers, rest[:size]


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "None") else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives below ``folder``; a written table (key, page_id, archive, start, length) of the captures."""
    short_batches(pages.sparkSession)
    rows = columns(pages, id_col, url_col, html_col).select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = columns(pages, id_col, html_col).select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    same = same.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy(F.sha2("payload", 256).alias("_d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(same.select("_d", "first"), F.col("digest") == F.col("_d"), "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        part, archive, out, at = TaskContext.get().partitionId(), "", None, 0
        try:
            for b in batches:
                found = []
                for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        # a name of its own for each attempt: a lost task's file is never written to again
                        archive, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/{archive}", compression=None)
                    member = _record(page_id, url, payload, digest, refers_to)
                    out.write(member)
                    found.append((capture_key(url, page_id), page_id, archive, at, len(member)))
                    at += len(member)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["key", "page_id", "archive", "start", "length"])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, "key string, page_id bigint, archive string, start bigint, length bigint"), "captures")


def build_index(captures: DataFrame, lines: int = LINES, directory: int = DIRECTORY) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(table of blocks (block, first, data), directory of (first key, block), sorted)."""
    n = captures.count()
    per = max(lines, -(-n // directory))
    parts = max(1, min(-(-n // per), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, number, part = [], 0, TaskContext.get().partitionId()

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "\n".join(f"{k} {json.dumps([a, s, n])}" for k, a, s, n in rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | number], pa.int64()), pa.array([rows[0][0][:KEY]]), pa.array([zlib.compress(text.encode(), 6)], pa.binary())], names=["block", "first", "data"])

        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns], strict=True)
            while len(held) >= per:
                yield block(held[:per])
                held, number = held[per:], number + 1
        if held:
            yield block(held)

    ordered = captures.select("key", "archive", "start", "length").repartitionByRange(parts, "key", "archive", "start").sortWithinPartitions("key", "archive", "start")
    blocks = written(ordered.mapInArrow(run, "block bigint, first string, data binary"), "index")
    # sorted as Spark sorts: by UTF-8 bytes
    return blocks, sorted(((r.first, r.block) for r in blocks.select("first", "block").collect()), key=lambda e: (e[0].encode(), e[1]))


def candidate_blocks(directory: list[tuple[bytes, int]], key: str) -> list[int]:
    """The blocks that may hold a key, by binary search; more than one only if cut or repeated keys run over an edge."""
    k = key[:KEY].encode()
    lo = max(bisect.bisect_left(directory, k, key=lambda e: e[0]) - 1, 0)
    hi = bisect.bisect_right(directory, k, key=lambda e: e[0])
    return [b for _, b in directory[lo:hi]]


def lookup(keys: DataFrame, blocks: DataFrame, directory: list[tuple[str, int]]) -> DataFrame:
    """(key, archive, start, length) of all captures of the distinct keys of a (key) table."""
    shared = keys.sparkSession.sparkContext.broadcast([(f.encode(), b) for f, b in directory])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(x, k) for k in b.column(0).to_pylist() for x in candidate_blocks(shared.value, k)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["block", "key"])

    def search(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        wanted = asked.column("key").to_pylist()
        for data in held.column("data").to_pylist() if wanted else ():
            lines = zlib.decompress(data).decode().split("\n")
            names = [line[: line.rindex(" [")] for line in lines]
            order = [n.encode() for n in names]
            for k in wanted:
                i = bisect.bisect_left(order, k.encode())
                while i < len(names) and names[i] == k:
                    out.append((k, *json.loads(lines[i][len(names[i]) + 1 :])))
                    i += 1
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["key", "archive", "start", "length"])

    asked = keys.select("key").distinct().mapInArrow(find, "block bigint, key string")
    return asked.groupBy("block").cogroup(blocks.select("block", "data").groupBy("block")).applyInArrow(search, "key string, archive string, start bigint, length bigint")


def read_records(places: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Range reads: (key, page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each place."""
    n = parts or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows = []
                for key, archive, start, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if archive != name:
                        if source is not None:
                            source.close()
                        name, source = archive, system.open_input_file(f"{root}/{archive}")
                    headers, body = parse_record(source.read_at(length, start))
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"a payload of another digest: {archive} {start}")
                    rows.append((key, _page(headers["warc-record-id"]), int(headers["x-payload-length"]) if revisit else len(body), digest, headers["warc-type"], _page(headers.get("warc-refers-to")), None if revisit else body))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if source is not None:
            source.close()

    near = places.select("key", "archive", "start", "length").repartitionByRange(n, "archive", "start").sortWithinPartitions("archive", "start")
    return near.mapInArrow(run, "key string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    return columns(pages, id_col, url_col).select(F.col(id_col).cast("bigint"), F.col(url_col)).mapInArrow(run, "key string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive every row, index the captures, look every row's key up and read its record back."""
    folder = scratch(pages.sparkSession, "archives")
    captures = write_archives(pages, folder)
    blocks, directory = build_index(captures)
    return read_records(lookup(keys_of(pages), blocks, directory), folder)


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
