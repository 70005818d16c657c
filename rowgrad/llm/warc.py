"""WARC archives with a two-level capture index.

Each task writes its rows as gzip members of one archive file through Spark's own writer, so that files appear only when they are complete. The
capture index sorts reversed-host URL keys into compressed blocks; a sparse directory holds each block's first key. A lookup searches the
directory, then one block, and reads just the record's bytes from its archive.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, hinted, put
from rowgrad.session import scratch_path

SAME_FROM = 100  # payloads of fewer bytes are always written out
BLOCK = 3_000  # captures in a block at least; more when that would give more than DIRECTORY blocks
DIRECTORY = 50_000
_EMPTY = zlib.compress(b"", wbits=31)
_NO_ID = -(1 << 63)


def capture_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.a.org:80/x?y#z is org,a,www)/x?y."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", url or "").partition("#")[0]
    if not rest.startswith("//"):
        return rest
    host, slash, path = rest[2:].partition("/")
    host, mark, query = host.partition("?")
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":\d*$", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (slash or "/") + path + mark + query


def _header_value(x: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", x)


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record as a gzip member whose last byte (a zero) is left to the writer's separator."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest[:16]}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}:{digest[:16]}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    made = zlib.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, wbits=31)
    # a member ends with its length's high byte, zero below 16 MB; a longer record is followed by an empty member
    return made[:-1] if made[-1] == 0 else made + _EMPTY[:-1]


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _page(uri: str) -> int | None:
    page = uri.removeprefix("<urn:page:").split(":")[0]
    return int(page) if page else None


def _opened(path: str):
    from pyarrow import fs

    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    system, name = fs.FileSystem.from_uri(uri)
    return system, name


def write_archives(pages: DataFrame, path: str) -> None:
    """Write every row (page_id, url, html) to archives in the folder ``path``; null html is an empty payload.

    Rows whose payload (of at least SAME_FROM bytes) another row with a smaller page_id has are written as revisits of the smallest.
    """
    whole = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    whole = whole.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    same = put(whole.where(F.col("size") >= SAME_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "digests")
    whole = whole.join(hinted(same, same.count(), 112), "digest", "left")
    whole = whole.select("page_id", "url", F.when(F.col("page_id") == F.col("first"), None).when(F.col("page_id").isNull(), None).otherwise(F.col("first")).alias("refers"), "digest", "size", "payload")
    whole = whole.withColumn("payload", F.when(F.col("refers").isNull(), F.col("payload")))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                rows = b.slice(lo, 200).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["size"], r["refers"]) for r in rows], pa.binary())], names=["value"])

    # the cast relabels bytes; Spark's text writer passes them on unchanged and ends each row with the separator
    whole.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    free(same)


def captures(spark, path: str) -> DataFrame:
    """(key, page_id, file, at, length) of each record in the archives below ``path``, read in a stream."""
    files = spark.read.format("binaryFile").load(path).select("path")
    files = put(files, "archives")
    n = files.count()

    def run(batches):
        names = ["key", "page_id", "file", "at", "length"]
        for b in batches:
            for path in b.column(0).to_pylist():
                system, name = _opened(path)
                rows = []
                with system.open_input_stream(name, compression=None, buffer_size=1 << 20) as f:
                    begin, data, done = 0, b"", False
                    while data or not done:
                        d, used, out = zlib.decompressobj(31), 0, []
                        while not d.eof:
                            if not data:
                                data = f.read(1 << 20)
                                if not data:
                                    break
                            out.append(d.decompress(data))
                            used += len(data) - len(d.unused_data)
                            data = d.unused_data if d.eof else b""
                        if not d.eof:
                            done = True
                            continue
                        text = b"".join(out)
                        if text:
                            fields, _ = parsed(text)
                            from urllib.parse import unquote

                            page = _page(fields["warc-record-id"])
                            uri = fields.get("warc-target-uri")
                            rows.append((capture_key(None if uri is None else unquote(uri)), _NO_ID if page is None else page, path, begin, used))
                        begin += used
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return files.repartition(max(1, min(n, 20_000)), "path").mapInArrow(run, "key string, page_id bigint, file string, at bigint, length bigint")


def build_index(found: DataFrame) -> tuple[DataFrame, list]:
    """Blocks (block, key, page_id, n, body) and the directory: (first key, first page_id, block) in order.

    The directory has at most DIRECTORY rows and a few for each range of the sort, whatever the number of captures.
    """
    found = put(found, "captures")
    n = found.count()
    each = max(BLOCK, -(-n // DIRECTORY))
    ranges = max(1, min(2_000, -(-n // (8 * each))))

    def run(batches):
        from pyspark import TaskContext

        part, k, rows = TaskContext.get().partitionId(), 0, []

        def block(some):
            body = zlib.compress("\n".join(json.dumps(r) for r in some).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | k]), pa.array([some[0][0]]), pa.array([some[0][1]]), pa.array([len(some)]), pa.array([body], pa.binary())], names=["block", "key", "page_id", "n", "body"])

        for b in batches:
            rows += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            while len(rows) >= each:
                yield block(rows[:each])
                rows, k = rows[each:], k + 1
        if rows:
            yield block(rows)

    # code-unit order of Spark's sort and code-point order here agree: both compare UTF-8 bytes
    order = ["key", "page_id", "file", "at"]
    blocks = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("key", "page_id", "file", "at", "length").mapInArrow(run, "block bigint, key string, page_id bigint, n bigint, body binary")
    blocks = put(blocks, "blocks")
    directory = sorted((r.key, r.page_id, r.block) for r in blocks.select("key", "page_id", "block").collect())
    free(found)
    return blocks, directory


def lookup(keys: DataFrame, blocks: DataFrame, directory: list) -> DataFrame:
    """(file, at, length) of the captures of the distinct (key, page_id) in ``keys``."""
    shared = keys.sparkSession.sparkContext.broadcast(directory)

    def which(batches):
        heads = [(k, p) for k, p, _ in shared.value]
        for b in batches:
            rows = []
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # equal keys may fill several blocks, and begin in the one before the first of them
                for i in range(max(0, bisect.bisect_left(heads, (key, page)) - 1), bisect.bisect_right(heads, (key, page))):
                    rows.append((shared.value[i][2], key, page))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["block", "key", "page_id"])

    def found(batches):
        for b in batches:
            for body, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = [json.loads(x) for x in zlib.decompress(body).decode().split("\n")]
                heads = [(x[0], x[1]) for x in lines]
                rows = [lines[i][2:] for a in asked for i in range(bisect.bisect_left(heads, (a["key"], a["page_id"])), bisect.bisect_right(heads, (a["key"], a["page_id"])))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "at", "length"])

    placed = keys.select("key", "page_id").distinct().mapInArrow(which, "block bigint, key string, page_id bigint")
    # a block's list of distinct keys is no longer than the block, or than what was asked for between its first key and the next
    asked = placed.groupBy("block").agg(F.collect_list(F.struct("key", "page_id")).alias("asked"))
    return blocks.select("block", "body").join(asked, "block").select("body", "asked").mapInArrow(found, "file string, at bigint, length bigint")


def read_records(places: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records at (file, at, length), by range reads."""

    def run(batches):
        from hashlib import sha256

        name, f = None, None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            rows = []
            for path, at, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != name:
                    system, inner = _opened(path)
                    name, f = path, system.open_input_file(inner)
                fields, block = parsed(zlib.decompress(f.read_at(length, at), wbits=31))
                page = _page(fields["warc-record-id"])
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and (len(payload) != stated or sha256(payload).hexdigest() != digest):
                    raise ValueError(f"the record at {at} of {path} doesn't match its digest")
                refers = fields.get("warc-refers-to")
                rows.append((page, stated, digest, fields["warc-type"], None if refers is None else _page(refers)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

    return places.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of each row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["key", "page_id"])

    return pages.select(F.col("url").cast("string"), F.coalesce(F.col("page_id").cast("bigint"), F.lit(_NO_ID)).alias("page_id")).mapInArrow(run, "key string, page_id bigint")


def archived(pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes them, looks every page up again: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of ``pages``, repeated rows included (those that repeat the smallest page_id of a payload are responses like it). Rows without page_id
    are responses. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    blocks, directory = build_index(captures(spark, path))
    places = lookup(_keys(pages), blocks, directory)
    places = places.repartitionByRange(F.col("file"), F.col("at")).sortWithinPartitions("file", "at")
    return read_records(places)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f
"""
