"""WARC archives: writing, normalising whole-file gzip streams, reading by offset.

``write_monolithic`` writes one gzip stream per file, as a careless crawler
does.  ``normalise`` inflates each stream once, front to back, rewrites every
record as a gzip member of its own and returns the sidecar index (file, offset,
length, record), which ``read_records`` uses to read any records in parallel.

Files lie under the shared checkpoint folder and are opened through pyarrow's
file systems (local, HDFS or object store by the folder's URI).  Each attempt of
a task writes a file of its own name; only files named in the stored result of
a step count, so retries and lost executors leave no wrong data.

Contract for odd input: a null html is an empty payload; a null page id is
written as such and never is the response of a group unless all ids are null;
rows equal in id and payload are all the response if that id is the largest;
empty tables give no files and no records.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import scratch_dir

from .common import map_batches, stored

REVISIT_LEAST = 1000           # payloads below this many bytes are never revisits
CHUNK = 1 << 18
SPLIT_BYTES = 8 << 20          # normalised bytes that one reading task gets together, about
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records

def _uri(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(uri: str | None):
    m = re.fullmatch(r"<urn:page:(null|-?\d+)>", uri or "")
    return None if m is None or m[1] == "null" else int(m[1])


def _header_value(text: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_bytes(page, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page)}",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}",
            *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"] if revisit else []),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers_of(head)
    http, _, payload = rest[:int(h["content-length"])].partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    return {"page_id": _page(h["warc-record-id"]),
            "payload_bytes": int(headers_of(http)["content-length"]) if revisit else len(payload),
            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if revisit
            else hashlib.sha1(payload).hexdigest(),
            "record_type": h["warc-type"], "refers_to": _page(h.get("warc-refers-to")) if revisit else None}


def records_in(stream) -> Iterator[bytes]:
    """Records of one inflated WARC stream, read in chunks; holds one record."""
    inflate, held = zlib.decompressobj(31), b""

    def more() -> bytes:
        nonlocal inflate
        while True:
            raw = inflate.unconsumed_tail or inflate.unused_data or stream.read(CHUNK)
            if inflate.eof:                              # the stream may consist of several members
                inflate = zlib.decompressobj(31)
            if not raw:
                return b""
            out = inflate.decompress(raw, 4 * CHUNK)
            if out:
                return out

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            new = more()
            if not new:
                if held.strip():
                    raise ValueError("truncated WARC record")
                return
            start = max(0, len(held) - 3)
            held += new
            end = held.find(b"\r\n\r\n", start)
        size = end + 4 + int(headers_of(held[:end])["content-length"]) + 4
        if len(held) < size:
            parts, have = [held], len(held)
            while have < size:
                new = more()
                if not new:
                    raise ValueError("truncated WARC record")
                parts.append(new)
                have += len(new)
            held = b"".join(parts)
        yield held[:size]
        held = held[size:]


# ---------------------------------------------------------------- files

def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _prepared(df: DataFrame, name: str) -> str:
    """A new shared folder, made by the driver."""
    folder = scratch_dir(df.sparkSession, name)
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    return folder


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(page, url, html, digest, refers_to, revisit): of equal large payloads the largest id is the response."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html")) \
        .withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= REVISIT_LEAST
    # one row per digest and task crosses the exchange; only repeated payloads are joined back
    groups = rows.filter(large).groupBy("digest").agg(F.max("page").alias("last"), F.count("*").alias("copies")) \
        .filter("copies > 1").select("digest", "last")
    joined = rows.join(groups, "digest", "left")
    revisit = large & F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last"))
    return joined.select("page", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"),
                         F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_monolithic(records: DataFrame) -> DataFrame:
    """Write one whole-file gzip stream per task; (file, records), stored."""
    folder = _prepared(records, "warc-whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        name, sink, count = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        for b in batches:
            sink = sink or files.open_output_stream(name, compression=None)
            for r in b.to_pylist():
                sink.write(squeeze.compress(record_bytes(r["page"], r["url"], r["html"].encode("utf-8"), r["digest"],
                                                         r["refers_to"], r["revisit"])))
                count += 1
        if sink is not None:
            sink.write(squeeze.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return stored(map_batches(records, run, "file string, records bigint"), "warc-whole-files")


def normalise(whole: DataFrame) -> DataFrame:
    """One member per record; the stored sidecar index (file, offset, length, record_id, record_type)."""
    folder = _prepared(whole, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        for b in batches:
            for source in b.column(0).to_pylist():
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                rows: list[tuple] = []
                offset = 0
                with files.open_input_stream(source, compression=None) as stream, \
                        files.open_output_stream(name, compression=None) as sink:
                    for raw in records_in(stream):
                        h = headers_of(raw[:raw.index(b"\r\n\r\n")])
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        sink.write(member)
                        rows.append((name, offset, len(member), h["warc-record-id"], h["warc-type"]))
                        offset += len(member)
                        if len(rows) == 10_000:
                            yield index_batch(rows)
                            rows = []
                yield index_batch(rows)

    def index_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          names=["file", "offset", "length", "record_id", "record_type"])

    # one stream is one task's work; the number is given, as a plan that saw only the short names would join them
    spread = whole.select("file").repartitionByRange(max(1, whole.count()), "file")
    return stored(map_batches(spread, run, "file string, offset bigint, length bigint, record_id string, "
                              "record_type string"), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of indexed records, read at their offsets."""
    size = index.agg(F.sum("length").alias("b")).first()["b"] or 0
    splits = index.select("file", "offset", "length", F.floor(F.col("offset") / SPLIT_BYTES).alias("split"))
    near = splits.repartition(max(1, -(-size // SPLIT_BYTES)), "file", "split").sortWithinPartitions("file", "offset")
    base = scratch_dir(index.sparkSession, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(base)
        name, source = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = r["file"], files.open_input_file(r["file"])
                source.seek(r["offset"])
                rows.append(parse_record(zlib.decompress(source.read(r["length"]), 31)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)],
                                             names=names)
        if source is not None:
            source.close()

    return map_batches(near, run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                       "refers_to bigint")
