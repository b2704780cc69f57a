import gzip
import hashlib
import io
import zlib

import pytest
from cases import by_id
from conftest import SF_SMALL
from keelson.llm import queries, warc


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS page", "'x' AS digest", "'x' AS file", "'x' AS revisit")


def through(df) -> list:
    return warc.read_records(warc.normalise(warc.write_monolithic(warc.with_record_types(df)))).collect()


def test_query_covers_every_page(spark):
    import duckdb
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF_SMALL}/pages.parquet'").fetchall())
    got = by_id(queries.op8_warc_normalise(spark, SF_SMALL), "page_id")
    assert got.keys() == pages.keys()
    last = {}
    for i, html in pages.items():
        last[html] = max(i, last.get(html, i))
    for i, html in pages.items():
        body = (html or "").encode()
        revisit = len(body) >= 1000 and last[html] != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", last[html]) if revisit else ("response", None))


def test_revisits_and_odd_rows(spark):
    big, sly = "é" * 500, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40
    rows = [(1, "u", big), (2, None, big), (9, "a b\r\nc", big), (3, "u", "é" * 499), (4, "u", "é" * 499), (5, "u", None), (6, "u", ""),
            (7, "u", sly), (8, "u", sly), (-3, "u", "\0" * 3_000_000), (None, "u", big), (None, "u", "z" * 2000), (None, "u", "z" * 2000),
            (9, "again", big)]
    out = through(pages_frame(spark, rows))
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out if r["page_id"] is not None}
    assert [got[i]["refers_to"] for i in (1, 2, 9, 3, 4, 7, 8)] == [9, 9, None, None, None, 8, None]
    assert got[1]["payload_bytes"] == 1000 and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert got[5]["payload_bytes"] == 0 and got[-3]["payload_bytes"] == 3_000_000
    lost = sorted((r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in out if r["page_id"] is None)
    assert lost == [("response", 0, 2000), ("response", 0, 2000), ("revisit", 9, 1000)]
    assert through(pages_frame(spark, [])) == []


def test_normaliser_splits_one_stream_into_members(spark):
    whole = warc.write_monolithic(warc.with_record_types(pages_frame(spark, [(i, f"u{i}", f"page {i} " * 300) for i in range(20)])))
    for r in whole.collect():
        with open(r["file"], "rb") as f:
            d = zlib.decompressobj(31)
            d.decompress(f.read())
            assert d.eof and not d.unused_data                       # one member a file
    index = warc.normalise(whole).collect()
    assert len(index) == 20
    for r in index:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            raw = zlib.decompress(f.read(r["length"]), 31)           # a member of its own
        assert raw.startswith(b"WARC/1.1\r\n") and r["record_id"].encode() in raw


def test_streams_of_many_members_and_truncated_ones():
    records = [warc.record_bytes(i, "u", b"p" * i * 1000, "d") for i in range(40)]
    blob = b"".join(gzip.compress(r) for r in records[:20]) + gzip.compress(b"".join(records[20:]))
    assert list(warc.records_in(io.BytesIO(blob))) == records
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(gzip.compress(records[3][:-10]))))
