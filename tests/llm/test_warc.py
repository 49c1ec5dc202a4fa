from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest
from compare import connection, difference

from wattweave.llm import warc
from wattweave.llm.common import scratch_path
from wattweave.llm.queries import ORACLES, op9_warc


def test_matches_duckdb(spark, sf):
    assert difference(op9_warc(spark, sf), connection(sf), ORACLES["op9_warc"]) == ""


def test_edges(spark, clash):
    long = "<p>é</p>" * 200
    rows = [(1, "http://a\r\nb", long), (2, None, long), (3, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "x" * 3_000_000), (None, "u", "y" * 2000), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (3, "u", long)]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = warc.archive_pages(df).collect()
    assert len(out) == len(rows)
    html = {r[0]: r[2] or "" for r in rows}
    for r in out:
        full = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(full) and r["payload_digest"] == hashlib.sha1(full).hexdigest()
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and r["payload"] in (None, full)
    told = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in out}
    assert told[1] == told[2] == ("revisit", 3) and told[3] == ("response", None) and told[4] == told[5] == ("response", None)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_members_are_found_by_the_index(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 300) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, scratch_path(spark, "warc"))
    whole = b"".join(gzip.decompress(open(r["archive"].removeprefix("file:").replace("//", "/"), "rb").read()) for r in archives.collect())
    members = warc.normalise_archives(archives).collect()
    parts = b""
    for m in members:
        data = open(m["members"].removeprefix("file:").replace("//", "/"), "rb").read()
        for line in open(m["index"].removeprefix("file:").replace("//", "/")):
            offset, length, name, kind = line.rstrip("\n").split("\t")
            one = zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)
            assert one.startswith(warc.HEAD) and one.count(b"WARC-Type") == 1 and name.encode() in one
            parts += one
    assert sorted(parts.split(warc.HEAD)) == sorted(whole.split(warc.HEAD))


def test_streams_of_several_members_and_small_reads():
    records = [warc.record(i, "u", bytes([i]) * i * 1000, "00" * 20, i * 1000, None, False) for i in range(1, 30)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert list(warc._records(warc._Inflated(io.BytesIO(data)))) == records


def test_cut_streams_and_short_records_are_errors():
    records = [warc.record(i, "u", bytes([i]) * 5000, "00" * 20, 5000, None, False) for i in range(6)]
    whole = gzip.compress(b"".join(records), mtime=0)
    assert list(warc._records(warc._Inflated(io.BytesIO(whole + b"\0" * 70_000)))) == records
    assert list(warc._records(warc._Inflated(io.BytesIO(gzip.compress(b"".join(records)[:-4]))))) == records  # the last line ends are put back
    for data in (whole[: len(whole) // 2], whole[:-9], whole[:3], b"", whole + gzip.compress(b"x" * 99)[:12]):
        with pytest.raises(EOFError):
            list(warc._records(warc._Inflated(io.BytesIO(data))))
    for data in (b"".join(records)[:-100], records[0] + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", records[0] + b"WARC/1.1\r\nContent-Length: 5"):
        with pytest.raises(ValueError, match="record"):
            list(warc._records(warc._Inflated(io.BytesIO(gzip.compress(data)))))


def test_tasks_begin_new_archives_by_size(spark):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 300) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, scratch_path(spark, "warc"), archive_bytes=10_000)
    told = archives.collect()
    assert len(told) >= 8 and sum(r["records"] for r in told) == 30
    assert sorted(r["page_id"] for r in warc.read_archives(warc.normalise_archives(archives)).collect()) == list(range(30))
