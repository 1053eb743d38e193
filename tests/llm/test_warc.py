"""WARC bundles: SQL and brute force, frames opened alone, damaged and odd rows."""

import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.compare import duck, same
from tideframe.llm import queries, warc

SCHEMA = "page_id long, url string, html string, frame int, digest string, archive long"


def brute(rows, min_bytes=0):
    """Of each payload of ``rows(page_id, html)`` the largest page_id (one row of it) is the response."""
    payloads = [(p, (h or "").encode("utf-8")) for p, h in rows]
    top, out, seen = {}, [], set()
    for p, h in payloads:
        if len(h) >= min_bytes:
            top[h] = max(top.get(h, (False, 0)), (p is not None, p or 0))
    for p, h in payloads:
        has, largest = top.get(h, (None, None))
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        response = has is None or (p is not None, p or 0) == (has, largest) and h not in seen
        if has is not None and response:
            seen.add(h)
        out.append((p, len(h), digest, "response" if response else "revisit", None if response else (largest if has else None)))
    return sorted(out, key=repr)


def read(index, **how):
    found = warc.read_archives(index, **how).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted([tuple(r) for r in found.collect()], key=repr)


ROWS = [(i, f"<p>{'x' * (i * 37 % 500)}</p>") for i in range(60)]
ROWS += [(100 + i, "<html>copy é日</html>") for i in range(40)]
ROWS += [(200, None), (201, ""), (None, "no id"), (None, "no id"), (7, "no id"), (300, "twice"), (300, "twice"), (300, "twice"), (301, "long" * 100_000), (None, "alone")]
ROWS += [(302, "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(p, None if p == 3 else f"http://a/{p} \n{p}", h, 1, "clash", 2) for p, h in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op11_warc(spark, sf), duck(sf), warc.ORACLE)


def test_brute_force_and_odd_rows(spark, pages):
    assert read(warc.write_archives(pages, frame_bytes=2000)) == brute(ROWS)


def test_small_payloads_stay_responses(spark, pages):
    assert read(warc.write_archives(pages, min_bytes=10)) == brute(ROWS, 10)


def test_empty_table(spark, pages):
    index = warc.write_archives(pages.where("page_id < 0"))
    assert read(index) == [] and index.count() == 0


def test_frames_archives_and_single_records(spark, pages):
    index = warc.write_archives(pages, frame_bytes=1500, archive_bytes=4000).cache()
    places = [tuple(r) for r in index.select("archive", "frame", "offset", "length", "record_id").collect()]
    assert len({p[4] for p in places}) == len(ROWS)  # identifiers are unique
    names = {p[0] for p in places}
    assert len(names) > 3 and max(p[1] for p in places) > 0  # archives were closed, frames were cut
    for name in names:
        raw = open(name.removeprefix("file://"), "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()  # as any tool reads it
        opened = warc.Opened(name)
        frames = [opened.frame(k) for k in range(len(opened.sizes))]
        assert b"".join(frames) == whole and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for _, frame, offset, length, identifier in (p for p in places if p[0] == name):
            fields, _, stop = warc.parse(frames[frame], offset)
            assert fields["warc-record-id"] == identifier and stop - offset == length
    wanted = spark.createDataFrame([(5,), (110,), (301,), (999,), (5,)], "page_id long")
    got = {r["page_id"]: r for r in warc.fetch(index, wanted).collect()}
    assert set(got) == {5, 110, 301} and bytes(got[301]["payload"]) == b"long" * 100_000
    assert got[110]["record_type"] == "revisit" and got[110]["payload"] is None and got[110]["refers_to"] == 139
    assert got[5]["url"] == "http://a/5%20%0A5"
    assert read(index, block_frames=1) == brute(ROWS)
    responses = warc.read_archives(index, with_payload=True).where("record_type = 'response'").select(F.sum(F.octet_length("payload")).alias("n"), F.sum("payload_bytes").alias("m")).first()
    assert responses["n"] == responses["m"]


def test_damage_is_noticed():
    sink = io.BytesIO()
    sink.close = lambda: None
    bundle = warc.Bundle(sink)
    _, data = warc.record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"other").digest()).decode(), False, None, "", warc.DATE)
    bundle.add(data)
    bundle.close()
    fields, block, _ = warc.parse(data, 0)
    with pytest.raises(ValueError, match="damaged"):
        warc._row(fields, block, True)
