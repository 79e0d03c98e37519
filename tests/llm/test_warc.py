import base64
import hashlib
import io
import os
from collections import Counter

import pytest
import zstandard
from hypothesis import given, strategies as st

from cdrloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, keeper string"


def brute(rows, least):
    """(page_id, bytes, digest, type, refers_to) by comparing all payloads."""
    payload = [(html or "").encode() for _, _, html in rows]
    out = []
    for (page_id, _, _), own in zip(rows, payload):
        ids = [i for (i, _, _), p in zip(rows, payload) if p == own and i is not None]
        keeper = max(ids) if ids and len(own) >= least else None
        revisit = keeper is not None and page_id != keeper
        out.append((page_id, len(own), hashlib.sha1(own).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return out


@pytest.fixture(scope="module")
def pages():
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(k, f"http://a/{k}", big) for k in range(30)]
    rows += [(100, None, None), (101, "http://b/ \r\nWARC-Type: x", ""), (102, "é", "y" * 999), (103, "u", "y" * 999), (-5, "u", other), (-9, "u", other)]
    rows += [(None, "u", other), (None, "u", "z" * 2000), (None, None, "z" * 2000), (104, "u", "WARC/1.1\r\n\r\n" * 100), (105, "u", "q" * 70000)]
    return rows + [(29, "http://a/29", big), (200, "u", "r" * 1500), (200, "u", "r" * 1500), (-(1 << 63), "u", "m" * 5)]


@pytest.fixture(scope="module")
def written(spark, pages, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}"
    table = spark.createDataFrame([(*r, "x", None) for r in pages], SCHEMA)
    return folder, warc.write(table, folder, warc.WarcConfig(frame=4000, bundle=300)), table


def test_records_equal_brute_force(spark, pages, written):
    found = [tuple(r) for r in warc.read(spark, written[0]).collect()]
    assert Counter(found) == Counter(brute(pages, 1000))


def test_hot_groups_take_the_broadcast(spark, pages, written, monkeypatch):
    monkeypatch.setattr(warc, "HOT_COPIES", 5)
    assert Counter(map(tuple, warc.round_trip(written[2]).collect())) == Counter(brute(pages, 1000))


def test_bundles_are_plain_zstandard_with_a_seek_table(written):
    folder = written[0].removeprefix("file://")
    index = written[1].collect()
    assert len({r.archive for r in index}) > 1 and max(r.frame for r in index) > 0
    for archive in {r.archive for r in index}:
        with open(f"{folder}/{archive}", "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        reader = warc._open(written[0], archive)
        frames = [reader.read(k) for k in range(len(reader.entries))]
        assert b"".join(frames) == whole
        assert os.path.getsize(f"{folder}/{archive}") == reader.starts[-1] + 8 + 12 * len(frames) + 9
        for r in index:
            if r.archive == archive:
                record = frames[r.frame][r.offset:r.offset + r.length]
                assert f"WARC-Record-ID: <{r.record_id}>".encode() in record and record.endswith(b"\r\n\r\n")


def test_fetch_follows_revisits(written, pages):
    found = {r.record_id: bytes(r.payload) for r in warc.fetch(written[1].select("record_id"), written[0]).collect()}
    assert len(found) == len({r.record_id for r in written[1].collect()})
    for page_id, _, html in pages:
        payload = (html or "").encode()
        assert found[warc.record_uri(page_id, hashlib.sha1(payload).hexdigest())] == payload


def test_headers_stay_one_line_each(written, spark):
    record = warc.build_record(1, "http://b/ \r\nWARC-Type: x", b"p", hashlib.sha1(b"p").hexdigest(), None, "d")
    (_, size, fields, block), = warc.parse_records(record)
    assert size == len(record) and fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://b/%20%0D%0AWARC-Type:%20x"
    assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"p").digest()).decode()
    assert warc.read_block(fields, block)[2] == b"p"


def test_damage_is_found():
    out = io.BytesIO()
    out.close, data = lambda: None, b"abc" * 50
    bundle = warc.Bundle(out, 100, 3)
    bundle.add(data)
    bundle.close()
    raw = bytearray(out.getvalue())
    assert warc.BundleReader(io.BytesIO(bytes(raw)), len(raw)).read(0) == data
    raw[-10] ^= 1  # the checksum in the seek table
    with pytest.raises(ValueError):
        warc.BundleReader(io.BytesIO(bytes(raw)), len(raw)).read(0)


@given(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)))
def test_identifiers_hold_the_id(page_id):
    assert warc.page_of(warc.record_uri(page_id, "ab" * 20)) == page_id


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(table).collect() == []
