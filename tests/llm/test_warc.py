"""Archives: every page comes back, members stand alone, revisits refer to the largest id."""

import base64
import gzip
import hashlib
import io
import json
import zlib

import pyarrow.fs as pafs
import pytest

from repograin.llm import warc
from repograin.llm.store import new_folder

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://a/4\n5", "Größe\r\n\r\nWARC/1.1\r\n"),
    (5, "u", None), (6, "u", ""), (7, "long", "x<br>" * 400_000), (None, "no id", "<p>same</p>"), (None, "no id", "alone"), (8, "twice", "tie"), (8, "twice", "tie"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip(spark):
    from pyspark.sql import functions as F

    got = warc.round_trip(pages(spark, PAGES).withColumn("payload", F.lit("clash")).withColumn("sha", F.lit(1))).collect()
    assert len(got) == len(PAGES)
    largest = {}
    for i, _, html in PAGES:
        largest[html or ""] = max((x for x in (largest.get(html or ""), i) if x is not None), default=None)
    want = []
    for i, _, html in PAGES:
        data, keeper = (html or "").encode(), largest[html or ""]
        again = keeper is not None and i != keeper
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in PAGES}
    assert [r.url for r in got if r.page_id == 4] == ["http://a/4%0A5"]


def test_small_payloads_are_not_revisited(spark):
    got = warc.with_revisits(pages(spark, PAGES), least_bytes=8).collect()
    assert {r.page_id for r in got if r.refers_to is not None} == {1, 2, None}


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_members_and_sidecar(spark, monkeypatch):
    folder, target = new_folder(spark, "warc"), new_folder(spark, "warc")
    archives = warc.write_archives(warc.with_revisits(pages(spark, PAGES).coalesce(1)), folder)
    (row,) = archives.collect()
    index = warc.normalise(archives, target).collect()
    assert row.records == len(index) == len(PAGES)
    fs, old = pafs.FileSystem.from_uri(row.path)
    raw = fs.open_input_file(old).read()
    one = zlib.decompressobj(31)
    whole = one.decompress(raw)
    assert one.eof and not one.unused_data  # one stream over the whole file
    _, new = pafs.FileSystem.from_uri(index[0].path)
    data = fs.open_input_file(new).read()
    assert gzip.decompress(data) == whole
    assert b"".join(gzip.decompress(data[r.offset : r.offset + r.length]) for r in sorted(index, key=lambda r: r.offset)) == whole
    side = [json.loads(x) for x in fs.open_input_file(new + ".idx").read().splitlines()]
    assert [(x["offset"], x["length"]) for x in side] == sorted((r.offset, r.length) for r in index)


def test_truncated_archives_are_an_error():
    data = warc.record(1, "u", b"payload", None)
    for cut in (20, len(data) - 3):
        with pytest.raises(ValueError):
            list(warc.normalise_stream(io.BytesIO(gzip.compress(data[:cut])), io.BytesIO()))
    twice = io.BytesIO()
    assert len(list(warc.normalise_stream(io.BytesIO(gzip.compress(data) + gzip.compress(data)), twice))) == 2
