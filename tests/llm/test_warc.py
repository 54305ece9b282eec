import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tallywright.llm import warc
from tallywright.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, file string, offset int"


def roundtrip(spark, rows, least=0):
    df = spark.createDataFrame(rows, SCHEMA)
    index = warc.write(warc.plan_records(df, least=least), scratch_path(spark, "warc-test"))
    return index, warc.read(index)


def test_archives_hold_every_page(spark):
    html = ["<p>Grüße</p>", "<p>same</p>", "", None, "x" * 3_000_000, "a\r\n\r\nb"]
    rows = [(i, f"http://h/{i}\r\nInjected: x", html[i % len(html)], "f", 1) for i in range(60)] + [(59, "u", html[59 % 6], "f", 1), (None, None, "<p>same</p>", None, None)]
    index, records = roundtrip(spark, rows)
    got = records.collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h, *_ in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", -1))
    sha = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in largest}
    for r in got:
        h = sha[r["payload_digest"]]
        if r["page_id"] == largest[h]:
            assert r["headers"]["warc-type"] == "response" and r["payload"] == h.encode() and r["sha1_base32"] == r["payload_digest"]
        else:
            assert r["headers"]["warc-type"] == "revisit" and r["refers_to"] == largest[h] and r["payload"] == b""
            assert r["headers"]["warc-refers-to"] == warc.record_id(largest[h])
        assert "injected" not in r["headers"]
    with open(index.first()["file"].replace("file://", ""), "rb") as f:  # members in sequence are one gzip file
        assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == index.where(F.col("file") == index.first()["file"]).count()


def test_small_payloads_and_selected_records(spark):
    rows = [(i, "u", "tiny", "", 0) for i in range(5)] + [(10 + i, "u", "large enough", "", 0) for i in range(5)]
    index, _ = roundtrip(spark, rows, least=6)
    assert index.where("record_type = 'response'").count() == 6
    some = warc.read(index.where("page_id in (0, 14)"))
    assert sorted(r["payload"] for r in some.collect()) == [b"large enough", b"tiny"]


def test_empty_table(spark):
    assert roundtrip(spark, [])[1].collect() == []


def test_neighbouring_ranges_are_read_at_once():
    assert warc.coalesced([(0, 10), (10, 5), (30, 5), (500, 5)], gap=20, most=100) == [(0, 35, [0, 1, 2]), (500, 505, [3])]
    assert warc.coalesced([(0, 80), (80, 80)], gap=20, most=100) == [(0, 80, [0]), (80, 160, [1])]
