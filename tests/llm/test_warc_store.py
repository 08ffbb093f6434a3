import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from quillmesh.llm import warc_store as A

BIG = "<html>" + "x" * 200


def rows():
    out = [(7, "http://a/é", BIG), (3, "http://b", BIG), (9, None, BIG), (4, "http://c", "tiny"), (5, "u\r\nEvil: 1", "tiny"), (6, "", None), (8, "http://d", ""), (10, "http://e", "é" * 60), (11, "http://f", "é" * 60), (12, "http://g", "z" * 99), (13, "http://h", "z" * 99)]
    return out + [(100 + i, f"http://m/{i}", f"<p>{i % 30}</p>" * 40) for i in range(200)]


def expected(table):
    first = {}
    for p, _, h in table:
        h = h or ""
        first[h] = min(p, first.get(h, p))
    out = {}
    for p, _, h in table:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != p
        out[p] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)
    return out


def test_round_trip(spark):
    table = rows()
    df = spark.createDataFrame([(*r, "x") for r in table], "page_id long, url string, html string, record_type string").repartition(5)
    got = A.archive_pages(df).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(table)
    assert len(got) == len(table)
    payloads, headers = A.write_archive(df)
    assert payloads.count() == payloads.select("digest").distinct().count() == len({h or "" for _, _, h in table})
    head = {r.page_id: r.header for r in headers.collect()}
    want = expected(table)
    for r in A.read_records(payloads, headers).collect():
        html = next(h for p, _, h in table if p == r.page_id) or ""
        body = html.encode() if want[r.page_id][2] == "response" else b""
        assert bytes(r.record) == head[r.page_id].encode() + body + b"\r\n\r\n"
        block = bytes(r.record).split(b"\r\n\r\n", 1)[1][:-4]
        length = int(head[r.page_id].split("Content-Length: ")[1].split("\r\n")[0])
        assert len(block) == length and b"\nEvil" not in head[r.page_id].encode()
        parsed = A.parse_record(bytes(r.record))
        url = next(u for p, u, _ in table if p == r.page_id) or ""
        assert parsed["uri"] == url.replace("\r", "%0D").replace("\n", "%0A") and parsed["declared"] == parsed["length"]
        assert (parsed["payload"] is None) == (want[r.page_id][2] == "revisit") and parsed["refers_to"] == want[r.page_id][3]


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    payloads, _ = A.write_archive(df)
    assert [r.intact for r in A.verify(payloads).collect()] == [True]
    assert [r.intact for r in A.verify(payloads.withColumn("digest", F.lit("0" * 64))).collect()] == [False]


def test_damaged_records_raise(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", BIG), (2, "u", BIG)], "page_id long, url string, html string")
    payloads, headers = A.write_archive(df)
    spoilt = payloads.withColumn("packed", F.lit(zstandard.ZstdCompressor().compress(b"x" * len(BIG))))
    for broken in ((spoilt, headers), (payloads, headers.where("page_id = 2")), (payloads.limit(0), headers)):
        monkeypatch.setattr(A, "write_archive", lambda pages, broken=broken: broken)
        with pytest.raises(Exception, match="damaged record of page"):
            A.archive_pages(df).collect()


def test_a_long_payload(spark):
    html = "<p>é</p>" * 400_000
    got = A.archive_pages(spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, 9 * 400_000, "response"), (2, 9 * 400_000, "revisit")]


@pytest.mark.parametrize("table", [[], [(None, None, None), (2, "u", BIG), (2, "u", BIG)]])
def test_edges(spark, table):
    got = A.archive_pages(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    assert len(got) == len(table)
    assert all(r.record_type == "response" for r in got)
