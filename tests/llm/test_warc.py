import gzip
import hashlib

from pyspark.sql import functions as F

from faultsift.llm import warc

BIG = "ü" * 700


def pages(spark):
    rows = [(1, "http://a/x y", BIG), (2, None, BIG), (3, "http://b\r\n", BIG + "!"), (4, "http://c", "small"), (5, "http://d", "small")]
    rows += [(6, "http://e", None), (7, "http://f", "x\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40), (2, "http://again", BIG), (None, "http://n", BIG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "record": F.lit(1), "refers_to": F.lit(2)})


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    warc.write(df, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"))
    whole = warc.resolve(found, ["payload"]).withColumn("page_id", warc.page_of(F.col("record_id"))).collect()
    sent = sorted((r["page_id"] or 0, (r["html"] or "").encode()) for r in df.collect())
    assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in whole) == sent
    assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in whole)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in whole)
    assert kinds == [
        (0, "response", None), (1, "revisit", "<urn:page:2>"), (2, "response", None), (2, "response", None), (3, "response", None),
        (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None),
    ]
    assert {len(r["payload"]) for r in found.where("record_type = 'revisit'").collect()} == {0}
    assert {r["target_uri"] for r in whole} >= {"http://a/x%20y", "http://b%0D%0A", None}


def test_records_are_well_formed(spark, tmp_path):
    warc.write(pages(spark), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        at = 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            size = int(data[at:end].lower().partition(b"\r\ncontent-length: ")[2].partition(b"\r\n")[0])
            at = end + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4


def test_plain_and_multi_member_archives():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    assert [r[1:2] + r[5:] for r in warc.parse(one * 2)] == [("resource", b"a\r\nb")] * 2
    assert list(warc.parse(gzip.compress(one) + gzip.compress(one))) == list(warc.parse(one)) * 2
    assert list(warc.parse(b"")) == []


def test_empty(spark, tmp_path):
    warc.write(pages(spark).limit(0), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_long_archives_are_read_piece_by_piece():
    record = lambda n: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % n + bytes(i % 251 for i in range(n)) + b"\r\n\r\n"
    sizes = [0, 5, 3_000_000, 1, 2_500_000]
    whole = b"".join(map(record, sizes))
    members = b"".join(gzip.compress(record(n)) for n in sizes)
    for data in (whole, gzip.compress(whole), members, members + b"\0\0"):
        assert [len(r[5]) for r in warc.parse(data)] == sizes
    assert [len(r[5]) for r in warc.parse(gzip.compress(whole)[:-20])][:4] == sizes[:4]


def test_one_payload_of_many_pages(spark):
    headers = spark.createDataFrame([(i, "same", 5000) for i in range(2000)] + [(i, f"d{i}", 5000) for i in range(2000, 2100)] + [(3000, "d2000", 5000)], "page_id long, digest string, n_bytes long")
    got = {r["page_id"]: r["refers_to"] for r in warc.plan_revisits(headers).collect()}
    assert got == {**{i: 1999 for i in range(1999)}, 2000: 3000}


def test_revisits_find_the_response_of_their_digest(spark):
    rows = [("a", "response", None, "d1", b"one"), ("a", "response", None, "d2", b"two"), ("a", "response", None, "d2", b"two")]
    rows += [(f"r{i}", "revisit", "a", "d1", b"") for i in range(500)] + [("s", "revisit", "a", "d2", b""), ("t", "revisit", "a", None, b"")]
    rows += [("u", "revisit", "gone", "d1", b""), ("v", "revisit", None, None, b"own"), ("w", "revisit", "a", "d3", b""), (None, "response", None, "d4", b"four"), ("x", None, None, None, b"other")]
    found = spark.createDataFrame([(*r[:2], None, *r[2:]) for r in rows], warc.RECORD)
    got = sorted((r["record_id"] or "", bytes(r["payload"])) for r in warc.resolve(found, ["payload"]).collect())
    want = {"s": b"two", "t": b"two", "u": b"", "v": b"own", "w": b"", "": b"four", "x": b"other"} | {f"r{i}": b"one" for i in range(500)}
    assert got == sorted([("a", b"one"), ("a", b"two"), ("a", b"two"), *want.items()])
    assert warc.resolve(found.limit(0), ["payload"]).count() == 0
