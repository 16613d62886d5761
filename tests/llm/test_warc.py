import base64
import hashlib

from chronoloom.llm import warc
from chronoloom.plans.materialize import new_folder


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def expected(rows):
    low = {}
    for i, _, h in rows:
        if i is not None:
            low[h or ""] = min(i, low.get(h or "", i))
    out = []
    for i, _, h in rows:
        p, first = (h or "").encode(), low.get(h or "")
        same = first is not None and i != first
        out.append((i, len(p), b32(p), "revisit" if same else "response", first if same else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip_with_odd_rows(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u\r\nX: y", None), (4, "", ""), (None, "n", "x"), (None, "m", "lone"),
            (5, "big", "é" * 300_000), (6, "big2", "é" * 300_000), (7, "r", "same"), (7, "r", "same"), (-9, "neg", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as sha1", "3 as path")
    assert got(warc.archive_round_trip(df, file_bytes=2000)) == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df).count() == 0


def test_whole_table_and_random_access(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    folder = new_folder(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, file_bytes=200_000)
    back = warc.read_archives(manifest, folder)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(back) == expected(rows)
    assert manifest.count() > 1
    one = back.where("record_type = 'response'").first()
    alone = warc.read_record(folder, one.path, one.offset, one.length)
    html = dict((r[0], r[2] or "") for r in rows)
    assert alone["payload"].decode() == html[one.page_id] and alone["page_id"] == one.page_id
