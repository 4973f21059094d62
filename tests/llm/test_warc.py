import hashlib
import random

import pytest

from tillcast.llm.warc import archive_index, loser_tree, parse, url_key, write_archives
from tillcast.session import scratch_path

LONG = "x" * 150
PAGES = [
    (3, "http://www.B.example.com/en/1?q=A", LONG), (1, "https://b.example.com/a", LONG), (2, None, LONG), (2, "http://a.org", LONG),
    (4, "http://a.org/x y\r\nInjected: 1", "short"), (5, "http://a.org", "short"), (6, "http://a.org", None), (7, "", ""),
    (8, "http://c.net", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\nHTTP/1.1" * 9), (9, "http://c.net", "é日\x00\r\n\r\n" * 40), (1, "https://b.example.com/a", LONG),
]


def expected(pages):
    first = {}
    for i, _, html in pages:
        if len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        copy = html in first and first[html] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if copy else "response", first[html] if copy else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes, range_rows", [(32 << 20, 100_000), (2000, 2)])
def test_round_trip(spark, archive_bytes, range_rows):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("none", "digest")
    index = archive_index(pages.selectExpr("*", "1 as digest", "2 as first"), archive_bytes=archive_bytes, range_rows=range_rows)
    rows = index.collect()
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert found == expected(PAGES)
    order = [(r.urlkey, r.captured, r.page_id) for r in sorted(rows, key=lambda r: r.ordinal)]
    assert order == sorted(order)
    assert archive_index(pages.limit(0)).count() == 0


def test_archives_are_plain_records(spark):
    path = write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), scratch_path(spark, "w"))
    seen = 0
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        for at, length, fields, payload in parse(bytes(row.content)):
            seen += 1
            assert bytes(row.content)[at : at + 8] == b"WARC/1.1" and length > int(fields["Content-Length"])
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert seen == len(PAGES)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    draw = random.Random(k)
    row = lambda n: (f"u{draw.randint(0, 5)}", "t", draw.choice([None, 1, 2]), str(n), draw.randint(0, 9))
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4])
    runs = [sorted((row(n) for _ in range(draw.randint(0, 30))), key=key) for n in range(k)]
    assert list(loser_tree(runs)) == sorted((r for run in runs for r in run), key=key)


def test_url_keys():
    assert url_key("http://www.B.example.com/en/1?q=A") == "com,example,b)/en/1?q=a"
    assert url_key("") == "" and url_key("http://[broken") == "http://[broken"
