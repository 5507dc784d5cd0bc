"""The archives and their index, against a direct computation."""

import base64
import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from eraflow.llm import warc

SCHEMA = "page_id long, url string, html string, path string, size int"


def run(pages, folder):
    captures = warc.write_archives(pages, folder)
    shards = warc.build_index(captures, folder)
    asked = pages.select(warc.index_key(F.col("url")).alias("key"), "page_id")
    return captures, shards, warc.read_records(warc.lookup(asked, shards))


def expected(rows):
    best = {}
    for page, _, html, *_ in rows:
        best.setdefault(html or "", []).append(page)
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [p for p in best[html or ""] if p is not None]
        top = max(ids) if ids and len(best[html or ""]) > 1 else page
        mark = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), mark, "response" if page == top else "revisit", None if page == top else top))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip_with_odd_rows(spark, folder):
    rng = random.Random(2)
    rows = [
        (1, None, "x", "p", 1), (2, "http://a.b/c d\n", "x", "p", 1), (3, "no scheme", None, None, None), (4, "", "", "p", 1),
        (None, "http://a.b/", "x", "p", 1), (None, None, "lonely", "p", 1), (5, "http://Ä.de/ü?q#f", "é" * 10, "p", 1),
        (6, "http://a.b/", "line\r\n\r\nWARC/1.1\r\n", "p", 1), (7, "http://a.b/", "y" * 500_000, "p", 1), (8, "://", "x", "p", 2),
    ]
    rows += [(100 + i, f"https://h{rng.randrange(20)}.example.org/{i % 50}", f"body {rng.randrange(90)}", "p", 0) for i in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    _, _, records = run(pages, folder)
    got = sorted((tuple(r) for r in records.select(*COLUMNS).collect()), key=repr)
    assert got == expected(rows)


def test_repeated_rows_are_captures_of_their_own(spark, folder):
    rows = [(1, "http://a/", "x", "p", 1)] * 3 + [(2, "http://a/", "x", "p", 1)]
    _, _, records = run(spark.createDataFrame(rows, SCHEMA), folder)
    assert sorted(r["record_type"] for r in records.collect()) == ["response", "revisit", "revisit", "revisit"]


def test_empty_table(spark, folder):
    captures, shards, records = run(spark.createDataFrame([], SCHEMA), folder)
    assert captures.count() == 0 and shards == [] and records.count() == 0


def test_records_are_valid_members(spark, folder):
    rows = [(i, f"http://s{i}.net/", f"<p>{i % 3}</p>", "p", 1) for i in range(30)]
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder)
    path = captures.first()["path"].removeprefix("file://")
    raw = gzip.open(io.BytesIO(open(path, "rb").read())).read()  # members follow each other
    assert raw.count(b"WARC/1.1\r\n") == 30 and raw.count(b"WARC-Type: revisit") == 27


def test_lookup_by_key_crosses_blocks_and_files(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 4}.com/x", f"{i}", "p", 1) for i in range(300)]
    pages = spark.createDataFrame(rows, SCHEMA)
    shards = warc.build_index(warc.write_archives(pages, folder), folder)
    reader = warc.IndexReader(shards)
    key = b"com,h2)/x"
    assert [r[1] for r in reader.between((key, False, 0), (key, True, 1 << 63))] == list(range(2, 300, 4))
    assert list(reader.between((b"a", False, 0), (b"b", False, 0))) == []
    asked = spark.createDataFrame([("com,h1)/x",), ("zzz",), ("",)], "key string")
    found = warc.lookup(asked, shards, exact=False)
    assert sorted(r["page_id"] for r in found.collect()) == list(range(1, 300, 4))


def test_keys_are_reversed_hosts(spark):
    rows = [("http://WWW.Example.com:80/A?b",), ("https://a",), ("nothing",), (None,), ("http://a.b/x y",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(warc.index_key(F.col("u"))).collect()]
    assert got == ["com:80,example,www)/A?b", "a)", ")nothing", ")", "b,a)/x%20y"]
