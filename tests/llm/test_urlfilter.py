"""The filter cascade, against a direct reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eraflow.llm import urlfilter
from eraflow.llm.urlfilter import Rule

RULES = [
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"), Rule("a.example.com", "", "block"), Rule("a.example.com", "/de/x", "allow"),
]


def direct(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r.key), len(r.host), r.verdict == "block"))
    return host, path, best.key, best.verdict


def urls():
    rng = random.Random(4)
    hosts = ["net", "x.net", "example.net", "a.example.net", "notexample.net", "example.com", "a.example.com", "b.a.EXAMPLE.com", "org", "y.org", "", "..net", "net."]
    paths = ["", "/", "/en/", "/en/1", "/en", "/de/", "/de/x/y", "/fr/z", "?q=/en/", "#/de/", "/EN/1"]
    out = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return out + [None, "", "net/", "http:/net/", "http://user@x.net:80/en/", "http://a://b.net/", "http://" + "a." * 5000 + "net/en/"]


@pytest.mark.parametrize("rules", [RULES, RULES[:1], RULES[4:]])
def test_against_direct_reading(spark, folder, rules):
    rows = [(i, u) for i, u in enumerate(urls())] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("key", F.lit("k"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(frame, rules, folder).collect()}
    assert got == {i: direct(u, rules) for i, u in rows}


def test_many_rules_need_many_levels(spark, folder, monkeypatch):
    monkeypatch.setattr(urlfilter, "LOWER_LEVEL_RATE", 0.5)
    keys = [f"h{i}.com/" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[::3]], "key string")
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = urlfilter.build_cascade(listed, universe, folder)
    assert len(levels) > 2
    got = universe.select("key", urlfilter.member(F.col("key"), levels).alias("m"))
    assert {r["key"] for r in got.where("m").collect()} == set(keys[::3])


def test_levels_do_not_grow_with_the_universe(spark, folder):
    listed = spark.createDataFrame([(f"l{i}",) for i in range(50)], "key string")
    small = spark.range(500).select(F.concat(F.lit("u"), "id").alias("key"))
    large = spark.range(50_000).select(F.concat(F.lit("u"), "id").alias("key"))
    bits = [sum(x.bits for x in urlfilter.build_cascade(listed, u, f"{folder}-{n}")) for n, u in enumerate((small, large))]
    assert bits[1] < 3 * bits[0]


def test_empty(spark, folder):
    frame = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(frame, RULES, folder).count() == 0
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urlfilter.judge(some, RULES[1:2], f"{folder}-b").first()["verdict"] == "allow"


def test_bad_rules():
    for bad in (("", "/", "allow"), ("a/b", "/", "allow"), ("a", "x", "allow"), ("a", "/", "maybe")):
        with pytest.raises(ValueError):
            Rule(*bad)


def test_plan_has_no_join_and_no_python(spark, folder):
    frame = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urlfilter.judge(frame, RULES, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subqueries")[0] and "Python" not in plan
