"""Winnowing, against every window of every text."""

import random
import re

import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, words

import eraflow.llm.common as common
from eraflow.llm import decontam


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def direct(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, folder):
    left = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], SCHEMA).repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(left, right, folder).collect()
    assert all(r["n_items"] == len(r["item_ids"]) and r["contaminated"] == (r["n_hit"] > 0) for r in got)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=repr)


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_against_every_window(spark, folder, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    items = [(i, words(rng, n, 30)) for i, n in enumerate([25, 10, 11, 40, 9, 4, 1, 12, 12])]
    items += [(100, None), (101, "!!!"), (102, items[0][1]), (0, items[3][1]), (103, "a a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        part = rng.choice(items[:9])[1].split()
        cut = rng.randrange(len(part))
        mixed = words(rng, rng.randrange(30), 30).split() + part[cut:] + words(rng, rng.randrange(30), 30).split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(mixed).upper() if i % 2 else " ".join(mixed)))
    docs += [(70, None), (71, ""), (72, "..."), (73, "a " * 500), (74, items[0][1]), (74, items[0][1]), (74, "clean"), (None, items[1][1])]
    assert run(spark, docs, items, folder) == direct(docs, items)


@pytest.mark.parametrize("place", range(0, 30, 3))
def test_every_span_of_ten_words_is_found(spark, folder, place):
    rng = random.Random(place)
    item = words(rng, 40, 10_000)
    inside = " ".join(item.split()[place : place + 10])
    docs = [(1, words(rng, 17, 10_000) + " " + inside + " " + words(rng, 23, 10_000)), (2, " ".join(item.split()[place : place + 9]))]
    assert run(spark, docs, [(1, item)], folder) == direct(docs, [(1, item)])


def test_spans(spark, folder):
    item = " ".join(f"i{n}" for n in range(12))
    docs = spark.createDataFrame([(1, "x y " + item + " z", "en", "a", 0)], SCHEMA)
    got = decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), folder).first()
    assert [(s["start"], s["n"]) for s in got["spans"]] == [(3, 10), (4, 10), (5, 10)] and got["n_hit"] == 12


def test_odd_rows_and_dropping(spark, odd, odd_rows, folder):
    items = [(1, odd_rows[3][1])]
    docs = [(r[0], r[1]) for r in odd_rows]
    got = decontam.contamination(odd, spark.createDataFrame(items, "item_id long, text string"), folder).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=repr) == direct(docs, items)
    frame = odd.withColumn("_id", F.lit(1)).withColumn("n_hit", F.lit("mine"))
    kept = decontam.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), f"{folder}-b")
    clean = sorted((d for d, t in docs if not direct([(d, t)], items)[0][2]), key=repr)
    assert kept.columns == frame.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == clean


def test_empty_tables(spark, odd, none, folder):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.contamination(odd, no_items, folder).where("contaminated OR n_items > 0").count()
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontam.contamination(none, items, f"{folder}-b").count() == 0


def test_sliding_minimum(spark):
    rng = random.Random(6)
    for w in range(1, 9):
        values = [rng.randrange(100) for _ in range(20)]
        frame = spark.createDataFrame([(values,)], "v array<bigint>")
        got = frame.select(F.slice(decontam.sliding_min(F.col("v"), w), 1, 21 - w)).first()[0]
        assert got == [min(values[i : i + w]) for i in range(21 - w)]
