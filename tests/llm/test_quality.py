"""Divergence rules: base counts and distances against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import SCHEMA, letters, words

from eraflow.llm import quality


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab#|éß日 \n\t\r\x0b"), max_size=60))
def test_base_counts(text):
    assert quality.measures(text.encode())[1] == base(text)


def test_divergence():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.25, 0.25, 0.5]])
    m = (p + q[2]) / 2
    want = sum(a * math.log2(a / b) for a, b in zip(p, m, strict=True) if a) / 2 + sum(a * math.log2(a / b) for a, b in zip(q[2], m, strict=True) if a) / 2
    assert np.allclose(quality.divergence(p, q), [0, 1, math.sqrt(want)])


def corpus(rng):
    good = [(i, letters(words(rng, rng.randrange(60, 200), 60).replace("w", "Ab")), "en", "a", 1) for i in range(60)]
    return good + [
        (100, " ".join(x + "###" for x in good[0][1].split()), "en", "a", 0), (101, good[1][1].upper().replace(" ", "!! "), "en", "a", 0),
        (102, "spam spam spam " * 40, "en", "a", 0), (103, "too short", "en", "a", 0), (104, None, "en", "a", 0), (105, "", None, "a", 0),
    ]


def test_references_count_every_word(spark):
    rows = corpus(random.Random(22))
    refs = quality.references(spark.createDataFrame(rows, SCHEMA).repartition(5))
    counts = Counter(w for _, t, lang, *_ in rows if lang for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    top = sorted(counts.values(), reverse=True)[: quality.COMMON]
    assert refs.langs == ["en"] and len(refs.words) == min(len(counts), quality.COMMON)
    assert np.allclose(sorted(refs.shares[0, :-1], reverse=True), np.array(top) / sum(counts.values()))
    assert np.allclose(refs.shares.sum(axis=1), 1) and np.allclose(refs.chars.sum(axis=1), 1)


def test_small_sums_held_give_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(random.Random(23)), SCHEMA)
    want = quality.references(frame)
    monkeypatch.setattr(quality, "HELD_WORDS", 10)
    got = quality.references(frame)
    assert np.array_equal(got.words, want.words) and np.allclose(got.shares, want.shares)


def test_verdicts(spark):
    frame = spark.createDataFrame(corpus(random.Random(24)), SCHEMA)
    got = {r["doc_id"]: r for r in quality.assess(frame, quality.references(frame)).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(100, 106))
    for r in got.values():
        assert [r[c] for c in quality.BASE] == base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert got[100]["char_distance"] > quality.MAX_CHARS and got[102]["char_distance"] is None


def spread(rng, size=10**6):
    """Prose: 36 of 100 words are common (40 of them), the others of ``size``."""
    return " ".join(f"c{rng.randrange(40)}" if rng.random() < 0.36 else f"w{rng.randrange(size)}" for _ in range(rng.randrange(120, 400)))


def test_texts_without_common_words_go(spark):
    rng = random.Random(25)
    good = [(i, letters(spread(rng)), "en", "a", 1) for i in range(300)]
    strange = [(1000 + i, letters(" ".join(f"v{rng.randrange(4000)}" for _ in range(n))), None, "a", 1) for i, n in enumerate((100, 150, 400, 3000))]
    frame = spark.createDataFrame(good + strange, SCHEMA)
    refs = quality.references(frame)
    assert 0.3 < 1 - refs.shares[0, -1] < 0.45
    got = {r["doc_id"]: r for r in quality.assess(frame, refs).collect()}
    assert all(got[i]["kept"] for i in range(300))
    for i, *_ in strange:
        r = got[i]
        assert not r["base_failed"] and r["char_distance"] <= quality.MAX_CHARS and r["word_distance"] <= quality.MAX_WORDS
        assert not r["kept"]


def test_languages_without_common_words_are_not_judged_by_them(spark):
    rng = random.Random(26)
    rows = [(i, letters(" ".join(f"w{rng.randrange(10**7)}" for _ in range(200))), "zz", "a", 1) for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert all(r["kept"] for r in quality.assess(frame, quality.references(frame)).collect())


def test_odd_rows(spark, odd, odd_rows, none):
    frame = odd.withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit("mine"))
    out = quality.assess(frame, quality.references(frame))
    assert out.columns[:5] == odd.columns and len(out.collect()) == len(odd_rows)
    for r in out.collect():
        assert [r[c] for c in quality.BASE] == base(r["text"])
    no_refs = quality.references(none)
    assert no_refs.langs == [] and quality.assess(none, no_refs).count() == 0
    for r in quality.assess(odd, no_refs).collect():
        assert r["kept"] == (not r["base_failed"])
