"""The template tree, against a direct reading of its rules."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, letters, words

import eraflow.llm.common as common
from eraflow.llm import templates as t


def tokens(line):
    parts = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    return tuple("<*>" if re.search("[0-9]", x) else x for x in parts)


def direct(docs):
    lines = []
    for doc, text in set(docs):
        if text is not None:
            lines += [(doc, i, tokens(x)) for i, x in enumerate(text.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= t.MIN_TOKENS]
    bad = set()

    def sweep(groups):
        found = set()
        for key, members in groups.items():
            if len({m[0] for m in members}) >= t.MIN_DOCS:
                found.add(key)
                bad.update(sorted((m[0], m[1]) for m in members)[1:])
        return found

    exact = defaultdict(list)
    for x in lines:
        exact[x[2]].append(x)
    known = sweep(exact)
    leaves = defaultdict(list)
    for x in lines:
        if x[2] not in known:
            leaves[len(x[2]), x[2][: t.DEPTH]].append(x)
    near = defaultdict(list)
    for key, members in leaves.items():
        if len({m[0] for m in members}) < t.MIN_DOCS:
            continue
        constants = []
        for place in range(key[0]):
            token, n = Counter(m[2][place] for m in members).most_common(1)[0]
            constants.append(token if 2 * n > len(members) else None)
        near[key] = [m for m in members if 10 * sum(a == b for a, b in zip(m[2], constants, strict=True)) >= t.SIMILAR * key[0]]
    sweep(near)
    out = []
    for doc, text in docs:
        parts = (text or "").split("\n")
        kept = [x for i, x in enumerate(parts) if (doc, i) not in bad]
        out.append((doc, None if text is None else "\n".join(kept), 0 if text is None else len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def run(spark, docs, folder):
    frame = spark.createDataFrame([(i, x, "en", "a", 0) for i, x in docs], SCHEMA).repartition(3)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in t.drop_recurring(frame, folder).collect()), key=repr)


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_against_direct_reading(spark, folder, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(12)
    long = letters(words(rng, 70))
    docs = []
    for i in range(40):
        lines = [letters(words(rng, rng.randrange(3, 20), 15)) for _ in range(6)]
        lines.append(f"Copyright {1990 + i % 9} by the authors of page {i}, all rights reserved")
        lines.append(f"user {'anna' if i % 3 else 'bert'} logged in from {'home' if i % 2 else 'work'} at night")
        if i % 5 == 0:
            lines.append(long)
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, docs[0][1]), (53, docs[0][1]), (54, long + "\n" + long)]
    assert run(spark, docs, folder) == direct(docs)


def test_long_passages_that_recur_go_and_others_stay(spark, folder):
    rng = random.Random(13)
    passage = words(rng, 60)
    docs = [(i, letters(words(rng, 50, 10**6) + "\n" + (passage if i < 20 else words(rng, 60, 10**6)))) for i in range(60)]
    got = {r[0]: r[3] for r in run(spark, docs, folder)}
    assert sorted(i for i in got if got[i]) == list(range(1, 20))


def test_odd_rows(spark, odd, odd_rows, folder):
    frame = odd.withColumn("n_lines", F.lit("mine")).withColumn("line", F.lit(0)).withColumn("leaf", F.lit(0))
    out = t.drop_recurring(frame, folder)
    assert out.columns == [c for c in frame.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert len(out.collect()) == len(odd_rows)
    base = odd_rows[3][1]
    assert sum(x[1] == base for x in got) == 1 and (1, None) in got and (2, "") in got and (11, "x" * 3_000_000) in got


def test_tokens_with_digits_are_variables(spark):
    line = "  a1 b\tC3PO x9y9 --- 12 \x0b ünï7 end " + "z" * 200_000
    got = spark.createDataFrame([(line,)], "l string").select(t.tokens_of(F.col("l"))).first()[0]
    assert tuple(got) == tokens(line)


def test_empty_table(spark, none, folder):
    assert t.drop_recurring(none, folder).count() == 0
