"""Near-duplicates, against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, words

import eraflow.llm.common as common
from eraflow.llm import components, neardup, shingles


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def direct(docs):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def run(spark, docs, folder):
    frame = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], SCHEMA).repartition(4)
    got = neardup.cluster(frame, folder).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def changed(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
    return " ".join(w)


def corpus(rng):
    docs = []
    for _ in range(12):  # groups of copies, each a little changed
        base = words(rng, rng.choice([6, 30, 80, 200]), 5000)
        docs += [base, base.upper(), *(changed(rng, base, s) for s in (0.004, 0.01, 0.02, 0.03, 0.05, 0.1))]
    chain = words(rng, 100, 5000).split()  # neighbours are similar, ends are not
    for _ in range(12):
        docs.append(" ".join(chain))
        chain = chain[8:] + words(rng, 8, 5000).split()
    passage = words(rng, 60, 5000)  # shared by texts that are not similar enough
    docs += [passage + " " + words(rng, n, 5000) for n in (30, 40, 50, 60) for _ in range(12)]
    docs += [None, "", "  ", "one", "one", "one two three four", "One two three FOUR", "one two three four five"]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("limit", [0])
def test_against_all_pairs(spark, folder, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    docs = corpus(random.Random(7))
    assert run(spark, docs, folder) == direct(docs)


@pytest.mark.parametrize("share,block", [(0.0, 1024), (2.0, 3)])  # rounds until nothing joins; the last step soon
def test_open_buckets_are_settled(spark, folder, monkeypatch, share, block):
    monkeypatch.setattr(neardup, "FAIR_SHARE", share)
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = corpus(random.Random(8))
    assert run(spark, docs, folder) == direct(docs)


def test_group_whose_smallest_node_is_far_from_most(spark, folder):
    rng = random.Random(20)
    base = words(rng, 120, 10**6)
    docs = [(i, changed(rng, base, 0.035)) for i in range(150)]
    assert run(spark, docs, folder) == direct(docs)


def test_pairs_are_screened_once():
    rng = random.Random(21)
    base = words(rng, 200, 10**6)
    sets = [shingles.shingle_set(changed(rng, base, 0.005)) for _ in range(8)]
    marks = np.array([neardup.minhashes(s) for s in sets])
    side = {
        "component": np.arange(8), "size": np.array([len(s) for s in sets]), "marks": np.ascontiguousarray(marks.T),
        "sketch": np.array([np.frombuffer(neardup.sketch(s), np.uint8) for s in sets]),
    }
    seen = {}
    for own in range(neardup.SIDE):
        for i, j in zip(*neardup._screen(side, side, own, 75), strict=True):
            if i < j:
                seen[i, j] = seen.get((i, j), 0) + 1
    assert len(seen) == 28 and set(seen.values()) == {1}


def test_keys_carry_their_table():
    keys = neardup.table_keys(np.arange(2 * neardup.HASHES, dtype=np.int32).reshape(2, -1)).view(np.uint64)
    assert (keys & neardup._TABLE_BITS == np.arange(neardup.SIDE**2)).all() and len(np.unique(keys)) == keys.size


def test_odd_rows(spark, odd, odd_rows, folder):
    got = neardup.cluster(odd.withColumn("node", F.lit("x")).withColumn("set_hash", F.lit("y")), folder).collect()
    want = direct([(r[0], r[1]) for r in odd_rows])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def test_one_of_each_group_stays(spark, odd, folder):
    frame = odd.withColumn("component", F.lit("mine"))
    kept = neardup.keep_one(frame, folder)
    got = sorted(((r["doc_id"], len(r["text"] or "")) for r in kept.collect()), key=repr)
    assert kept.columns == frame.columns
    texts = [g for g in got if g[0] in (4, 5, 6)]
    assert len(texts) == 1 and texts[0][0] == 4
    assert {g[0] for g in got} == {1, 2, 3, 4, 7, 8, 9, 10, 11, None} and sum(g[0] == 7 for g in got) == 2


def test_empty_table(spark, none, folder):
    assert neardup.cluster(none, folder).count() == 0
    assert neardup.keep_one(none, f"{folder}-b").count() == 0


def test_components_against_search(spark, folder):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    links += [(500, i) for i in range(501, 560)] + [(3, 3)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in want:
                want[n] = want.get(start, start)
                stack += near[n]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(frame, folder).collect()}
    assert got == {n: c for n, c in want.items() if near[n] != {n}}
    assert components.components(frame.where("a < 0"), f"{folder}-b").count() == 0


def test_hashes_follow_the_words():
    for text in ("a b c", " a\tb\nc ", "A B C", "ä ö ü", "x" * 5000, "a " * 1000):
        assert len(shingles.word_hashes(text)) == len(text.split())
    same = shingles.word_hashes("the The THE the")
    assert len(set(same.tolist())) == 1
    assert len(set(shingles.word_hashes("the The", fold=False).tolist())) == 2
    assert len(set(shingles.word_hashes("ab ba aab abb b a").tolist())) == 6


def test_pieces_do_not_change_the_hashes(monkeypatch):
    rng = random.Random(10)
    text = words(rng, 3000) + " " + "y" * 5000 + " " + words(rng, 100)
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert np.array_equal(shingles.word_hashes(text), whole)


def test_set_sizes(spark):
    for text in ("", "a", "a b c d e f", "a b c d e a b c d e f"):
        assert len(shingles.shingle_set(text)) == len(plain_set(text))


def test_share_of_equal_minhashes_estimates_similarity():
    rng = random.Random(11)
    base = words(rng, 400, 10**6)
    other = " ".join(base.split()[:300]) + " " + words(rng, 100, 10**6)
    a, b = shingles.shingle_set(base), shingles.shingle_set(other)
    share = np.mean([neardup.minhashes(a) == neardup.minhashes(b)])
    assert abs(share - 296 / 496) < 0.25


def test_nothing_that_is_not_measured_is_broadcast(spark, folder, monkeypatch):
    """Spark takes every table of this test for small, so it would send all of them through
    the driver; at sizes where it is wrong that is gigabytes."""
    plans = {}

    def planned(df, path):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        return common.store(df, path)

    for module in (neardup, components):
        monkeypatch.setattr(module, "store", planned)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = [(i, t, "en", "a", 0) for i, t in corpus(random.Random(3))]
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    planned(kept, f"{folder}/kept")
    assert {"members", "pairs-0", "places", "texts", "links", "members-1", "screened", "clusters", "dropped", "twice"} <= set(plans)
    assert not [path for path, plan in plans.items() if "Broadcast" in plan]
