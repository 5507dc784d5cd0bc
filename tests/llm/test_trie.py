"""Prefix trie, against dictionaries of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eraflow.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), mark, role, text))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # the remainder has the sign of c
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def count_words(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return sum(1 for w in text.split(" ") if w)


def nodes_of(sequences, words):
    """Nodes of {conv: tuple of turns}, as the contract states them."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv in sorted(sequences):
        seq = tuple(sequences[conv])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
        ends[seq].append(conv)
    totals = {}
    for seq in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids[seq]]
        own = (len(members[seq]) - 1) * words(seq[-1]) if seq else 0
        totals[seq] = (own + sum(b[0] for b in below), sum(b[1] for b in below) or 1)
    return sorted(
        (m[0], len(seq), members[seq[:-1]][0] if seq else None, len(m), len(kids[seq]), totals[seq][1], totals[seq][0],
         hashlib.sha256(",".join(map(str, ends[seq])).encode()).hexdigest())
        for seq, m in members.items()
    )


def direct(rows):
    return nodes_of(rebuilt(rows), lambda turn: count_words(turn[1]))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def grown(parts):
    """Rows of the forests of ``parts`` (lists of (marks, conv)), merged one by one."""
    rows, unit = trie.Rows(), None
    for number, part in enumerate(parts):
        if part:
            table = pa.table({
                "group": pa.array([b""] * len(part), pa.binary()), "block": pa.array([0] * len(part), pa.int64()),
                "marks": pa.array([m for m, _ in part], pa.list_(pa.binary())), "conv_id": pa.array([c for _, c in part], pa.int64()),
                "words": pa.array([[m[0] for m in marks] for marks, _ in part], pa.list_(pa.int64())), "last": [True] * len(part),
                **{name: pa.array([0] * len(part), pa.int64()) for name in trie.TAILS},
            })
            new = trie.Forest(table, rows, number).build()
            unit = new if unit is None else trie.joined(unit, new, rows)
    trie.finished(unit, rows)
    got = [dict(zip(rows.columns, cells, strict=True)) for cells in zip(*rows.columns.values(), strict=True)]
    least = {r["key"]: r["conv_id"] for r in got if r["kind"] == "node" and r["key"]}
    packed = defaultdict(list)
    for r in got:
        if r["kind"] == "ends":
            packed[r["key"]].append((r["part"], r["place"], r["packed"]))
    out = []
    for r in got:
        if r["kind"] == "node":
            if r["parent_key"]:
                r["parent_conv_id"] = least[r["parent_key"]]
            if r["ends_sha256"] is None:
                r["ends_sha256"] = hashlib.sha256(",".join(p[2] for p in sorted(packed[r["key"]])).encode()).hexdigest()
            out.append(tuple(r[c] for c in COLUMNS))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=14), st.data())
def test_forests_of_partitions_merge_to_the_trie(sequences, data):
    marks = [[bytes([m] * 16) for m in seq] for seq in sequences]
    rows = sorted((m, c) for c, m in enumerate(marks))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=5)))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    assert grown(parts) == nodes_of(dict(enumerate(map(tuple, marks))), lambda mark: mark[0])


def test_neighbour_depths():
    marks = np.arange(8, dtype=np.uint64).reshape(-1, 2)[[0, 1, 0, 1, 2, 0, 3]]
    starts = np.array([0, 2, 5, 6, 7])  # (0 1) (0 1 2) (0) (3)
    assert trie.neighbour_depths(np.array([0, 0, 0, 1]), marks, starts).tolist() == [-1, 2, 1, -1]


@pytest.fixture()
def scattered(spark):
    """Partitions stay as they are dealt, so that boundaries cut nodes."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def found(spark, rows, folder, **sizes):
    got = trie.nodes(spark.createDataFrame(rows, SCHEMA), folder, **sizes)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def talks(rng, n, longest, kinds=2):
    """Conversations that share openings; many are equal, many say few things."""
    rows = []
    for c in range(n):
        for t in range(rng.randrange(longest) if rng.random() < 0.9 else 2 * longest):
            rows.append((c, t if rng.random() < 0.95 else None, ("user", "assistant")[t % 2], "say " * rng.randrange(1, kinds + 1)))
    return rows


def test_many_partitions(spark, folder, scattered):
    rows = talks(random.Random(5), 400, 6)
    assert found(spark, rows, folder) == sorted(direct(rows), key=lambda r: r[:2])


def test_long_conversations_in_blocks(spark, folder, scattered):
    rng = random.Random(6)
    rows = talks(rng, 120, 9, kinds=1)
    rows += [(c, t, "user", "x y" if t != 31 else f"z{c % 3}") for c in (200, 220, 240, 260) for t in range(50 + c % 7)]
    rng.shuffle(rows)
    want = sorted(direct(rows), key=lambda r: r[:2])
    assert found(spark, rows, folder, chunk_turns=3, block_turns=4) == want


def test_packed_ends_follow_each_other(spark, folder, scattered):
    rows = [(c, 0, "user", "the same") for c in range(3000)]
    assert found(spark, rows, folder) == sorted(direct(rows), key=lambda r: r[:2])


def test_odd_rows(spark, folder):
    rows = [
        (None, 0, "user", "nobody's"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 2, "user", " \t\n"),
        (1, 0, "user", "w " * 200_000), (2, 0, "user", "a"), (2, 0, "assistant", "b"), (2, 0, "", "c d"), (3, 5, "user", "e"),
        (-7, 1, "user", "e"), (60, 0, "user", "alone"), (77, 1, "user", "kept"), (40, 1, "user", "e"), (41, 9, "user", "gone"), (47, 9, "user", "gone"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("mark", "words", "conv_key", "ord", "block", "key", "kind", "h", "head")})
    got = sorted(map(tuple, trie.nodes(frame, folder).collect()), key=lambda r: r[:2])
    assert got == sorted((r for r in direct(rows)), key=lambda r: r[:2])


def test_empty_table(spark, folder):
    assert found(spark, [], folder) == []
