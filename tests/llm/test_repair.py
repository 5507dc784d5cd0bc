"""Least repairs, against a plain forward search over whole conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eraflow.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """Least (cost, audit) over (state, role, text) of turns with faults; forward."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(paths):
        for _ in range(4):
            for state, (cost, audit, kept) in list(paths.items()):
                to = follows[state]
                new = (cost + 3, audit + "I", (*kept, (name[to], "")))
                if to not in paths or new[:2] < paths[to][:2]:
                    paths[to] = new
        return paths

    paths = inserted({"": (0, "", ())})
    for role, text, must, extra in rows:
        after = {}

        def offer(state, cost, audit, kept, after=after):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, kept)

        for state, (cost, audit, kept) in paths.items():
            offer(state, cost + 4, audit + "D", kept)
            if not must:
                to = follows[state]
                offer(to, cost + extra + 3, audit + "R", (*kept, (name[to], text)))
                first = role[:1]
                if first and (first == to or (first == "s" and state == "")):
                    offer(first, cost + extra, audit + "K", (*kept, (role, text)))
        paths = inserted(after)
    return min(paths[s] for s in ("", "a") if s in paths)


def direct(rows):
    convs = defaultdict(list)
    for row in harmed(rows):
        role, text = row[2:]
        mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        convs[row[0]].append(((row[1] is not None, row[1] or 0), mark, row))
    out = []
    for conv in {r[0] for r in rows}:
        turns = [t[2] for t in sorted(convs[conv], key=lambda t: t[:2])]
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, coded, n = set(), [], [0, 0, 0]
        for _, _, role, text in turns:
            said = text.rstrip(BLANK)
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            if fault is not None:
                n[fault] += 1
            seen.add((role, text))
            coded.append((role, text, fault in (0, 1), 3 if fault == 2 else 0))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, kept = plain(coded)
        lines = "\n".join(f"{role}:{text}" for role, text in kept)
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def found(spark, rows, folder, chunk_turns=4):
    frame = spark.createDataFrame(rows, SCHEMA)
    whole, cut = repair.repair(repair.damaged(frame), folder, chunk_turns)
    got = repair.summaries(frame, whole, cut, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


CODES = st.lists(st.integers(0, repair.GONE), max_size=14)


@settings(max_examples=500, deadline=None)
@given(CODES)
def test_trace_is_the_least_audit(codes):
    vectors = repair.backward(codes, repair.END)
    letters, state, cost = repair.trace(codes, vectors, 0)
    tail = ""
    while repair.END[state]:
        tail, state, cost = tail + "I", repair.AFTER[state], cost + 3
    rows = [("suax"[min(c, 7) >> 1], "t", c == repair.GONE, 3 * (c & 1)) for c in codes]
    assert (cost, "".join(letters) + tail) == plain(rows)[:2]


@settings(max_examples=300, deadline=None)
@given(CODES, CODES)
def test_transfer_matrices_give_the_vectors(left, right):
    flat = [[c for row in repair.transfer(codes) for c in row] for codes in (left, right)]
    both = repair.product(*flat)
    ends = [min(both[4 * q + p] + repair.END[p] for p in range(4)) for q in range(4)]
    assert repair.normal(ends)[0] == repair.backward(left + right, repair.END)[0]


def talks(rng, n, longest):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Half a", "", " ", None, f"Word {t}.", f"Word {t}"])
            rows.append((c, t + rng.randrange(2) * 3 if rng.random() < 0.95 else None, role, text))
    rng.shuffle(rows)
    return rows


def test_short_and_cut_conversations(spark, folder):
    rows = talks(random.Random(1), 120, 9)
    assert found(spark, rows, folder) == direct(rows)


def test_long_conversations(spark, folder):
    rng = random.Random(2)
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}{rng.choice('.!?x')}") for t in range(400)]
    rows += [(2, t, "tool", f"Turn {t}.") for t in range(150)]  # keeps differences of vectors alive
    rows += [(3, t, "user", "Same.") for t in range(90)]  # all but one must go
    rows += [(4, t, "system", f"Turn {t}") for t in range(101)]
    assert found(spark, rows, folder) == direct(rows)


def test_open_chunks_are_settled_without_passes(spark, folder, monkeypatch):
    monkeypatch.setattr(repair.solve_vectors, "__defaults__", (0,))
    rows = talks(random.Random(3), 12, 60)
    assert found(spark, rows, folder, 5) == direct(rows)


def test_odd_rows(spark, folder):
    rows = [
        (None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (5, None, None, None), (6, 1, "usher", "Fine."), (6, 1, "usher", "Fine."),
        (6, 2, "assistant", "x" * 400_000 + "."), (7, -5, "user", "Hi.\t\x0b "), (7, 90, "assistant", "Yes. "), (8, 1, "", "Hm."),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("mark", "initial", "fault", "conv_key", "ord", "audit", "copies", "col")})
    whole, cut = repair.repair(repair.damaged(frame), folder)
    got = sorted(map(tuple, repair.summaries(frame, whole, cut, folder).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == direct(rows)


def test_turn_numbers_at_the_ends_of_long(spark, folder):
    rows = [(9, -(1 << 63), "user", "Hi."), (9, (1 << 63) - 1, "assistant", "Yes.")]
    got = found(spark, rows, folder)
    assert len(got) == 1 and got[0][1] in (None, 0)


def test_empty_table(spark, folder):
    assert found(spark, [], folder) == []


@pytest.mark.parametrize("size", [1, 1024])
def test_pieces_hold_the_repaired_turns(spark, folder, size):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(6)]
    whole, cut = repair.repair(spark.createDataFrame(rows, SCHEMA), folder, size)
    pieces = sorted(whole.unionByName(cut).collect(), key=lambda p: p["ord"])
    assert [(t["role"], t["text"]) for p in pieces for t in p["repaired"]] == [r[2:] for r in rows]
