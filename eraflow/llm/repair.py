"""Repair of the turns of conversations at least cost.

A repaired conversation's roles read ``(s?(ua)+)?`` (first letters). Its turns are edited
in order: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or
assistant turn 3; blank and repeated turns must go, and a truncated turn that stays costs
3 more. What an edited prefix lets follow is one of four states (nothing yet, after
system, after user, after assistant), so an audit, the edits' initials in order, says all.

Rank-convergence parallel Viterbi: the cost to the end from each state is a vector of
four, carried from the last turn to the first in min-plus steps. Conversations are cut
into chunks (``turns``). A chunk that is not the last starts from a speculative vector;
fix-up passes give each chunk the vector its successor came out with, and only those
whose vector differs by more than a constant run again, until none does. Chunks that a
few passes leave open (turns that delete or rerole alike from every state keep
differences alive) are settled by products of their 4 x 4 transfer matrices, doubling the
span, so the passes never number the chunks. The stitched vectors then drive the trace:
at each state the least letter that loses nothing, D before I before K before R, which is
the ASCII-least audit of least cost. A chunk's trace maps four entry states to exit
states; spans of maps are composed, doubling, until each chunk knows its entry state.

Nulls in role and text are one space (so a null text is blank); a null conv_id is a
conversation of its own; null turns come first. Different turns with one number stand in
the order of a hash of role and text. A role whose first letter is not s, u or a (or that
is empty) can only be reroled or deleted. Repeated rows are repeated turns. A conversation
without turns costs nothing. An empty table gives an empty table. A task holds one Arrow
batch of turns, however long a conversation is; its audit is one string by contract, its
hash is streamed in order. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.functions.running import running_totals
from eraflow.llm.common import broadcast_if_small, store
from eraflow.llm.turns import BLANKS, CHUNK_TURNS, chunked, conversation_key, cut_conversations, split_off, turn_mark

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Passes from speculative vectors before open chunks are settled by matrix products.
FIX_UP_PASSES = 4
FAR = 1 << 40

# Codes of a turn: 2 * place of its initial in INITIALS + (1 if truncated); GONE must go.
INITIALS, GONE = "suax", 8
# Per state the state after the user or assistant turn that may follow, and what is kept.
AFTER = (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
# Cost from each state when nothing follows.
END = (0, 6, 3, 0)

Vector = tuple[int, ...]


def _closed(costs: list[int]) -> list[int]:
    """With inserted turns before."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[AFTER[q]]) for q, c in enumerate(costs)]
    return costs


def _before(code: int, after: Sequence[int]) -> list[int]:
    """Costs from each state before a turn, given those after it."""
    costs = [DELETE + c for c in after]
    if code != GONE:
        extra, kept = TRUNCATED * (code & 1), KEPT[code >> 1]
        for q in range(4):
            costs[q] = min(costs[q], extra + REROLE + after[AFTER[q]])
            if q in kept:
                costs[q] = min(costs[q], extra + KEEP + after[kept[q]])
    return _closed(costs)


def normal(vector: Sequence[int]) -> tuple[Vector, int]:
    """A vector up to a constant, and the constant."""
    least = min(vector)
    return tuple(c - least for c in vector), least


@cache
def step(code: int, after: Vector) -> tuple[Vector, int]:
    """The normal vector before a turn, and the constant taken off."""
    return normal(_before(code, after))


@cache
def edit(code: int, state: int, after: Vector) -> tuple[str, int, int]:
    """Letters of the least edits at a turn, the state they lead to, and their cost."""
    costs, letters, spent = _before(code, after), "", 0
    while True:
        left = costs[state]
        if left == DELETE + after[state]:
            return letters + "D", state, spent + DELETE
        if left == INSERT + costs[AFTER[state]]:
            letters, state, spent = letters + "I", AFTER[state], spent + INSERT
            continue
        extra = TRUNCATED * (code & 1)
        to = KEPT[code >> 1].get(state)
        if to is not None and left == extra + KEEP + after[to]:
            return letters + "K", to, spent + extra + KEEP
        return letters + "R", AFTER[state], spent + extra + REROLE


def backward(codes: Sequence[int], end: Vector) -> list[Vector]:
    """Normal vectors before each turn and after the last."""
    vectors = [end]
    for code in reversed(codes):
        vectors.append(step(code, vectors[-1])[0])
    vectors.reverse()
    return vectors


def transfer(codes: Sequence[int]) -> list[list[int]]:
    """Costs from each state before a chunk (rows) to each after it (columns)."""
    columns = []
    for q in range(4):
        costs = _closed([0 if p == q else FAR for p in range(4)])
        for code in reversed(codes):
            costs = _before(code, costs)
        columns.append(costs)
    return [[columns[p][q] for p in range(4)] for q in range(4)]


def product(left: Sequence[int], right: Sequence[int]) -> list[int]:
    """Min-plus product of two 4 x 4 matrices, flat, up to a constant."""
    costs = [min(left[4 * q + k] + right[4 * k + p] for k in range(4)) for q in range(4) for p in range(4)]
    least = min(costs)
    return [min(c - least, FAR) for c in costs]


def trace(codes: Sequence[int], vectors: Sequence[Vector], state: int) -> tuple[list[str], int, int]:
    """Letters per turn, the state at the end, the cost."""
    letters, cost = [], 0
    for code, after in zip(codes, vectors[1:], strict=True):
        done, state, spent = edit(code, state, after)
        letters.append(done)
        cost += spent
    return letters, state, cost


def exits(codes: Sequence[int], vectors: Sequence[Vector]) -> list[int]:
    """The exit state for each entry state."""
    states = [0, 1, 2, 3]
    for code, after in zip(codes, vectors[1:], strict=True):
        states = [edit(code, q, after)[1] for q in states]
    return states


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with the contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(kind == 4, "user").otherwise(told("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def _prepared(turns: DataFrame) -> DataFrame:
    """Turns with key, mark, initial (place in INITIALS) and own fault (b, t or none)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    said = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(said == "", "b").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.select(
        conversation_key(F.col("conv_id")).alias("conv_key"), "conv_id", "turn", "role", "text",
        turn_mark(F.col("role"), F.col("text")).alias("mark"),
        place.cast("tinyint").alias("initial"), fault.alias("fault"),
    )


PIECE = (
    "conv_key string, conv_id {}, ord long, turn array<{}>, audit string, repaired array<struct<role: string, text: string>>, "
    "n_blank long, n_duplicate long, n_truncated long, n_illegal long, cost long, "
    "first_initial int, last_initial int"
)
_NAMES = {2: "user", 3: "assistant"}


def turn_codes(initials: Sequence[int], faults: Sequence[str], repeated: Sequence[bool]) -> list[int]:
    return [
        GONE if fault == "b" or again else 2 * initial + (fault == "t")
        for initial, fault, again in zip(initials, faults, repeated, strict=True)
    ]


def _legal(left: int, right: int) -> bool:
    return INITIALS[left] + INITIALS[right] in ("su", "ua", "au")


def _pieces(kinds: tuple[str, str], solved: bool):
    """The task function that edits chunks. ``solved`` chunks come with ``first`` (places
    of turns that are first of their kind), ``after`` (costs behind them), ``state`` and
    ``last``; others are whole conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["initial", "fault", "role", "text", *(["first", "after", "state", "last"] if solved else ["mark"])]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("audit", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost", "first_initial", "last_initial")}
            roles, texts, offsets = [], [], [0]
            for initials, faults, role, text, *more in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if solved:
                    first, after, state, last = set(more[0] or ()), tuple(more[1]), more[2], more[3]
                    repeated = [i not in first for i in range(len(initials))]
                else:
                    seen: set[bytes] = set()
                    repeated = [mark in seen or seen.add(mark) is not None for mark in more[0]]
                    after, state, last = END, 0, True
                codes = turn_codes(initials, faults, repeated)
                edits, end, cost = trace(codes, backward(codes, after), state)
                tail = ""
                while last and END[end]:
                    tail, end, cost = tail + "I", AFTER[end], cost + INSERT
                for letters, said_role, said in zip([*edits, *tail], [*role, *([""] * len(tail))], [*text, *([""] * len(tail))], strict=True):
                    for letter in letters:
                        if letter == "K":
                            state = KEPT["suax".index(said_role[0])][state]
                            roles.append(said_role)
                            texts.append(said)
                        elif letter != "D":
                            state = AFTER[state]
                            roles.append(_NAMES[state])
                            texts.append(said if letter == "R" else "")
                offsets.append(len(roles))
                blank = sum(f == "b" for f in faults)
                twice = sum(again and f != "b" for f, again in zip(faults, repeated, strict=True))
                short = sum(f == "t" and not again for f, again in zip(faults, repeated, strict=True))
                wrong = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
                row = ("".join(edits) + tail, blank, twice, short, wrong, cost, initials[0], initials[-1])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            flat = pa.StructArray.from_arrays([pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["role", "text"])
            repaired = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            numbers = [pa.array(v, pa.int32() if c.endswith("initial") else pa.int64()) for c, v in out.items() if c != "audit"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_key", "conv_id", "ord", "turn")], pa.array(out["audit"], pa.string()), repaired, *numbers],
                ["conv_key", "conv_id", "ord", "turn", "audit", "repaired", *[c for c in out if c != "audit"]],
            )

    return run, PIECE.format(*kinds)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the normal vector a chunk comes out with."""
    for batch in batches:
        out = [
            list(backward(codes, tuple(after))[0])
            for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "before"])


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = []
        for codes in batch.column("codes").to_pylist():
            costs = [c for row in transfer(codes) for c in row]
            flat.append([min(c - min(costs), FAR) for c in costs])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_key"), batch.column("number"), pa.array(flat, pa.list_(pa.int64()))], ["conv_key", "number", "span"]
        )


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, nexts = batch.column("span").to_pylist(), batch.column("next_span").to_pylist()
        done = [left if right is None else product(left, right) for left, right in zip(spans, nexts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_key"), batch.column("number"), pa.array(done, pa.list_(pa.int64()))], ["conv_key", "number", "span"]
        )


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [
            exits(codes, backward(codes, tuple(after)))
            for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_key"), batch.column("number"), pa.array(maps, pa.list_(pa.int32()))], ["conv_key", "number", "leads"]
        )


def shifted(df: DataFrame, by: int, **names: str) -> DataFrame:
    """(conv_key, number, columns renamed) of the chunk ``by`` places on."""
    return df.select("conv_key", (F.col("number") - by).alias("number"), *[F.col(old).alias(new) for old, new in names.items()])


KEYS = ["conv_key", "number"]


def solve_vectors(chunks: DataFrame, folder: str, passes: int = FIX_UP_PASSES) -> DataFrame:
    """``chunks`` (conv_key, number, last, codes and others) with ``after``, the costs
    behind each up to a constant: speculative starts, fix-up passes, products."""
    end = F.array(*[F.lit(c).cast("bigint") for c in END])
    columns = chunks.columns
    schema = ", ".join(f"{n} {k}" for n, k in [*chunks.dtypes, ("after", "array<bigint>"), ("before", "array<bigint>")])
    now = store(chunks.withColumn("after", end).mapInArrow(_vectors, schema), f"{folder}/vectors-0")
    for k in range(1, passes + 1):
        given = F.coalesce(F.col("given"), end)  # the last chunk has no successor
        told = now.join(shifted(now, 1, before="given"), KEYS, "left").withColumn("given", given)
        open_ = told.where("given <> after")
        if open_.isEmpty():
            return now.drop("before")
        again = open_.select(*columns, F.col("given").alias("after")).mapInArrow(_vectors, schema)
        now = store(told.where("given = after").select(*now.columns).unionByName(again), f"{folder}/vectors-{k}")
    told = now.join(shifted(now, 1, before="given"), KEYS, "left")
    if told.where(F.coalesce("given", end) != F.col("after")).isEmpty():
        return now.drop("before")
    kinds = "conv_key string, number long, span array<bigint>"
    spans = store(chunks.mapInArrow(_transfers, kinds), f"{folder}/spans-0")
    most, reach = chunks.agg(F.max("number")).first()[0] + 1, 1
    while reach < most:
        joined = spans.join(shifted(spans, reach, span="next_span"), KEYS, "left")
        spans = store(joined.mapInArrow(_products, kinds), f"{folder}/spans-{reach}")
        reach *= 2
    rows = [F.array_min(F.array(*[F.col("span")[4 * q + p] + END[p] for p in range(4)])) for q in range(4)]
    before = spans.select(*KEYS, F.array(*rows).alias("raw"))
    before = before.select(*KEYS, F.transform("raw", lambda c: c - F.array_min("raw")).alias("before"))
    return chunks.join(shifted(before, 1, before="after"), KEYS, "left").withColumn("after", F.coalesce("after", end))


def solve_states(chunks: DataFrame, folder: str) -> DataFrame:
    """(conv_key, number, state): the state each chunk is entered in."""
    kinds = "conv_key string, number long, leads array<int>"
    leads = chunks.select("conv_key", "number", "codes", "after").mapInArrow(_exits, kinds)
    # What led to a chunk: its predecessor's map; before the first, all is state 0.
    start = F.array(*[F.lit(0)] * 4)
    led = chunks.select(*KEYS).join(shifted(leads, -1, leads="leads"), KEYS, "left")
    led, reach = store(led.withColumn("leads", F.coalesce("leads", start)), f"{folder}/states-0"), 1
    while not led.where(F.size(F.array_distinct("leads")) > 1).isEmpty():
        joined = led.join(shifted(led, -reach, leads="earlier"), KEYS, "left")
        both = F.coalesce(F.transform("earlier", lambda q: F.get(F.col("leads"), q)), F.col("leads"))
        led, reach = store(joined.select(*KEYS, both.alias("leads")), f"{folder}/states-{reach}"), 2 * reach
    return led.select(*KEYS, F.col("leads")[0].alias("state"))


def repair(turns: DataFrame, folder: str, chunk_turns: int = CHUNK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(whole, cut) pieces of repaired conversations, of those in one chunk and of the
    others: conv_key, conv_id, ord, the audit's letters, the ``repaired`` turns (role,
    text), counts of faults, cost, ``first_initial`` and ``last_initial``. Pieces of a
    conversation follow each other by ``ord``; ``turn`` has the numbers of a piece's turns."""
    rows = _prepared(turns)
    chunks = chunked(rows, ["role", "text", "initial", "fault"], f"{folder}/chunks", chunk_turns)
    keys = cut_conversations(chunks, f"{folder}/cut")
    alone, parts = split_off(chunks, keys)
    kinds = tuple(dict(turns.dtypes)[c] for c in ("conv_id", "turn"))
    whole = alone.mapInArrow(*_pieces(kinds, False))
    small = parts.select("conv_key", "ord", "initial", "fault", "mark")
    places = small.select("conv_key", "ord", F.posexplode("mark").alias("place", "mark"))
    firsts = places.groupBy("conv_key", "mark").agg(F.min(F.struct("ord", "place")).alias("at"))
    firsts = firsts.groupBy(F.col("at.ord").alias("ord")).agg(F.collect_list("at.place").alias("first"))
    numbers = running_totals(small.select("conv_key", "ord", F.lit(1).alias("one")), ["conv_key"], "ord", {"number": "one"})
    numbered = numbers.join(broadcast_if_small(keys), "conv_key").select(
        "conv_key", "ord", F.col("number").cast("bigint").alias("number"), (F.col("number") == F.col("n_chunks") - 1).alias("last")
    )
    places_of = F.arrays_zip(F.col("initial"), F.col("fault"))

    def code(turn: Column, i: Column) -> Column:
        must = (turn["fault"] == "b") | ~F.array_contains("first", i)
        return F.when(must, GONE).otherwise(turn["initial"].cast("int") * 2 + (turn["fault"] == "t").cast("int"))

    known = numbered.join(small, ["conv_key", "ord"]).join(firsts, "ord", "left")
    known = known.withColumn("first", F.coalesce("first", F.expr("CAST(array() AS ARRAY<INT>)")))
    coded = known.select("conv_key", "number", "ord", "last", "first", F.transform(places_of, code).alias("codes"))
    coded = store(coded, f"{folder}/codes")
    vectors = solve_vectors(coded, f"{folder}/solve")
    solved = vectors.join(solve_states(vectors, f"{folder}/solve"), KEYS)
    solved = store(solved.select("ord", "first", "after", "state", "last"), f"{folder}/solved")
    cut = parts.join(solved, "ord").mapInArrow(*_pieces(kinds, True))
    return whole, cut


COUNTS = ("blank", "duplicate", "truncated")
NO_TEXT = hashlib.sha256(b"").hexdigest()


def _lines(repaired: str) -> Column:
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose pieces follow each other."""
    key, digest, begun = None, None, False
    for batch in batches:
        keys, hashes = [], []
        for found, n, lines in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "n", "lines")), strict=True):
            if found != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest, begun = found, hashlib.sha256(), False
            if n:
                digest.update((("\n" if begun else "") + lines).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["conv_key", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["conv_key", "repaired_sha256"])


def _gaps(least: Column, most: Column, distinct: Column) -> Column:
    """Turn numbers missing between the ends; none without numbers, NULL beyond a long."""
    return F.when(distinct == 0, 0).otherwise(F.try_subtract(F.try_subtract(most, least), distinct - 1)).cast("bigint")


def summaries(conversations: DataFrame, whole: DataFrame, cut: DataFrame, folder: str) -> DataFrame:
    """Per conversation of ``conversations``: conv_id, gaps, faults by kind, illegal
    neighbours, cost, audit, hash of the repaired turns."""
    numbers = F.filter("turn", lambda t: t.isNotNull())
    alone = whole.select(
        "conv_key",
        _gaps(F.array_min(numbers), F.array_max(numbers), F.size(F.array_distinct(numbers)).cast("bigint")).alias("gaps"),
        *[F.col(f"n_{c}").alias(c) for c in COUNTS], F.col("n_illegal").alias("illegal"), "cost", "audit",
        F.sha2(_lines("repaired"), 256).alias("repaired_sha256"),
    )
    cut = store(cut, f"{folder}/pieces")
    ends = cut.select("conv_key", "ord", "first_initial", "last_initial", F.lit(0).alias("none"))
    ends = running_totals(ends, ["conv_key"], "ord", {"nothing": "none"}, next_as="next_ord")
    following = ends.select(F.col("ord").alias("next_ord"), F.col("first_initial").alias("next_initial"))
    pair = F.concat(*[F.substring(F.lit(INITIALS), F.col(c) + 1, F.lit(1)) for c in ("last_initial", "next_initial")])
    crossed = ends.join(following, "next_ord").groupBy("conv_key").agg(F.count_if(~pair.isin("su", "ua", "au")).alias("crossed"))
    turns = cut.select("conv_key", F.explode(F.array_distinct(numbers)).alias("turn")).groupBy("conv_key")
    turns = turns.agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("distinct"))
    hashes = (
        cut.select("conv_key", "ord", F.size("repaired").alias("n"), _lines("repaired").alias("lines"))
        .repartition("conv_key").sortWithinPartitions("conv_key", "ord")
        .mapInArrow(_streamed, "conv_key string, repaired_sha256 string")
    )
    sums = [F.sum(f"n_{c}").alias(c) for c in COUNTS] + [F.sum("n_illegal").alias("illegal"), F.sum("cost").alias("cost")]
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "audit"))), lambda p: p["audit"]), "")
    found = cut.groupBy("conv_key").agg(*sums, audits.alias("audit"))
    found = found.join(turns, "conv_key", "left").join(crossed, "conv_key", "left").join(hashes, "conv_key")
    several = found.select(
        "conv_key", _gaps(F.col("least"), F.col("most"), F.coalesce("distinct", F.lit(0).cast("bigint"))).alias("gaps"),
        *COUNTS, (F.col("illegal") + F.coalesce("crossed", F.lit(0))).alias("illegal"), "cost", "audit", "repaired_sha256",
    )
    every = conversations.select("conv_id", conversation_key(F.col("conv_id")).alias("conv_key")).distinct()
    rows = every.join(alone.unionByName(several), "conv_key", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*COUNTS, "illegal", "cost")]
    # A conversation that has turns has an audit; NULL gaps of such a one stay NULL.
    gaps = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("bigint").alias("gaps")
    return rows.select(
        "conv_id", gaps, *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256"),
    )
