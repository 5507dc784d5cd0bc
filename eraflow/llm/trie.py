"""Prefix trie of conversations, from sorted neighbours.

Sorted by their turns, the conversations of a trie node stand side by side, and two
neighbours share as many turns as their longest common prefix (LCP). Each task takes one
range partition of the sorted table and joins neighbours with a union-find, the deepest
LCP edges first: every merge of components makes a branching node at the edge's depth (or
widens the one that is there), and the component that it closes below is final, with its
turns in between as nodes of one child.

What a neighbouring partition may still change are the nodes that hold the partition's
first or last row. A partition's forest is contracted to these two spines, one piece a
depth; everything else is written at once. Spines of adjacent partitions are merged along
the LCP of the rows at their boundary, some partitions a task and level after level, and
pieces that no boundary can reach any more are written. Nothing larger than a spine passes a
boundary.

Long conversations are cut into blocks of ``BLOCK_TURNS`` turns. A block's group are the
blocks of equal depth with equal blocks before; each group is a trie of its own, rooted in
the last node of the group above. The deeper blocks' tries are built first; their sums
are carried up by the smallest conversation of each group, which is counted once in every
node above.

Ends of a node (conversations that stop there) are hashed in ascending order; those of a
spine come in packed pieces that one task streams through.

A conversation opens with turns of c - c % 20, the remainder having the sign of c. Null
roles and texts are empty; rows without conv_id belong to no conversation; equal
turns stand in the order of a hash of role and text, so repeated rows are repeated turns.
Very long texts only pass a hash and a count of words. Conversations that end up without
turns are members of the root. An empty table gives no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraflow.functions.running import running_totals
from eraflow.llm.common import broadcast_if_small, store
from eraflow.llm.turns import CHUNK_TURNS, chunked, conversation_key, cut_conversations, split_off, turn_mark

# Turns of one block, ids of one packed piece, partitions merged by one task.
BLOCK_TURNS, PACKED_IDS, MERGED = 64, 8192, 32
# Contract: conversation c starts like c - c % FAMILY, for crc32(c) % HEADS turns.
FAMILY, HEADS = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()

ROW = {
    "kind": pa.string(), "block": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "part": pa.int64(), "place": pa.int64(),
    "packed": pa.string(), "unit": pa.binary(),
}
ROW_DDL = (
    "kind string, block long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, part long, place long, "
    "packed string, unit binary"
)


class Rows:
    """Result rows of a task, given out as batches."""

    def __init__(self):
        self.columns: dict[str, list] = {name: [] for name in ROW}

    def add(self, kind: str, **cells) -> int:
        for name, column in self.columns.items():
            column.append(cells.get(name))
        self.columns["kind"][-1] = kind
        return len(self.columns["kind"]) - 1

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(column, ROW[name]) for name, column in self.columns.items()]
        self.columns = {name: [] for name in ROW}
        return pa.RecordBatch.from_arrays(arrays, list(ROW))


class Piece:
    """What one partition knows of a node: members, and what is final below it."""

    __slots__ = ("n", "least", "kids", "leaves", "saved", "more", "ends", "words", "key")

    def __init__(self, n, least, words, key, kids=0, leaves=0, saved=0, more=False, ends=False):
        self.n, self.least, self.words, self.key = n, least, words, key
        self.kids, self.leaves, self.saved, self.more, self.ends = kids, leaves, saved, more, ends

    def __getstate__(self):
        return tuple(getattr(self, name) for name in self.__slots__)

    def __setstate__(self, state):
        for name, value in zip(self.__slots__, state, strict=True):
            setattr(self, name, value)

    def widen(self, other: Piece) -> None:
        self.n += other.n
        self.least = min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.more |= other.more
        self.ends |= other.ends


class Unit:
    """A run of partitions contracted to its spines: ``left`` and ``right`` have a piece a
    depth; up to depth ``full`` they are the same pieces, which hold every row."""

    def __init__(self, first, last, left, right, full, blocks):
        # first, last: (group, marks) of the outermost rows; blocks: their block numbers.
        self.first, self.last, self.left, self.right, self.full, self.blocks = first, last, left, right, full, blocks


def shared(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> int:
    """Common turns of two rows (group, marks), -1 in different groups."""
    if a[0] != b[0]:
        return -1
    n = min(len(a[1]), len(b[1])) // 16
    for k in range(n):
        if a[1][16 * k : 16 * k + 16] != b[1][16 * k : 16 * k + 16]:
            return k
    return n


def close(piece: Piece, depth: int, block: int, parent: Piece | None, rows: Rows) -> None:
    """Write a node no other partition can change, and tell its parent."""
    saved = piece.saved + (piece.n - 1) * piece.words
    leaves = piece.leaves if piece.kids or piece.more else 1
    rows.add(
        "node" if depth or not block else "root", block=block, depth=depth, conv_id=piece.least, n_convs=piece.n,
        n_children=piece.kids, n_leaves=leaves, saved_tokens=saved, ends_sha256=None if piece.ends else NO_ENDS,
        key=piece.key, parent_key=parent.key if parent else None,
    )
    if parent:
        parent.kids += 1
        parent.leaves += leaves
        parent.saved += saved


def _close_down(spine: list[Piece], above: int, block: int, rows: Rows) -> None:
    """Close a spine's pieces deeper than ``above``, the deepest first."""
    for depth in range(len(spine) - 1, above, -1):
        close(spine[depth], depth, block, spine[depth - 1] if depth else None, rows)


def joined(a: Unit, b: Unit, rows: Rows) -> Unit:
    """Two adjacent units as one; closes what lies between them."""
    common = shared(a.last, b.first)
    _close_down(a.right, max(common, a.full), a.blocks[1], rows)
    _close_down(b.left, max(common, b.full), b.blocks[0], rows)
    for depth in range(common + 1):
        a.right[depth].widen(b.left[depth])
        if depth <= b.full:
            b.right[depth] = a.right[depth]
    inner = max(a.full, b.full)
    _close_down(a.right[: common + 1], inner, a.blocks[1], rows)
    return Unit(a.first, b.last, a.left, b.right, min(a.full, b.full, common), (a.blocks[0], b.blocks[1]))


def finished(unit: Unit, rows: Rows) -> None:
    """Close the spines of the whole table."""
    _close_down(unit.right, unit.full, unit.blocks[1], rows)
    _close_down(unit.left, unit.full, unit.blocks[0], rows)
    _close_down(unit.left[: unit.full + 1], -1, unit.blocks[0], rows)


def neighbour_depths(group: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LCP of each row with the one before: -1 where the group changes (and at first)."""
    lengths = np.diff(starts)
    depths = np.zeros(len(lengths), np.int64)
    depths[:1] = -1
    depths[1:][group[1:] != group[:-1]] = -1
    at, k = np.flatnonzero(depths == 0), 0
    while len(at):
        at = at[np.minimum(lengths[at - 1], lengths[at]) > k]
        at = at[(marks[starts[at - 1] + k] == marks[starts[at] + k]).all(axis=1)]
        depths[at] += 1
        k += 1
    return depths


class Forest:
    """The trie of one partition's rows, by union-find over neighbours."""

    def __init__(self, table: pa.Table, rows: Rows, part: int):
        self.rows, self.part = rows, part
        self.n = table.num_rows
        self.group = table.column("group").combine_chunks()
        self.codes = self.group.dictionary_encode().indices.to_numpy()
        marks = table.column("marks").combine_chunks()
        flat = marks.flatten().cast(pa.binary())
        self.marks = np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, 2)
        self.starts = marks.offsets.to_numpy().astype(np.int64)
        self.starts = self.starts - self.starts[0]
        words = table.column("words").combine_chunks()
        self.words = words.flatten().to_numpy()
        self.block = table.column("block").to_numpy().tolist()
        self.conv = table.column("conv_id").to_numpy().tolist()
        self.last = table.column("last").to_pylist()
        self.tails = [table.column(c).to_numpy().tolist() for c in ("tail_children", "tail_leaves", "tail_saved")]
        lengths = np.diff(self.starts).tolist()
        # Nodes: one per row at its end; branching nodes follow.
        self.depth = list(lengths)
        self.low, self.high = list(range(self.n)), list(range(self.n))
        self.size, self.least = [1] * self.n, list(self.conv)
        more = [not last for last in self.last]
        self.more = more
        self.kids, self.leaves, self.saved = ([t if m else 0 for t, m in zip(tail, more, strict=True)] for tail in self.tails)
        self.end_low = [i if last else -1 for i, last in enumerate(self.last)]
        self.end_high = list(self.end_low)
        self.parent = [-1] * self.n
        self.same = list(range(self.n))  # nodes that were absorbed, to the one that did
        self.tops: list[tuple[int, int]] = []  # rows whose parent is a node not final yet

    def _real(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = self.same[self.same[node]]
            node = self.same[node]
        return node

    def _word(self, row: int, depth: int) -> int:
        return int(self.words[self.starts[row] + depth - 1])

    def _branch(self, depth: int) -> int:
        node = len(self.depth)
        for column, value in (
            (self.depth, depth), (self.low, self.n), (self.high, -1), (self.size, 0), (self.least, 1 << 63), (self.more, False),
            (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.end_low, -1), (self.end_high, -1), (self.parent, -1), (self.same, node),
        ):
            column.append(value)
        return node

    def _open(self, node: int) -> bool:
        """Whether the partition's first or last row is in the node."""
        return self.low[node] == 0 or self.high[node] == self.n - 1

    def _members(self, node: int, child: int) -> None:
        self.low[node], self.high[node] = min(self.low[node], self.low[child]), max(self.high[node], self.high[child])
        self.size[node] += self.size[child]
        self.least[node] = min(self.least[node], self.least[child])

    def _ends(self, node: int) -> str:
        if self.end_low[node] < 0:
            return NO_ENDS
        ids = self.conv[self.end_low[node] : self.end_high[node] + 1]
        return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    def _close(self, node: int, above: int) -> tuple[int, int]:
        """Write a final node and the unary ones over it, down from depth ``above`` + 1;
        leaves and saved tokens of the uppermost, which is the last row."""
        block, row, n, depth = self.block[self.low[node]], self.low[node], self.size[node], self.depth[node]
        leaves = self.leaves[node] if self.kids[node] or self.more[node] else 1
        saved, kids, ends = self.saved[node], self.kids[node], self._ends(node)
        for d in range(depth, above, -1):
            saved += (n - 1) * self._word(row, d) if d else 0
            self.rows.add(
                "node" if d or not block else "root", block=block, depth=d, conv_id=self.least[node],
                parent_conv_id=self.least[node] if d > above + 1 else None, n_convs=n, n_children=kids, n_leaves=leaves,
                saved_tokens=saved, ends_sha256=ends,
            )
            kids, ends = 1, NO_ENDS
        return leaves, saved

    def _adopt(self, node: int, child: int) -> None:
        self._members(node, child)
        self.parent[child] = node
        if not self._open(child):
            leaves, saved = self._close(child, self.depth[node])
            self.tops.append((len(self.rows.columns["kind"]) - 1, node))
            self.kids[node] += 1
            self.leaves[node] += leaves
            self.saved[node] += saved

    def _absorb(self, node: int, other: int) -> None:
        self._members(node, other)
        for column in (self.kids, self.leaves, self.saved):
            column[node] += column[other]
        self.more[node] |= self.more[other]
        if self.end_low[other] >= 0:
            low = self.end_low[node]
            self.end_low[node] = self.end_low[other] if low < 0 else min(low, self.end_low[other])
            self.end_high[node] = max(self.end_high[node], self.end_high[other])
        self.same[other] = node

    def build(self) -> Unit:
        """Join all neighbours, write what is final; the contracted rest."""
        depths = neighbour_depths(self.codes, self.marks, self.starts)
        leader, top = list(range(self.n)), list(range(self.n))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        edges = np.flatnonzero(depths >= 0)
        at = depths.tolist()
        for i in edges[np.argsort(-depths[edges], kind="stable")].tolist():
            a, b, d = find(i - 1), find(i), at[i]
            left, right = top[a], top[b]
            if self.depth[left] > d and self.depth[right] > d:
                node = self._branch(d)
                self._adopt(node, left)
                self._adopt(node, right)
            elif self.depth[left] > d:
                node = right
                self._adopt(node, left)
            elif self.depth[right] > d:
                node = left
                self._adopt(node, right)
            else:
                node = left
                self._absorb(left, right)
            leader[b], top[a] = a, node
        cuts = np.flatnonzero(depths < 0).tolist()
        for start in cuts:
            root = top[find(start)]
            if self.depth[root]:
                node = self._branch(0)
                self._adopt(node, root)
                root = node
            if not self._open(root):
                self._close(root, -1)
        unit = self._contracted(len(cuts) == 1, int(depths[1:].min()) if self.n > 1 else self.depth[0])
        for row, node in self.tops:
            node = self._real(node)
            if self._open(node):
                self.rows.columns["parent_key"][row] = self.spine_keys[node]
            else:
                self.rows.columns["parent_conv_id"][row] = self.least[node]
        return unit

    def _contracted(self, alone: bool, full: int) -> Unit:
        self.spine_keys: dict[int, bytes] = {}
        left = self._spine(0, {})
        right = self._spine(self.n - 1, {d: p for d, p in enumerate(left) if d <= full} if alone else {})
        edge = [(self.group[i].as_py(), self.marks[self.starts[i] : self.starts[i + 1]].tobytes()) for i in (0, self.n - 1)]
        return Unit(*edge, left, right, full if alone else -1, (self.block[0], self.block[-1]))

    def _spine(self, row: int, known: dict[int, Piece]) -> list[Piece]:
        """Pieces of the nodes over a row, by depth; ``known`` are pieces there already."""
        key = hashlib.md5(f"{self.block[row]}:".encode() + self.group[row].as_py()).digest()
        keys = [key]
        for mark in self.marks[self.starts[row] : self.starts[row + 1]]:
            keys.append(hashlib.md5(keys[-1] + mark.tobytes()).digest())
        pieces, node = {}, self._real(row)
        while node >= 0:
            over = self.parent[node]
            over = self._real(over) if over >= 0 else -1
            for d in range(self.depth[node], self.depth[over] if over >= 0 else -1, -1):
                if d in known:
                    pieces[d] = known[d]
                    continue
                words = self._word(row, d) if d else 0
                pieces[d] = Piece(self.size[node], self.least[node], words, keys[d])
            bottom = self.depth[node]
            self.spine_keys[node] = keys[bottom]
            if bottom not in known:
                self._fill(pieces[bottom], node)
            node = over
        return [pieces[d] for d in range(len(pieces))]

    def _fill(self, piece: Piece, node: int) -> None:
        piece.kids, piece.leaves, piece.saved, piece.more = self.kids[node], self.leaves[node], self.saved[node], self.more[node]
        if self.end_low[node] >= 0:
            piece.ends = True
            ids = self.conv[self.end_low[node] : self.end_high[node] + 1]
            for k in range(0, len(ids), PACKED_IDS):
                self.rows.add("ends", key=piece.key, part=self.part, place=k, packed=",".join(map(str, ids[k : k + PACKED_IDS])))


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one range partition."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        rows, part = Rows(), TaskContext.get().partitionId()
        unit = Forest(pa.Table.from_batches(held), rows, part).build()
        rows.add("unit", part=part, unit=pickle.dumps(unit))
        yield rows.batch()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of ``MERGED`` partitions as one, in their order."""
    rows, number, unit = Rows(), None, None
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("unit").to_pylist(), strict=True):
            new = pickle.loads(data)
            if part // MERGED == number:
                unit = joined(unit, new, rows)
            else:
                if unit is not None:
                    rows.add("unit", part=number, unit=pickle.dumps(unit))
                number, unit = part // MERGED, new
    if unit is not None:
        rows.add("unit", part=number, unit=pickle.dumps(unit))
    yield rows.batch()


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = Rows()
        for data in batch.column("unit").to_pylist():
            finished(pickle.loads(data), rows)
        yield rows.batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of packed ids that follow each other."""
    key, digest = None, None
    for batch in batches:
        keys, hashes = [], []
        for found, packed in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if found != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest = found, hashlib.sha256(packed.encode())
            else:
                digest.update(b"," + packed.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "found_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "found_sha256"])


def grow(blocks: DataFrame, folder: str) -> DataFrame:
    """Nodes of the tries of ``blocks`` (group, block, marks, words, last, conv_id and the
    tails): kind (``root`` for those that belong to the block above), block, depth in the
    block, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    order = ["block", "group", "marks", F.col("last").desc(), "conv_id"]
    ordered = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    made = [store(ordered.mapInArrow(_grown, ROW_DDL), f"{folder}/forests")]
    units, level = made[0].where("kind = 'unit'").select("part", "unit"), 0
    parts = units.agg(F.max("part")).first()[0]
    while parts:
        level += 1
        grouped = units.repartition(F.floor(F.col("part") / MERGED)).sortWithinPartitions("part")
        made.append(store(grouped.mapInArrow(_merged, ROW_DDL), f"{folder}/merged-{level}"))
        units, parts = made[-1].where("kind = 'unit'").select("part", "unit"), parts // MERGED
    made.append(store(units.mapInArrow(_finished, ROW_DDL), f"{folder}/finished"))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    nodes = rows.where("kind IN ('node', 'root')").drop("part", "place", "packed", "unit")
    spine = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_found"))
    packed = made[0].where("kind = 'ends'").select("key", "part", "place", "packed")
    hashes = packed.repartition("key").sortWithinPartitions("key", "part", "place").mapInArrow(_hashed, "key binary, found_sha256 string")
    hashes = store(hashes, f"{folder}/ends")
    nodes = nodes.join(broadcast_if_small(store(spine, f"{folder}/spine")), "parent_key", "left")
    nodes = nodes.join(broadcast_if_small(hashes), "key", "left")
    return nodes.withColumns({
        "parent_conv_id": F.coalesce("parent_conv_id", "parent_found"),
        "ends_sha256": F.coalesce("ends_sha256", "found_sha256"),
    }).drop("parent_key", "parent_found", "key", "found_sha256")


def rebuilt(conversations: DataFrame, folder: str, chunk_turns: int = CHUNK_TURNS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Blocks (conv_id, block, marks, words, last) of the rebuilt conversations: the first
    turns of conversation c - c % 20, then the own ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("bigint")
    rows = conversations.where("conv_id IS NOT NULL").select(
        conversation_key(conv).alias("conv_key"), conv.alias("conv_id"), "turn", turn_mark(role, text).alias("mark"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    chunks = chunked(rows, ["words"], f"{folder}/chunks", chunk_turns).drop("turn")
    alone, parts = split_off(chunks, cut_conversations(chunks, f"{folder}/cut"))
    sized = running_totals(parts.select("conv_key", "ord", F.size("mark").alias("n")), ["conv_key"], "ord", {"start": "n"})
    parts = parts.join(sized.select("ord", F.col("start").cast("bigint").alias("start")), "ord").select(
        "conv_id", "mark", "words", "start", F.lit(False).alias("alone")
    )
    alone = alone.select("conv_id", "mark", "words", F.lit(0).cast("bigint").alias("start"), F.lit(True).alias("alone"))
    listed = alone.unionByName(parts)
    turns = F.transform("mark", lambda mark, i: F.struct((F.col("start") + i).alias("place"), mark.alias("mark"), F.get("words", i).alias("words")))
    listed = listed.select("conv_id", "start", "alone", turns.alias("turns"))
    heads = listed.where((F.col("conv_id") % FAMILY == 0) & (F.col("start") < HEADS - 1)).select(
        F.col("conv_id").alias("base"), F.explode(F.slice("turns", 1, HEADS - 1)).alias("turn")
    )
    heads = heads.where(F.col("turn.place") < HEADS - 1).groupBy("base").agg(F.array_sort(F.collect_list("turn")).alias("head"))
    heads = store(heads, f"{folder}/heads")
    some = listed.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY,
        "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"),
    }).join(broadcast_if_small(heads), "base", "left")
    no_turns = F.expr("CAST(array() AS ARRAY<STRUCT<place: BIGINT, mark: BINARY, words: BIGINT>>)")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), no_turns)
    some = some.withColumn("head", head).withColumn("by", F.size("head") - F.col("h"))
    own = F.transform(
        F.filter("turns", lambda t: t["place"] >= F.col("h")),
        lambda t: F.struct((t["place"] + F.col("by")).alias("place"), t["mark"].alias("mark"), t["words"].alias("words")),
    )
    some = some.select("conv_id", "alone", F.when(F.col("start") == 0, F.concat("head", own)).otherwise(own).alias("turns"))
    short = F.col("alone") & (F.size("turns") <= block_turns)
    simple = some.where(short).select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), F.transform("turns", lambda t: t["mark"]).alias("marks"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    # A conversation that has no turn left still has its first block.
    pieces = some.where(~short).select("conv_id", F.explode_outer("turns").alias("turn"))
    long_ = pieces.groupBy("conv_id", F.coalesce(F.floor(F.col("turn.place") / block_turns), F.lit(0)).cast("bigint").alias("block"))
    long_ = long_.agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", "block", F.transform("turns", lambda t: t["mark"]).alias("marks"), F.transform("turns", lambda t: t["words"]).alias("words")
    )
    long_ = store(long_, f"{folder}/long")
    most = long_.groupBy("conv_id").agg(F.max("block").alias("most"))
    long_ = long_.join(most, "conv_id").withColumn("last", F.col("block") == F.col("most")).drop("most")
    return simple.withColumn("last", F.lit(True)).unionByName(long_)


def _grouped(blocks: DataFrame) -> DataFrame:
    """Blocks of long conversations with ``group``: what tells all blocks before apart, as
    sums of hashes of (block, turns); ``next_group`` has this one too."""
    digest = F.md5(F.concat(F.col("block").cast("string"), F.lit(":"), F.array_join(F.transform("marks", F.hex), "")).cast("binary"))
    parts = {f"_h{k}": F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("bigint") for k in range(3)}
    sums = running_totals(blocks.withColumns(parts), ["conv_id"], "block", {f"_s{k}": f"_h{k}" for k in range(3)})
    group = F.concat_ws(":", *[F.col(f"_s{k}").cast("string") for k in range(3)]).cast("binary")
    following = F.concat_ws(":", *[(F.col(f"_s{k}") + F.col(f"_h{k}")).cast("string") for k in range(3)]).cast("binary")
    named = sums.withColumns({"group": F.when(F.col("block") == 0, F.lit(b"")).otherwise(group), "next_group": following})
    return named.drop(*parts, *[f"_s{k}" for k in range(3)])


TAILS = ("tail_children", "tail_leaves", "tail_saved")


def nodes(conversations: DataFrame, folder: str, chunk_turns: int = CHUNK_TURNS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """All nodes of the trie of the rebuilt ``conversations``."""
    none = {name: F.lit(0).cast("bigint") for name in TAILS}
    blocks = store(rebuilt(conversations, folder, chunk_turns, block_turns), f"{folder}/blocks")
    if blocks.where("block > 0").isEmpty():
        return _named(grow(blocks.withColumns({"group": F.lit(b""), **none}), f"{folder}/trie"), block_turns)
    # Whole conversations of less than a block are in the first group; the others may be deeper.
    short = (F.col("block") == 0) & F.col("last") & (F.size("marks") < block_turns)
    one = blocks.where(short).withColumns({"group": F.lit(b""), **none})
    long_ = store(_grouped(blocks.where(~short)), f"{folder}/grouped")
    deep = grow(long_.where("block > 0").withColumns(none), f"{folder}/deep")
    roots = store(deep.where("kind = 'root'"), f"{folder}/roots")
    carried = roots.select("conv_id", "block", F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved"), F.col("n_children").alias("_children"))
    sums = long_.select("conv_id", "block").join(carried, ["conv_id", "block"], "left").na.fill(0)
    sums = sums.withColumn("_up", -F.col("block"))
    sums = running_totals(sums, ["conv_id"], "_up", {"tail_leaves": "_leaves", "tail_saved": "_saved"})
    next_ = carried.select("conv_id", (F.col("block") - 1).alias("block"), F.col("_children").alias("tail_children"))
    tails = sums.select("conv_id", "block", "tail_leaves", "tail_saved").join(next_, ["conv_id", "block"], "left").na.fill(0)
    tails = tails.select("conv_id", "block", *[F.col(name).cast("bigint").alias(name) for name in TAILS])
    every = one.unionByName(long_.drop("next_group").join(tails, ["conv_id", "block"]))
    found = grow(every, f"{folder}/trie")
    # A group's root is the node above, whose members may also end there.
    ends = long_.where(F.col("last") & (F.size("marks") == block_turns))
    ends = ends.groupBy((F.col("block") + 1).alias("block"), F.col("next_group").alias("group")).agg(F.min("conv_id").alias("ended"))
    above = roots.select("conv_id", "block").join(long_.select("conv_id", "block", "group"), ["conv_id", "block"])
    above = above.join(ends, ["block", "group"]).select(F.col("conv_id").alias("parent_conv_id"), "block", "ended")
    top = (F.col("block") > 0) & (F.col("depth") == 1)
    under = found.where(top).join(broadcast_if_small(store(above, f"{folder}/above")), ["parent_conv_id", "block"], "left")
    under = under.withColumn("parent_conv_id", F.least("parent_conv_id", "ended")).select(*found.columns)
    return _named(found.where(~top).unionByName(under), block_turns)


def _named(found: DataFrame, block_turns: int) -> DataFrame:
    return found.where("kind = 'node'").select(
        "conv_id", (F.col("block") * block_turns + F.col("depth")).alias("depth"), "parent_conv_id",
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
