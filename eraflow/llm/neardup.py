"""Near-duplicates by minhash with tensored banding.

Two small collections of ``SIDE`` band hashes, each over ``ROWS`` minhashes, are combined
pairwise into ``SIDE**2`` table keys, so that 2 * SIDE * ROWS minhashes do the work of
SIDE**2 * 2 * ROWS. Two texts share a key when they agree in some band of the first and
some band of the second collection: at similarity s that fails with probability
1 - (1 - (1 - s**ROWS)**SIDE)**2, 0.0005 at s = 0.75 and 5e-6 at 0.85. Candidates
are confirmed on their full shingle sets.

Texts with equal sets are one node from the start. A bucket is never expanded into all its
pairs at first: every member is compared with the bucket's smallest node, confirmed links
are joined into components, and buckets that still hold several components are compared
with other nodes of theirs, chosen by a hash, as long as that joins a fair share of what
is open. What is left then is settled exactly: all pairs of open nodes that agree in a band
of the first collection and in one of the second (so, that share a bucket), and are still
in different components, are screened by numpy on the nodes' minhashes, in blocks of
bounded size by bands of the first collection. A pair is looked at only in the first
band it shares, which the minhashes tell without any shuffle, and the pairs that pass are
confirmed.

Before texts are fetched for a pair, its set sizes must allow the similarity (exact), and
it must agree in ``AGREEMENT`` of its table minhashes and, in the last step, in
``SKETCH_AGREEMENT`` of ``SKETCH`` further ones. A pair of similarity 0.75 fails these tests
with probability 3e-5 and 1e-4, one of 0.77 with less than 1e-6.

Tables that grow with the corpus are joined by shuffle, or broadcast if they are measured to
be small; Spark's own sizes are not relied on (a node has ``SIDE**2`` keys, which it counts
as one row).

Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id
count as documents of their own; equal ones are copies of each other. A very long text is
hashed in pieces. Columns of the input, whatever they are called, play no part; where
rows are dropped they stay. An empty table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import broadcast_if_small, by_shuffle, hidden, release_memory, remove, store
from eraflow.llm.components import components
from eraflow.llm.shingles import mix, set_digest, shingle_set, similar

ROWS, SIDE, PERCENT = 2, 10, 75
HASHES = 2 * SIDE * ROWS
AGREEMENT = 0.45
SKETCH, SKETCH_AGREEMENT = 1024, 0.70
# Share of the open nodes that a round of single comparisons must join to be followed by
# another one.
FAIR_SHARE = 0.5
# A round of single comparisons looks at one table in so many; the last step at all.
TABLES_IN = 4
# Nodes of a block in the last step.
BLOCK = 4096

_RANDOM = np.random.Generator(np.random.PCG64(50))
_FACTOR = _RANDOM.integers(1, 1 << 63, HASHES + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, HASHES + SKETCH, dtype=np.uint64)
# Low bits of a table key: the number of its table.
_TABLE_BITS = np.uint64((1 << (SIDE * SIDE - 1).bit_length()) - 1)
_BAND = _RANDOM.integers(1, 1 << 63, (2, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _smallest(shingles: np.ndarray, functions: slice) -> np.ndarray:
    factor, shift = _FACTOR[functions], _SHIFT[functions]
    low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    rows = max(1, (1 << 17) // len(factor))
    for at in range(0, len(shingles), rows):
        values = shingles[at : at + rows, None] ^ shift
        values *= factor
        np.minimum(low, values.min(axis=0), out=low)
    return low


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest value of each table hash function."""
    return (_smallest(shingles, slice(0, HASHES)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(shingles: np.ndarray) -> bytes:
    """One byte of each of ``SKETCH`` further minhashes."""
    return (mix(_smallest(shingles, slice(HASHES, None))) >> np.uint64(56)).astype(np.uint8).tobytes()


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """SIDE**2 keys per row of minhashes: a band of the first half with one of the second.
    The low bits of a key are the number of its table."""
    bands = signatures.view(np.uint32).astype(np.uint64).reshape(len(signatures), 2, SIDE, ROWS)
    bands = mix((bands * _BAND[None, :, None, :]).sum(axis=3, dtype=np.uint64))
    first, second = bands[:, 0], bands[:, 1]
    number = np.arange(SIDE * SIDE, dtype=np.uint64).reshape(SIDE, SIDE)
    keys = mix(first[:, :, None] + mix(second)[:, None, :] * np.uint64(3) + number)
    return ((keys & ~_TABLE_BITS) | number).reshape(len(signatures), -1).view(np.int64)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash and signature of every row; the last two
    are null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, marks = [], [], []
            for cell in batch.column(2):
                shingles = shingle_set(cell.as_py())
                sizes.append(len(shingles))
                digests.append(set_digest(shingles) if len(shingles) else None)
                marks.append(minhashes(shingles) if len(shingles) else None)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(marks, pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "n_shingles", "set_hash", "signature"],
            )
        release_memory()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, set_hash binary, signature array<int>")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node) for every table key of every node."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                marks = part.column(1).flatten().to_numpy().reshape(-1, HASHES)
                keys = table_keys(np.ascontiguousarray(marks))
                node = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(emit, "key long, node long")


def hopeful(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and table minhashes allow the similarity."""
    facts = nodes.select("node", "n_shingles", "signature")
    side = lambda c: facts.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    able = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    joined = pairs.join(by_shuffle(side("a")), "a").join(by_shuffle(side("b")), "b")
    return joined.where(able & (agree >= AGREEMENT * HASHES)).select("a", "b")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """(node, text) of the distinct nodes of ``wanted``, written. ``docs`` has doc_id,
    text_hash and text."""
    rep = [F.col("rep.doc_id").alias("_i"), F.col("rep.text_hash").alias("_h"), F.col("rep.n_rows").alias("n_rows")]
    places = store(nodes.join(by_shuffle(wanted.distinct()), "node", "left_semi").select("node", *rep), f"{folder}/places")
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h"))
    # Only rows that are repeated with their id have to be made one again.
    once, several = (docs.join(broadcast_if_small(places.where(which)), same).select("node", "text") for which in ("n_rows = 1", "n_rows > 1"))
    return store(once.unionByName(several.dropDuplicates(["node"])), f"{folder}/texts")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str, percent: int) -> DataFrame:
    """The stored ``pairs`` (a, b) that reach the similarity on their full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shingles = None, None
        for batch in batches:
            keep = []
            a, left, right = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, shingles = a[i], shingle_set(left[i].as_py())
                keep.append(similar(shingles, shingle_set(right[i].as_py()), percent))
            chosen = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if chosen.num_rows:
                yield chosen
        release_memory()

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = texts_of(ends, nodes, docs, folder)
    full = (
        pairs.join(by_shuffle(texts.withColumnsRenamed({"node": "b", "text": "right"})), "b")
        .join(by_shuffle(texts.withColumnsRenamed({"node": "a", "text": "left"})), "a")
        .select("a", "b", "left", "right")
    )
    links = store(full.mapInArrow(check, "a long, b long"), f"{folder}/links")
    for done in ("places", "texts"):
        remove(docs.sparkSession, f"{folder}/{done}")
    return links


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of sorted batches by equal values of the first ``keys`` columns (numbers)."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        turn = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            turn |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            key = tuple(int(c[start]) for c in columns)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)


def _screen(a: dict, b: dict, own: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs worth confirming that share a bucket and agree in
    band ``own`` of the first collection, but in no earlier one."""
    n, m = a["size"][:, None], b["size"][None, :]
    ok = (a["component"][:, None] != b["component"][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    agree = np.zeros(ok.shape, np.int16)
    second = np.zeros(ok.shape, bool)
    for band in range(2 * SIDE):
        same = np.ones(ok.shape, bool)
        for h in range(band * ROWS, (band + 1) * ROWS):
            equal = a["marks"][h][:, None] == b["marks"][h][None, :]
            agree += equal
            same &= equal
        if band < own:
            ok &= ~same
        elif band == own:
            ok &= same
        elif band >= SIDE:
            second |= same
    i, j = np.nonzero(ok & second & (agree >= AGREEMENT * HASHES))
    close = [
        (a["sketch"][i[at : at + 8192]] == b["sketch"][j[at : at + 8192]]).sum(axis=1) >= SKETCH_AGREEMENT * SKETCH
        for at in range(0, len(i), 8192)
    ]
    kept = np.concatenate(close) if close else np.zeros(0, bool)
    return i[kept], j[kept]


def screened(open_nodes: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str, percent: int) -> DataFrame:
    """(a, b): the pairs of ``open_nodes`` (node, component) of different components that
    share a bucket and may be similar."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [sketch(shingle_set(t.as_py())) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(marks, pa.binary())], ["node", "sketch"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (own, _, low, high), rows in runs(batches, 4):
            rows = rows.combine_chunks()
            block = rows["block"].to_numpy()
            facts = {
                "node": rows["node"].to_numpy(), "component": rows["component"].to_numpy(), "size": rows["n_shingles"].to_numpy(),
                "marks": np.ascontiguousarray(rows["signature"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES).T),
                "sketch": np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH),
            }
            part = lambda at: {k: v[:, at] if k == "marks" else v[at] for k, v in facts.items()}
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            b = part(right)
            for at in range(0, len(left), 256):
                a = part(left[at : at + 256])
                i, j = _screen(a, b, own, percent)
                x, y = a["node"][i], b["node"][j]
                once = (x < y) if low == high else np.ones(len(x), bool)
                x, y = np.minimum(x, y)[once], np.maximum(x, y)[once]
                if len(x):
                    yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])

    texts = texts_of(open_nodes.select("node"), nodes, docs, folder)
    sketches = store(texts.mapInArrow(draw, "node long, sketch binary"), f"{folder}/sketches")
    facts = nodes.select("node", "n_shingles", "signature").join(broadcast_if_small(sketches), "node").join(by_shuffle(open_nodes), "node")
    bands = [F.xxhash64(*[F.get("signature", F.lit(i * ROWS + r)) for r in range(ROWS)]) for i in range(SIDE)]
    listed = store(facts.select("*", F.posexplode(F.array(*bands)).alias("own", "band")), f"{folder}/bands")
    sizes = listed.groupBy("own", "band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        listed.join(by_shuffle(sizes), ["own", "band"])
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("own", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                "block", "node", "component", "n_shingles", "signature", "sketch")
    )
    order = ["own", "band", "low", "high"]
    found = store(placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(find, "a long, b long"), f"{folder}/screened")
    for done in ("places", "texts", "sketches", "bands"):
        remove(docs.sparkSession, f"{folder}/{done}")
    return found


def cluster(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, set_hash, n_shingles, component
    (a number) and component_id, the smallest doc_id of the texts connected by links."""
    spark = docs.sparkSession
    sets = store(signed(docs, doc_id, text), f"{folder}/sets")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    nodes = (
        sets.where(F.col("set_hash").isNotNull()).groupBy("set_hash", "doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .groupBy("set_hash")
        .agg(F.min(F.struct("doc_id", "text_hash", "n_rows")).alias("rep"), F.min("doc_id").alias("first_id"),
             F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = store(nodes, f"{folder}/nodes")
    keys = keyed(nodes)
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = store(keys.join(by_shuffle(buckets.select("key")), "key"), f"{folder}/members")
    heads = members.groupBy("key").agg(F.min("node").alias("a"))
    first = members.join(by_shuffle(heads), "key").where("a < node").select("a", F.col("node").alias("b")).distinct()
    tested = store(hopeful(first, nodes, percent), f"{folder}/pairs-0")
    links = confirmed(tested, nodes, rows, f"{folder}/round-0", percent)
    found = store(components(links, f"{folder}/steps-0"), f"{folder}/found-0")
    step, last = 0, False
    while not last:
        step += 1
        known = found.select("node", "component")
        labelled = members.join(by_shuffle(known), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        open_buckets = (
            labelled.groupBy("key")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
            .where("low < high").select("key", "n")
        )
        members = store(labelled.join(by_shuffle(open_buckets), "key"), f"{folder}/members-{step}")
        nodes_open, joined = members.select("node").distinct().count(), links.count()
        if not nodes_open:
            break
        # from the second time on: go on in this way only if the last round was worth it
        last = step > 1 and joined - before <= FAIR_SHARE * nodes_open
        before = joined
        if last:
            pairs = screened(members.select("node", "component").distinct(), nodes, rows, f"{folder}/screen", percent)
        else:
            looked = members.where(F.pmod(F.col("key").bitwiseAND(F.lit(int(_TABLE_BITS))) + step, F.lit(TABLES_IN)) == 0)
            by = F.xxhash64("key", "node", F.lit(step))
            heads = looked.groupBy("key").agg(F.min_by(F.struct("node", "component"), by).alias("head"))
            pairs = (
                looked.join(by_shuffle(heads), "key").where("component <> head.component")
                .select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
            )
            pairs = hopeful(pairs, nodes, percent)
        fresh = store(pairs.join(by_shuffle(tested), ["a", "b"], "left_anti"), f"{folder}/pairs-{step}")
        more = confirmed(fresh, nodes, rows, f"{folder}/round-{step}", percent)
        links, tested = links.unionByName(more), tested.unionByName(fresh)
        members = members.select("key", "node")
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = store(components(known.unionByName(more), f"{folder}/steps-{step}"), f"{folder}/found-{step}")
    lowest = (
        nodes.join(by_shuffle(found), "node", "left")
        .select("set_hash", "first_id", F.coalesce("component", "node").alias("component"))
    )
    ids = lowest.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = lowest.join(by_shuffle(ids), "component").select("set_hash", "component", "component_id")
    out = sets.join(by_shuffle(labels), "set_hash", "left").select(
        "doc_id", "text_hash", "set_hash", "n_shingles", "component",
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    for name in ("members", *(f"members-{i}" for i in range(1, step + 1))):
        remove(spark, f"{folder}/{name}")
    return out


def keep_one(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the
    smallest id (of rows that repeat it, one); texts without words all stay."""
    found = store(cluster(docs, folder, doc_id, text), f"{folder}/clusters")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    heads = found.where("set_hash IS NOT NULL").groupBy("component").agg(F.min(place).alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("_i"), F.col("head.text_hash").alias("_h"))
    every = found.where("set_hash IS NOT NULL").groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    every = every.agg(F.count(F.lit(1)).alias("n"))
    head_of = F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h"))
    dropped = broadcast_if_small(store(every.join(by_shuffle(heads), head_of, "left_anti"), f"{folder}/dropped"))
    twice = broadcast_if_small(store(every.where("n > 1").join(by_shuffle(heads), head_of, "left_semi"), f"{folder}/twice"))
    docs, now, back = hidden(docs, ["_d", "_t"])
    doc_id, text = now(doc_id), now(text)
    this = F.col(doc_id).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t"))
    kept = docs.join(dropped, this, "left_anti")
    again = kept.join(twice, this, "left_semi").withColumn("_t", F.xxhash64(text)).dropDuplicates([doc_id, "_t"]).drop("_t")
    return back(kept.join(twice, this, "left_anti").unionByName(again))
