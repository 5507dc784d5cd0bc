"""Benchmark decontamination by winnowing.

A fingerprint of a text is the smallest hash of the word k-grams in a sliding window of
``w`` k-grams. With ``w + k - 1 = 10`` a window spans exactly ten words, so two texts that
share ten consecutive words share the fingerprint of that span: nothing is missed. The
distinct fingerprints of the corpus are semi-joined with those of the benchmark; texts
with a match are read again, and each matching window is extended to its ten words and
compared as text, so that nothing is found wrongly either.

An item of fewer than ten words is one window of its own length and is winnowed at that
length; only lengths that occur cost anything.

Everything is DataFrame functions. Fingerprints are made distinct per document before the
join, so a passage that a document repeats, or that a third of the corpus shares, is one
row per document there; the benchmark side is broadcast only within a measured bound.

Null and empty texts have no words and are clean. Rows repeating an id are judged each by
its own text. Repeated items count once per item id; items without words never occur. A
very long text is one array of words in its row. Columns of the input, whatever they are
called, play no part; where rows are dropped they stay. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import bind, broadcast_if_small, hidden, lower_ascii, store

# Words of a window, and of the k-grams that are hashed.
WINDOW, GRAM = 10, 5

# What separates words: ASCII characters that are no digit and no lower-case letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Array of words of a text; empty for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def sliding_min(values: Column, w: int) -> Column:
    """Minimum of each ``w`` consecutive values, by doubling; the last w - 1 entries, whose
    windows are cut off, are left in."""
    def joined(shift: int):
        return lambda a: F.zip_with(
            a, F.slice(a, F.lit(shift + 1), F.greatest(F.size(a) - shift, F.lit(0))), lambda x, y: F.least(x, y)
        )

    reach = 1
    while 2 * reach <= w:
        values, reach = bind(values, joined(reach)), 2 * reach
    return bind(values, joined(w - reach)) if reach < w else values


def window_minima(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """For each window of ``window`` words the smallest k-gram hash in it; empty for a
    text with fewer words."""
    k = min(gram, window)

    def minima(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(k))))
        full = F.slice(sliding_min(hashes, window - k + 1), F.lit(1), F.size(ws) - (window - 1))
        return F.when(F.size(ws) >= window, full).otherwise(F.array().cast("array<bigint>"))

    return bind(words, minima)


def with_minima(df: DataFrame, window: int) -> DataFrame:
    """Adds ``_m``, the window minima of ``_words``."""
    return df.withColumn("_m", window_minima(F.col("_words"), window))


def span(words: Column, start: Column, window: int) -> Column:
    return F.array_join(F.slice(words, start, F.lit(window)), " ")


def benchmark_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, n, window, m): the distinct windows of each item, with their number of
    words and their fingerprints."""
    base = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    long = with_minima(base.where(F.size("_words") >= WINDOW), WINDOW)
    at = F.posexplode("_m").alias("_i", "m")
    parts = long.select("item_id", "_words", at).select(
        "item_id", F.lit(WINDOW).alias("n"), span(F.col("_words"), F.col("_i") + 1, WINDOW).alias("window"), "m"
    )
    for n in range(1, WINDOW):
        short = with_minima(base.where(F.size("_words") == n), n)
        parts = parts.unionByName(
            short.select("item_id", F.lit(n).alias("n"), F.array_join("_words", " ").alias("window"), F.get("_m", F.lit(0)).alias("m"))
        )
    return parts.distinct()


def matching_windows(docs: DataFrame, windows: DataFrame, n: int, text: str, path: str) -> DataFrame:
    """(_id, _hash, start, window): the windows of ``n`` words of each document that are
    windows of the benchmark. ``docs`` has the row keys _id and _hash."""
    keys = ["_id", "_hash"]
    prints = broadcast_if_small(windows.where(F.col("n") == n).select("m").distinct())
    words = docs.select(*keys, words_of(F.col(text)).alias("_words"))
    found = (
        with_minima(words, n)
        .select(*keys, F.explode(F.array_distinct("_m")).alias("m"))
        .join(prints, "m", "left_semi")
        .groupBy(*keys).agg(F.collect_set("m").alias("_hits"))
        .withColumnsRenamed({"_id": "_hit_id", "_hash": "_hit_hash"})
    )
    again = docs.join(broadcast_if_small(store(found, path)), F.col("_id").eqNullSafe(F.col("_hit_id")) & F.col("_hash").eqNullSafe(F.col("_hit_hash")))
    placed = with_minima(again.select(*keys, words_of(F.col(text)).alias("_words"), "_hits"), n)
    starts = F.filter(
        F.transform("_m", lambda m, i: F.when(F.array_contains(F.col("_hits"), m), i + 1)), lambda i: i.isNotNull()
    )
    spans = F.transform(starts, lambda i: F.struct(i.alias("start"), span(F.col("_words"), i, n).alias("window")))
    listed = broadcast_if_small(windows.where(F.col("n") == n).select("window").distinct())
    return (
        placed.select(*keys, F.explode(spans).alias("_s"))
        .select(*keys, F.col("_s.start").alias("start"), F.lit(n).alias("n"), F.col("_s.window").alias("window"))
        .join(listed, "window", "left_semi")
        .distinct()
    )


def contamination(
    docs: DataFrame, items: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a window of the
    benchmark), n_items and item_ids (sorted as strings), spans (array of start and n
    words of the windows), contaminated."""
    windows = store(benchmark_windows(items, item_id, text), f"{folder}/windows")
    lengths = [r[0] for r in windows.select("n").distinct().collect()]  # at most WINDOW rows
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text))
    nothing = [F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("window")]
    hits = keyed.where(F.lit(False)).select("_id", "_hash", *nothing)
    for n in sorted(lengths):
        hits = hits.unionByName(matching_windows(keyed, windows, n, text, f"{folder}/found-{n}"))
    hits = store(hits, f"{folder}/hits")
    keys = ["_id", "_hash"]
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    by_doc = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    by_doc = by_doc.withColumn("n_hit", F.size(covered).cast("long"))
    items_of = broadcast_if_small(windows.select("window", F.col("item_id").cast("string").alias("item")).distinct())
    listed = (
        hits.select(*keys, "window").distinct().join(items_of, "window")
        .groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    found = by_doc.join(listed.withColumnsRenamed({"_id": "_li", "_hash": "_lh"}), F.col("_id").eqNullSafe(F.col("_li")) & (F.col("_hash") == F.col("_lh")), "left")
    found = found.select(F.col("_id").alias("_fi"), F.col("_hash").alias("_fh"), "spans", "n_hit", "item_ids")
    counted = keyed.select("_id", "_hash", F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = counted.join(found, F.col("_id").eqNullSafe(F.col("_fi")) & (F.col("_hash") == F.col("_fh")), "left")
    ids = F.coalesce("item_ids", none)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "spans",
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` without a word inside a benchmark window."""
    bad = contamination(docs, items, folder, doc_id, text, item_id).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    docs, now, back = hidden(docs, ["_id", "_hash"])
    same = F.col(now(doc_id)).eqNullSafe(F.col("_id")) & (F.xxhash64(now(text)) == F.col("_hash"))
    return back(docs.join(bad, same, "left_anti"))
