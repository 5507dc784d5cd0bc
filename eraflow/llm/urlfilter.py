"""Address rules looked up in a Bloom filter cascade.

A rule is a host with all its subdomains and a path prefix. The corpus gives the key
universe: every (host suffix, path prefix) of its addresses that has the shape of some
rule. Level 1 of a cascade holds the listed keys, level 2 those keys of the universe that
level 1 lets through wrongly, level 3 the listed keys that level 2 lets through, and so
on until nothing is wrong. Over the universe the answer is exact, and an address is judged
from a few bit tests in its own row, without a join.

Level 1 is sized for a false positive rate of about listed / universe, so the next
levels hold about as many keys as are listed: the filters grow with the list and the
logarithm of the universe, never with the corpus.

Addresses without ``://``, null or empty have empty host and path, fit no rule and get the
default verdict. Repeated rows are judged alike. Very long addresses have no more keys than
short ones. Columns named like a result are replaced; all others stay, whatever they are
called. An empty table has an empty universe and gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import broadcast_if_small, hidden, lower_ascii, store

# False positive rate of the levels after the first.
LOWER_LEVEL_RATE = 0.1


@dataclass(frozen=True)
class Rule:
    """``verdict`` ("allow" or "block") for ``host`` and its subdomains below ``path``."""

    host: str
    path: str
    verdict: str

    def __post_init__(self):
        if "/" in self.host or not self.host or (self.path and self.path[0] != "/"):
            raise ValueError(f"a rule needs a host and a path that begins with /: {self}")
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {self.verdict!r}")

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: Column


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of an address: host lower-cased in A-Z, both empty without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    empty = F.lit("")
    return lower_ascii(F.coalesce(host, empty)), F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), empty)


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Array of the keys an address could match, longest first. Only suffixes with as
    many labels, and prefixes as long, as some rule has can match, so the array is
    bounded by the shapes of the rules, however long the address is."""
    labels = F.split(host, r"\.")
    suffixes = [
        F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
        for n in sorted({r.host.count(".") + 1 for r in rules})
    ]
    prefixes = [
        F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted({len(r.path) for r in rules})
    ]
    keys = [F.concat(s, p) for s in suffixes for p in prefixes]
    found = F.filter(F.array(*keys), lambda k: k.isNotNull() & ~k.startswith("/"))
    ranked = F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), F.locate("/", k).alias("at"), k.alias("key")))
    return F.transform(F.array_sort(F.array_distinct(ranked)), lambda s: s["key"])


def bit_positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits).cast("long"))
    second = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits).cast("long"))
    return [F.pmod(first + second * i, F.lit(bits).cast("long")) for i in range(hashes)]


def passes(key: Column, number: int, level: Level) -> Column:
    """Whether the filter of one level lets the key through."""
    test = F.lit(True)
    for p in bit_positions(key, number, level.bits, level.hashes):
        word = F.get(level.words, F.shiftright(p, 6).cast("int"))
        test = test & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
    return test


def bloom_words(keys: DataFrame, number: int, bits: int, hashes: int) -> DataFrame:
    """One row: the filter's bits as an array of 64-bit words."""
    at = F.explode(F.array(*bit_positions(F.col("key"), number, bits, hashes)))
    one = F.lit(1).cast("long")
    masks = keys.select(at.alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("mask")
    )
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), (one * 0).alias("mask"))
    words = masks.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda s: s["mask"]).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, folder: str) -> list[Level]:
    """Levels for the ``key`` column of ``listed`` over that of ``universe`` (distinct
    keys, written tables). Stops when a level lets nothing through wrongly."""
    spark = listed.sparkSession
    others = universe.join(broadcast_if_small(listed), "key", "left_anti")
    n_listed, n_others = listed.count(), others.count()
    levels: list[Level] = []
    if not n_listed:
        return levels
    inside, outside, n_inside = listed, others, n_listed
    rate = min(0.5, 0.7 * n_listed / max(n_others, 1))
    while n_inside:
        number = len(levels)
        size = max(64, 64 * math.ceil(n_inside * math.log2(1 / rate) / math.log(2) / 64))
        hashes = max(1, round(math.log2(1 / rate)))
        store(bloom_words(inside, number, size, hashes), f"{folder}/level-{number}")
        level = Level(size, hashes, spark.read.parquet(f"{folder}/level-{number}").select("words").scalar())
        wrong = store(outside.where(passes(F.col("key"), number, level)), f"{folder}/wrong-{number}")
        levels.append(level)
        inside, outside, n_inside, rate = wrong, inside, wrong.count(), LOWER_LEVEL_RATE
    return levels


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a key of the universe."""
    found = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        found = F.when(passes(key, number, levels[number]), found).otherwise(F.lit(number % 2 == 1))
    return found


def judge(pages: DataFrame, rules: Sequence[Rule], folder: str, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. The longest fitting rule wins (of two
    equally long ones that with the longer host); an address no rule fits gets ``default``.
    A key listed for both verdicts is blocked. Columns of these names are replaced."""
    spark = pages.sparkSession
    pages, now, back = hidden(pages, ["_host", "_path", "_keys", "_rule"])
    url = now(url)
    host, path = url_parts(F.col(url))
    parts = pages.drop(*{"host", "path", "rule", "verdict"} - {url}).withColumns({"_host": host, "_path": path})
    parts = parts.withColumn("_keys", candidate_keys(F.col("_host"), F.col("_path"), rules))
    universe = store(parts.select(F.explode("_keys").alias("key")).distinct(), f"{folder}/universe")
    cascades = {}
    for verdict in ("block", "allow"):
        keys = sorted({r.key for r in rules if r.verdict == verdict})
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        cascades[verdict] = build_cascade(store(listed, f"{folder}/listed-{verdict}"), universe, f"{folder}/{verdict}")
    shapes = len({r.host.count(".") for r in rules}) * len({len(r.path) for r in rules})
    at = [F.get("_keys", F.lit(i)) for i in range(shapes)]
    fits = [F.when(member(k, cascades["block"]) | member(k, cascades["allow"]), k) for k in at]
    judged = parts.withColumn("_rule", F.coalesce(*fits))
    verdict = (
        F.when(F.col("_rule").isNull(), default)
        .when(member(F.col("_rule"), cascades["block"]), "block").otherwise("allow")
    )
    kept = [F.col(c) for c in pages.columns if c not in {"host", "path", "rule", "verdict"} - {url}]
    added = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict")]
    return back(judged.select(*kept, *added))
