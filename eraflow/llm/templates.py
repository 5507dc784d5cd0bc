"""Line deduplication with a log-template tree.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its first
``DEPTH`` tokens, where a token with a digit counts as the variable ``<*>``. Templates are
made in two steps. A line whose tokens, variables aside, come again in another document
is an instance of that text. The other lines of a leaf are generalised together: a
position is constant if more than half of the leaf's lines have the same token there
and a variable otherwise; a line belongs to the leaf's template if at least
``SIMILAR`` tenths of its tokens are constants it agrees with.

Lines of templates that recur in ``MIN_DOCS`` or more documents are dropped, all but the
first (by document id, then line). Lines of fewer than ``MIN_TOKENS`` tokens stay.

Everything is DataFrame functions. Lines are counted per template and document before they
are counted per template, so a line that a third of the corpus has is spread over the
tasks that read it; only lines of shared leaves are taken apart into tokens; documents
are joined with the numbers of their dropped lines and put together in their own rows.

Null texts stay null and have no lines. A document is its id with its text: rows that repeat
both are one document and are treated alike. A very long text is parsed line by line in its
own row. Columns of the added names are replaced; all others stay, whatever they are
called. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import bind, broadcast_if_small, hidden, store

DEPTH, MIN_TOKENS, MIN_DOCS, SIMILAR = 4, 5, 2, 6

SPACES = r"[\x20\x09-\x0D]+"
# A token with a digit, from its start.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"

KEYS = ["_id", "_hash"]


def tokens_of(line: Column) -> Column:
    """The tokens of a line, those with a digit as ``<*>``."""
    named = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, "<*>")).otherwise(line)
    return F.array_remove(F.split(named, SPACES), "")


def parsed_lines(keyed: DataFrame, text: str) -> DataFrame:
    """_id, _hash, line (its number), exact and leaf (hashes of all tokens, and of their
    number and the first ones); lines of ``MIN_TOKENS`` tokens or more."""
    def parse(line: Column) -> Column:
        return bind(tokens_of(line), lambda ts: F.struct(
            F.size(ts).alias("n"), F.xxhash64(ts).alias("exact"),
            F.xxhash64(F.size(ts), F.slice(ts, F.lit(1), F.lit(DEPTH))).alias("leaf"),
        ))

    lines = keyed.select(*KEYS, F.posexplode(F.transform(F.split(text, "\n"), parse)).alias("line", "_p"))
    return lines.where(F.col("_p.n") >= MIN_TOKENS).select(*KEYS, "line", "_p.exact", "_p.leaf")


def token_rows(keyed: DataFrame, wanted: DataFrame, text: str, path: str) -> DataFrame:
    """_id, _hash, line, leaf, tokens of the ``wanted`` lines (_id, _hash, line, leaf): only
    these are taken apart again."""
    by_doc = wanted.groupBy(*KEYS).agg(F.collect_set(F.struct("line", "leaf")).alias("_wanted"))
    by_doc = broadcast_if_small(store(by_doc.withColumnsRenamed({"_id": "_wi", "_hash": "_wh"}), path))
    same = F.col("_id").eqNullSafe(F.col("_wi")) & (F.col("_hash") == F.col("_wh"))

    def chosen(lines: Column) -> Column:
        return F.transform("_wanted", lambda s: F.struct(
            s["line"].alias("line"), s["leaf"].alias("leaf"), tokens_of(F.get(lines, s["line"])).alias("tokens"),
        ))

    found = keyed.join(by_doc, same).select(*KEYS, F.explode(bind(F.split(text, "\n"), chosen)).alias("_s"))
    return found.select(*KEYS, "_s.line", "_s.leaf", "_s.tokens").dropDuplicates([*KEYS, "line"])


def recurring(members: DataFrame, by: str) -> DataFrame:
    """(by, first): templates of several documents, with the first of their lines."""
    place = F.struct("_id", "_hash", "line")
    per_doc = members.groupBy(by, *KEYS).agg(F.min("line").alias("line"))
    counted = per_doc.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first"))
    return counted.where(F.col("docs") >= MIN_DOCS).select(by, "first")


def later(members: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """The lines of recurring templates but the first of each."""
    joined = members.join(broadcast_if_small(found), by)
    same = F.struct("_id", "_hash", "line").eqNullSafe(F.col("first"))
    return joined.where(~same).select(*KEYS, "line")


def dropped_lines(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _hash, line): the lines to drop, by document id, text hash and line number."""
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text)).where(F.col(text).isNotNull())
    lines = store(parsed_lines(keyed, text).distinct(), f"{folder}/lines")
    exact = store(recurring(lines, "exact"), f"{folder}/exact")
    single = lines.join(broadcast_if_small(exact.select("exact")), "exact", "left_anti")
    shared = (
        single.select("leaf", *KEYS).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= MIN_DOCS).select("leaf")
    )
    wanted = single.join(broadcast_if_small(store(shared, f"{folder}/leaves")), "leaf", "left_semi")
    members = store(token_rows(keyed, wanted, text, f"{folder}/wanted"), f"{folder}/members")
    sizes = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    usual = (
        members.select("leaf", F.posexplode("tokens").alias("place", "token"))
        .groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("top"))
        .join(sizes, "leaf")
    )
    constant = F.when(F.col("top.n") * 2 > F.col("size"), F.col("top.token")).alias("token")
    places = F.array_sort(F.collect_list(F.struct("place", "token")))
    templates = usual.select("leaf", "place", constant).groupBy("leaf").agg(
        F.transform(places, lambda s: s["token"]).alias("constants")
    )
    templates = store(templates, f"{folder}/templates")
    joined = members.join(broadcast_if_small(templates), "leaf")
    agree = F.zip_with("tokens", "constants", lambda t, c: t.eqNullSafe(c).cast("int"))
    near = F.aggregate(agree, F.lit(0), lambda a, x: a + x) * 10 >= F.size("tokens") * SIMILAR
    near_lines = store(joined.where(near).select(*KEYS, "line", "leaf"), f"{folder}/near")
    general = store(recurring(near_lines, "leaf"), f"{folder}/general")
    return later(lines, exact, "exact").unionByName(later(near_lines, general, "leaf"))


def drop_recurring(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the dropped lines, with columns n_lines (before) and n_dropped."""
    docs, now, back = hidden(docs, ["_id", "_hash", "_drop"])
    doc_id, text = now(doc_id), now(text)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    by_doc = dropped_lines(docs, folder, doc_id, text).groupBy(*KEYS).agg(F.collect_set("line").alias("_drop"))
    by_doc = broadcast_if_small(store(by_doc, f"{folder}/dropped"))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    lines = F.split(F.col(text), "\n")
    rest = lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop")), lambda i: F.get(ls, i)
    )
    shorter = F.array_join(bind(lines, rest), "\n")
    joined = docs.select(*kept).join(by_doc, same, "left")
    cleaned = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(shorter).alias(text)
    return back(joined.select(
        *[cleaned if c == text else F.col(c) for c in kept],
        F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_drop").isNotNull(), F.size("_drop")), F.lit(0)).cast("long").alias("n_dropped"),
    ))
