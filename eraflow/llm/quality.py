"""Quality by divergence from language references.

Every document has two histograms: of its character classes, and of the words that are
common in some language (all other words are one more bin). The references are the same
histograms of the whole corpus per language: every text is counted, words are summed per
task before they are shuffled, and the ``COMMON`` most frequent words of each language
become bins. A document is as far from a reference as the square root of the
Jensen-Shannon divergence (in bits) of the histograms, and is judged by the reference it is
closest to, so it may be of any language. It is kept if both distances are small enough
and its common words are not missing.

A text without any common word is only as far from a reference as the reference's common
words cover (0.46 where they are 36% of the words), which can be within ``MAX_WORDS``. So
the share of the closest language's common words must also be ``FEW_COMMON`` of their
share in its reference or more. Where fewer than ``SURE_COMMON`` of them are expected (in
languages whose common words cover little), they may be missing by chance, and the word
distance alone decides.

Short histograms are far from everything by chance. Documents under ``MIN_WORDS`` words
fail a base rule anyway; under ``SURE_WORDS`` words only the characters decide, which
are several times as many.

Base rules fail a document of fewer than ``MIN_WORDS`` words or of which more than half
the words lie in 3-word windows that occur again.

Null and empty texts have no words and fail. Rows that repeat an id are judged each by its
own text. Texts without a language count in no reference but are judged. Without any
reference the base rules alone decide. A very long text is counted in pieces. Columns the
result adds are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eraflow.llm.common import with_fields
from eraflow.llm.shingles import SPACES, hashed_words, mix, pieces, to_bytes

MIN_WORDS, SURE_WORDS = 50, 100
COMMON = 100
MAX_CHARS, MAX_WORDS = 0.28, 0.47
FEW_COMMON, SURE_COMMON = 0.25, 30
# Distinct (language, word) sums that a task holds before it hands them on.
HELD_WORDS = 1 << 20

_CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)  # anything else
for _number, _chars in enumerate((
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"()-?", "#*$%&|<>", "!",
)):
    _CLASS[[ord(c) for c in _chars]] = _number
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LETTER_BEYOND = np.arange(256) >= 0xC0  # first byte of a character beyond ASCII
_CLASS[_LETTER_BEYOND] = 0
_FIRST = (np.arange(256) & 0xC0) != 0x80


@dataclass
class References:
    """``words``: sorted hashes of the common words. Rows of ``chars`` and ``shares`` are
    the histograms of the languages."""

    langs: list[str]
    words: np.ndarray
    chars: np.ndarray
    shares: np.ndarray


def char_counts(data: np.ndarray) -> np.ndarray:
    """Characters of each class (all letters beyond ASCII count as lower case)."""
    return np.bincount(_CLASS[data[_FIRST[data]]], minlength=_CLASSES).astype(float)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histogram ``p`` from each row of ``q`` (all of sum 1)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


def repeated_words(words: np.ndarray, size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for j in range(size):
        window += mix(words[j : n + j] + np.uint64(j + 1))
    _, back, count = np.unique(mix(window), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    hit = np.zeros(len(words), bool)
    for j in range(size):
        hit[starts + j] = True
    return int(hit.sum())


def measures(raw: bytes) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(exact word hashes, [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words],
    character counts) of a text."""
    data = to_bytes(raw)
    found, chars, letters = [], np.zeros(_CLASSES), 0
    for part in pieces(data, SPACES):
        found.append(hashed_words(part, SPACES, fold=False)[0])
        chars += char_counts(part)
        letters += int((_FIRST[part] & ~SPACES[part]).sum())
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    symbols = int(_SYMBOL[data].sum()) if len(data) else 0
    return words, [len(words), letters, symbols, duplicate_lines(raw), repeated_words(words)], chars


def counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, code, n): sums over parts of the corpus, of words (kind 1, by hash)
    and of character classes (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        chars: dict[str, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, arrays in held.items():
                codes, n = np.unique(np.concatenate(arrays), return_counts=True)
                count = len(codes)
                yield pa.record_batch(
                    [pa.array([name] * count), pa.array(np.ones(count, np.int32)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "kind", "code", "n"],
                )
            held.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, cell in zip(names, batch.column(1).cast(pa.binary()), strict=True):
                data = to_bytes(cell.as_py() or b"")
                chars.setdefault(name, np.zeros(_CLASSES))
                for part in pieces(data, SPACES):
                    chars[name] += char_counts(part)
                    words = hashed_words(part, SPACES, fold=True)[0]
                    held.setdefault(name, []).append(words)
                    size += len(words)
                    if size >= HELD_WORDS:
                        yield from flush()
                        size = 0
        yield from flush()
        for name, row in chars.items():
            yield pa.record_batch(
                [pa.array([name] * _CLASSES), pa.array(np.zeros(_CLASSES, np.int32)), pa.array(np.arange(_CLASSES)), pa.array(row.astype(np.int64))],
                ["lang", "kind", "code", "n"],
            )

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, kind int, code long, n long")


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """The languages' histograms over all texts. To the driver come, per language, the
    class counts, the number of words and the ``COMMON`` most frequent words."""
    sums = counted(docs, text, lang).groupBy("lang", "kind", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "code")
    top = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON)
    chars: dict[str, dict[int, int]] = {}
    words: dict[str, dict[int, int]] = {}
    for r in top.select("lang", "kind", "code", "n").collect():
        (words if r["kind"] else chars).setdefault(r["lang"], {})[r["code"]] = r["n"]
    totals = {r["lang"]: r["n"] for r in sums.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return build(sorted(chars), chars, words, totals)


def build(langs: Sequence[str], chars: dict, words: dict, totals: dict) -> References:
    """References from per-language counts."""
    codes = np.unique(np.array([c for name in langs for c in words.get(name, {})], np.int64).view(np.uint64))
    shares = np.zeros((len(langs), len(codes) + 1))
    classes = np.zeros((len(langs), _CLASSES))
    for i, name in enumerate(langs):
        for code, n in words.get(name, {}).items():
            shares[i, np.searchsorted(codes, np.int64(code).view(np.uint64))] = n
        shares[i, -1] = max(0, totals.get(name, 0) - shares[i, :-1].sum())
        for code, n in chars.get(name, {}).items():
            classes[i, code] = n
    ok = (shares.sum(axis=1) > 0) & (classes.sum(axis=1) > 0)
    return References(
        [n for n, k in zip(langs, ok, strict=True) if k], codes,
        classes[ok] / classes[ok].sum(axis=1, keepdims=True), shares[ok] / shares[ok].sum(axis=1, keepdims=True),
    )


def distances(words: np.ndarray, chars: np.ndarray, refs: References) -> tuple[float, float, bool]:
    """Of the closest language: the distances of its characters and of its words, and
    whether its common words are missing."""
    place = np.searchsorted(refs.words, words)
    place[place == len(refs.words)] = 0
    common = refs.words[place] == words if len(refs.words) else np.zeros(len(words), bool)
    counts = np.bincount(np.where(common, place, len(refs.words)), minlength=len(refs.words) + 1).astype(float)
    by_word = divergence(counts / counts.sum(), refs.shares)
    by_char = divergence(chars / chars.sum(), refs.chars)
    best = int((by_word + by_char).argmin())
    usual = refs.shares[best, :-1]
    expected = usual.sum() * len(words)
    missing = expected >= SURE_COMMON and counts[:-1][usual > 0].sum() < FEW_COMMON * expected
    return float(by_char[best]), float(by_word[best]), bool(missing)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, refs: References, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, char_distance, word_distance (null
    where they are not judged) and kept."""
    added = [*BASE, "base_failed", "char_distance", "word_distance", "kept"]
    kept_columns = [c for c in docs.columns if c not in added or c == text]
    place = kept_columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, far_chars, far_words, kept = [], [], [], [], []
            for cell in batch.column(place).cast(pa.binary()):
                raw = cell.as_py() or b""
                words, base, chars = measures(raw)
                bad = base[0] < MIN_WORDS or 100 * base[4] > 50 * base[0]
                by_char = by_word = None
                missing = False
                if not bad and refs.langs:
                    folded = np.concatenate([hashed_words(p, SPACES)[0] for p in pieces(to_bytes(raw), SPACES)])
                    by_char, by_word, missing = distances(folded, chars, refs)
                    if base[0] < SURE_WORDS:
                        by_word, missing = None, False
                counts.append(base)
                failed.append(bad)
                far_chars.append(by_char)
                far_words.append(by_word)
                kept.append(not bad and not missing and (by_char or 0) <= MAX_CHARS and (by_word or 0) <= MAX_WORDS)
            table = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.record_batch(
                [*batch.columns, *(pa.array(table[:, i]) for i in range(len(BASE))), pa.array(failed, pa.bool_()),
                 pa.array(far_chars, pa.float64()), pa.array(far_words, pa.float64()), pa.array(kept, pa.bool_())],
                [*kept_columns, *added],
            )

    rows = docs.select(*kept_columns)
    counts = dict.fromkeys(BASE, "long")
    verdicts = {"base_failed": "boolean", "char_distance": "double", "word_distance": "double", "kept": "boolean"}
    return rows.mapInArrow(run, with_fields(rows, **counts, **verdicts))
