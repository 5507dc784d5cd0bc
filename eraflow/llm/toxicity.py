"""Toxicity by multiple-instance learning.

Only documents are labelled, but a toxic document is one with a toxic sentence. Each
sentence gets a logistic score from its words, and the scores of a document are combined
by noisy-or: the document is clean if all its sentences are, p = 1 - prod(1 - p_s). The
weights are fitted on document labels through that formula, so the sentences that explain
the labels get the blame; ``offending`` then locates them.

Sentences end at ``.``, ``!``, ``?`` or a line end (and, beyond 1 MiB, between words).
Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. A
sentence has as features its distinct words and their beginnings of ``PREFIXES`` bytes
(compounds share them), hashed to ``FEATURES`` weights. The fit uses at most ``TRAIN_DOCS`` labelled rows, the
first by a hash of the id, each with at most ``TRAIN_CHARS`` characters (longer ones are
not used for the fit); scoring reads every word of every text.

Null and empty texts, and texts without words, have no sentence and score 0. A document
labelled twice counts as toxic if one label says so; null labels are not learned. Rows
that repeat an id are scored each by its own text. Without labelled rows of both kinds
every score is 0. Columns named like a result are replaced. An empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import with_fields
from eraflow.llm.shingles import MARKS, hashed_words, mix, pieces, to_bytes

FEATURES, PREFIXES = 1 << 18, (4, 5, 6, 8)
TRAIN_DOCS, TRAIN_CHARS = 6000, 20000
STEPS, RATE, PENALTY = 200, 0.1, 1e-5
# A feature gets a weight if it is in so many documents, and in toxic ones by so many
# standard deviations more often than chance; else the fit would learn its documents by heart.
MIN_DOCS, MIN_DEVIATION = 3, 4.0

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a text: the features of its sentences one after the other, the
    place of each sentence's first feature, and the byte at which it starts in the text."""
    base, kinds = 0, 1 + len(PREFIXES)
    for part in pieces(data, MARKS):
        hashes, start, _ = hashed_words(part, MARKS, prefixes=PREFIXES)
        if len(start):
            number = np.cumsum(_ENDS[part])[start]
            begin = start[np.flatnonzero(np.diff(number, prepend=-1))]
            _, once = np.unique(mix(hashes[0] + number.astype(np.uint64)), return_index=True)
            once.sort()
            first = np.flatnonzero(np.diff(number[once], prepend=-1)) * kinds
            yield (hashes[:, once].T.ravel() >> np.uint64(46)).astype(np.int32), first, base + begin
        base += len(part)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The linear score of every sentence."""
        return np.add.reduceat(self.weights[words], first) + self.bias

    def document(self, text: str | bytes | None) -> float:
        total = 0.0
        for words, first, _ in sentences(to_bytes(text)):
            total += float(np.logaddexp(0, self.scores(words, first)).sum())
        return float(-np.expm1(-total))


NOTHING = Model(np.zeros(FEATURES, np.float32), -np.inf)


def fit(rows: Sequence[tuple[int, str]]) -> Model:
    """A model from (label, text) pairs, by Adam on the documents' cross entropy."""
    # one pass to choose the features, one to keep only those: a text's other features
    # are never held together with those of other texts
    n, toxic, n_docs, n_toxic = np.zeros(FEATURES), np.zeros(FEATURES), 0, 0
    for label, text in rows:
        parts = [words for words, _, _ in sentences(to_bytes(text))]
        if parts:
            seen = np.unique(np.concatenate(parts))
            n[seen] += 1
            toxic[seen] += label
            n_docs, n_toxic = n_docs + 1, n_toxic + label
    if not 0 < n_toxic < n_docs:
        return NOTHING
    usual = n_toxic / n_docs
    used = (n >= MIN_DOCS) & (toxic - n * usual >= MIN_DEVIATION * np.sqrt(n * usual * (1 - usual)))
    at, sentence, docs, labels, size = [], [], [], [], 0
    for label, text in rows:
        found = False
        for words, first, _ in sentences(to_bytes(text)):
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words)))) + size
            at.append(words[used[words]])
            sentence.append(number[used[words]].astype(np.int32))
            docs.append(np.full(len(first), len(labels), np.int32))
            size += len(first)
            found = True
        if found:
            labels.append(label)
    at, sentence, docs, y = np.concatenate(at), np.concatenate(sentence), np.concatenate(docs), np.array(labels, float)
    w, bias = np.zeros(FEATURES), -6.0
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for step in range(1, STEPS + 1):
        score = np.bincount(sentence, w[at], size) + bias
        total = np.bincount(docs, np.logaddexp(0, score), len(y))
        outer = ((1 - y) - y / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6)) / len(y)
        inner = outer[docs] / (1 + np.exp(-np.clip(score, -50, 50)))
        g = np.bincount(at, inner[sentence], FEATURES) + PENALTY * w
        gb = inner.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * used
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(w.astype(np.float32), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str]]:
    """(label, text) of at most ``TRAIN_DOCS`` labelled rows."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_y"))
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(TRAIN_DOCS)
    )
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= TRAIN_CHARS)
    found = rows.join(F.broadcast(known), "_id").orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_text").limit(TRAIN_DOCS)
    return [(r["_y"], r["_text"]) for r in found.select("_y", "_text").collect()]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with column toxicity, replaced if it is there."""
    kept = [c for c in docs.columns if c != "toxicity"]
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.document(x.as_py()) for x in batch.column(place).cast(pa.binary())]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], [*kept, "toxicity"])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, with_fields(rows, toxicity="double"))


def offending(docs: DataFrame, model: Model, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, sentence, score): the sentences that score ``least`` or more, with
    the byte at which their first word starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, cell in enumerate(batch.column(1).cast(pa.binary())):
                raw = cell.as_py() or b""
                data = to_bytes(raw)
                for words, first, at in sentences(data):
                    p = 1 / (1 + np.exp(-model.scores(words, first)))
                    for j in np.flatnonzero(p >= least):
                        start = int(at[j])
                        ends = np.flatnonzero(_ENDS[data[start : start + (1 << 20)]])
                        end = start + int(ends[0]) + 1 if len(ends) else min(len(raw), start + (1 << 20))
                        out.append((i, start, raw[start:end].decode("utf-8", "replace"), float(p[j])))
            which, starts, texts, scores = zip(*out, strict=True) if out else ((), (), (), ())
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.record_batch(
                [ids, pa.array(starts, pa.int64()), pa.array(texts, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "start", "sentence", "score"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, sentence string, score double")
