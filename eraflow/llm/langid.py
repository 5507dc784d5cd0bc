"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Two gated recurrent
networks read each window, one from either end, and at every byte a softmax over their
joined states gives the probabilities of the languages: each position gets a label, and
the mean over a document's positions gives the document's. States start anew in each
window, so all windows of a batch run side by side as matrix products, a text of any
length needs bounded memory, and every byte of the corpus is read.

Training is backpropagation through time with Adam in numpy, on the driver, over a
bounded sample of labelled rows (``TRAIN_DOCS`` texts per language, chosen by a hash of
the id; ``TRAIN_WINDOWS`` windows of each, spread over the text). The same rows give
the same weights.

Null texts and texts without a letter get the label ``und`` with score 0. Rows that repeat
an id are labelled each by its own text. Labels of null are never learned. Without any
labelled row every text is ``und``. Columns named like a result are replaced; all others
stay, whatever they are called. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eraflow.llm.common import arrow_slices, hidden, release_memory, with_fields

WINDOW, WIDTH = 64, 8
TRAIN_DOCS, TRAIN_WINDOWS = 400, 8
STEPS, BATCH, RATE = 200, 256, 0.03
# Windows that a task runs side by side.
SIDE_BY_SIDE = 2048
# Bytes of texts that a task takes out of an Arrow batch at once.
SLICE_BYTES = 8 << 20
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function, written over its argument."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # exp of a large number gives inf, and 1 / inf is right
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


@dataclass
class Gru:
    """One direction. ``inputs`` holds, per byte, what it adds to the update gate, the
    reset gate and the candidate state."""

    inputs: np.ndarray  # 256 x 3h
    gates: np.ndarray  # h x 2h
    state: np.ndarray  # h x h

    @classmethod
    def new(cls, rng: np.random.Generator, h: int) -> Gru:
        draw = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0] if s[0] == h else 4)).astype(np.float32)
        return cls(draw(256, 3 * h), draw(h, 2 * h), draw(h, h))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.state]

    def run(self, data: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (time x windows x h) for bytes (time x windows)."""
        h = self.state.shape[0]
        now = np.zeros((data.shape[1], h), np.float32)
        out = np.empty((*data.shape, h), np.float32)
        for t in range(len(data)):
            x = self.inputs.take(data[t], axis=0)
            g = now @ self.gates
            g += x[:, : 2 * h]
            _sigmoid(g)
            z, r = g[:, :h], g[:, h:]
            c = (r * now) @ self.state
            c += x[:, 2 * h :]
            _tanh(c)
            if trace is not None:
                trace.append((now, z, r, c))
            now = now + z * (c - now)
            out[t] = now
        return out

    def back(self, data: np.ndarray, trace: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parts, from the gradient of the states at every time."""
        h = self.state.shape[0]
        d_in, d_gates, d_state = np.zeros_like(self.inputs), np.zeros_like(self.gates), np.zeros_like(self.state)
        carry = np.zeros_like(grad[0])
        for t in range(len(data) - 1, -1, -1):
            before, z, r, c = trace[t]
            d = grad[t] + carry
            dc = d * z * (1 - c * c)
            dz = d * (c - before) * z * (1 - z)
            drh = dc @ self.state.T
            dr = drh * before * r * (1 - r)
            d_state += (r * before).T @ dc
            dg = np.concatenate([dz, dr], axis=1)
            d_gates += before.T @ dg
            carry = d * (1 - z) + drh * r + dg @ self.gates.T
            np.add.at(d_in, data[t], np.concatenate([dg, dc], axis=1))
        return [d_in, d_gates, d_state]


@dataclass
class Model:
    """Both directions and the readout of every position."""

    labels: list[str]
    forward: Gru
    backward: Gru
    readout: np.ndarray  # 2h x labels
    bias: np.ndarray
    parts: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.parts = [*self.forward.parts(), *self.backward.parts(), self.readout, self.bias]

    @classmethod
    def new(cls, labels: Sequence[str], width: int = WIDTH, seed: int = 2) -> Model:
        rng = np.random.default_rng(seed)
        out = (rng.standard_normal((2 * width, len(labels))) * 0.1).astype(np.float32)
        return cls(list(labels), Gru.new(rng, width), Gru.new(rng, width), out, np.zeros(len(labels), np.float32))

    def states(self, data: np.ndarray, traces: tuple[list, list] | None = None) -> np.ndarray:
        a, b = traces or (None, None)
        ahead = self.forward.run(data, a)
        return np.concatenate([ahead, self.backward.run(data[::-1], b)[::-1]], axis=2)

    def probabilities(self, data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For bytes (time x windows): one array of probabilities per label, and the
        number of each position's likeliest label."""
        states = self.states(data).reshape(data.size, -1)
        scores = [(states @ self.readout[:, j] + self.bias[j]).reshape(data.shape) for j in range(len(self.labels))]
        top, best = scores[0].copy(), np.zeros(data.shape, np.uint16)
        for j, score in enumerate(scores[1:], 1):
            best[score > top] = j
            np.maximum(top, score, out=top)
        total = np.zeros(data.shape, np.float32)
        for score in scores:
            score -= top
            np.exp(score, out=score)
            total += score
        for score in scores:
            score /= total
        return scores, best

    def gradients(self, data: np.ndarray, real: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over the real positions."""
        h = self.forward.state.shape[0]
        traces: tuple[list, list] = ([], [])
        states = self.states(data, traces)
        p = states @ self.readout + self.bias
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(label)), label] -= 1
        p *= (real / real.sum())[:, :, None]
        flat, grad = states.reshape(-1, 2 * h), p.reshape(-1, p.shape[2])
        d = p @ self.readout.T
        ahead = self.forward.back(data, traces[0], d[:, :, :h])
        behind = self.backward.back(data[::-1], traces[1], d[::-1, :, h:])
        return [*ahead, *behind, flat.T @ grad, grad.sum(axis=0)]


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) bytes, padded with zeros, and which of them are real."""
    n = -(-len(raw) // WINDOW)
    cells = np.zeros(n * WINDOW, np.uint8)
    cells[: len(raw)] = np.frombuffer(raw, np.uint8)
    return cells.reshape(n, WINDOW), (np.arange(n * WINDOW) < len(raw)).reshape(n, WINDOW)


def fit(samples: Sequence[tuple[str, str]], steps: int = STEPS, seed: int = 2) -> Model:
    """A model from (label, text) pairs."""
    labels = sorted({label for label, _ in samples})
    model, rng = Model.new(labels, seed=seed), np.random.default_rng(seed)
    if not samples:
        return model
    data, real, label = [], [], []
    for name, text in samples:
        cells, mask = windows_of(text.encode("utf-8", "replace"))
        chosen = np.unique(np.linspace(0, len(cells) - 1, TRAIN_WINDOWS).astype(int))
        data.append(cells[chosen])
        real.append(mask[chosen])
        label.append(np.full(len(chosen), labels.index(name)))
    data, real, label = np.concatenate(data), np.concatenate(real), np.concatenate(label)
    share = 1 / np.bincount(label, minlength=len(labels))[label]  # languages count alike
    share /= share.sum()
    first = [np.zeros_like(p) for p in model.parts]
    second = [np.zeros_like(p) for p in model.parts]
    for step in range(1, steps + 1):
        at = rng.choice(len(data), BATCH, p=share)
        grads = model.gradients(data[at].T, real[at].T.astype(np.float32), label[at])
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(model.parts, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(label, text) of at most ``TRAIN_DOCS`` rows per language, the first by a hash of
    the id; of longer texts only the windows that training reads. Ids are chosen without
    reading texts, which are then read once."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(lang).alias("_lang"), F.col(doc_id).cast("string").alias("_id"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("_h"), F.col(text).alias("_text"),
    ).where(F.col("_lang").isNotNull() & F.col("_id").isNotNull())
    langs = sorted(r[0] for r in rows.select("_lang").distinct().collect())  # a row per language
    chosen = [
        r for name in langs
        for r in rows.where(F.col("_lang") == name).select("_lang", "_id").distinct()
        .orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS).collect()
    ]
    wanted = spark.createDataFrame(chosen, "_lang string, _id string")
    part = F.length("_text") - WINDOW
    pieces = F.when(part < WINDOW * TRAIN_WINDOWS, F.col("_text")).otherwise(F.concat(*[
        F.substring(F.col("_text"), (part * i / (TRAIN_WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)
    ]))
    found = rows.where(F.col("_text").rlike(r"\p{L}")).join(F.broadcast(wanted), ["_lang", "_id"])
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))  # ids can repeat
    found = found.select("_lang", "_h", pieces.alias("_text")).withColumn("_place", place).where(F.col("_place") <= TRAIN_DOCS)
    return [(r["_lang"], r["_text"]) for r in found.orderBy("_lang", "_place").collect()]


def _pools(model: Model, texts: Sequence[bytes]) -> np.ndarray:
    """Per text, the sums over its positions of the labels' probabilities, and after
    them how many positions have each label."""
    k = len(model.labels)
    sums = np.zeros((len(texts), 2 * k))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not size:
            return
        data, real, of = (np.concatenate(x) for x in zip(*held, strict=True))
        chances, best = model.probabilities(np.ascontiguousarray(data.T))
        mask = np.ascontiguousarray(real.T)
        for j, chance in enumerate(chances):
            sums[:, j] += np.bincount(of, (chance * mask).sum(axis=0), len(texts))
            sums[:, k + j] += np.bincount(of, ((best == j) & mask).sum(axis=0), len(texts))
        held.clear()
        size = 0

    for i, raw in enumerate(texts):
        for at in range(0, len(raw), WINDOW * SIDE_BY_SIDE):
            cells, mask = windows_of(raw[at : at + WINDOW * SIDE_BY_SIDE])
            held.append((cells, mask, np.full(len(cells), i)))
            size += len(cells)
            if size >= SIDE_BY_SIDE:
                flush()
    flush()
    return sums


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the pooled probability of that label) and
    lang_positions (positions labelled with each label, in the order of the model's
    labels). Columns of these names are replaced."""
    docs, now, back = hidden(docs, ["_letters"])
    text, added = now(text), ["lang_pred", "score", "lang_positions"]
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*kept).withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    k = len(model.labels)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, counts = [], [], []
            letters = iter(batch.column(len(kept)).to_pylist())
            for some in arrow_slices(batch.column(kept.index(text)).cast(pa.binary()), SLICE_BYTES):
                raw = [x.as_py() if next(letters) and k else b"" for x in some]
                for row, x in zip(_pools(model, raw), raw, strict=True):
                    if x:
                        best = int(row[:k].argmax())
                        names.append(model.labels[best])
                        scores.append(min(1.0, float(row[best] / len(x))))
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    counts.append([int(c) for c in row[k:]])
            yield pa.record_batch(
                [*batch.columns[: len(kept)], pa.array(names), pa.array(scores, pa.float64()), pa.array(counts, pa.list_(pa.int64()))],
                [*kept, *added],
            )
        release_memory()

    out = with_fields(docs.select(*kept), lang_pred="string", score="double", lang_positions="array<bigint>")
    return back(source.mapInArrow(label, out))


def label_positions(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_bytes, lang): runs of neighbouring bytes with the same label."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col(text).rlike(r"\p{L}"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(1).cast(pa.binary())):
                raw = x.as_py()
                for at in range(0, len(raw), WINDOW * SIDE_BY_SIDE):
                    cells, mask = windows_of(raw[at : at + WINDOW * SIDE_BY_SIDE])
                    best = model.probabilities(np.ascontiguousarray(cells.T))[1].T[mask]
                    edge = np.flatnonzero(np.diff(best.astype(np.int32), prepend=-1))
                    sizes = np.diff(np.append(edge, len(best)))
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(np.full(len(edge), i))), pa.array(edge + at, pa.int64()),
                         pa.array(sizes, pa.int64()), pa.array([model.labels[j] for j in best[edge]])],
                        ["doc_id", "start", "n_bytes", "lang"],
                    )

    return rows.mapInArrow(runs, "doc_id long, start long, n_bytes long, lang string")
