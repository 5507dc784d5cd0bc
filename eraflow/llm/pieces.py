"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text becomes one chain of symbols, a code point each, behind a leading space mark. All
adjacent pairs whose union is a piece wait in an agenda ordered by the piece's score, then
by place; the best is taken, its two symbols become one, and the pairs this creates with
the neighbours join the agenda. An entry whose symbols have changed since is passed over.
What no piece covers at the end is written as its UTF-8 bytes (``PieceModel.merge``).

Merges never cross two code points that stand side by side in no piece, so a text is cut
there first, by the vocabulary's own pairs, and the parts that come often are remembered
in two generations of bounded size. Decoding joins the pieces' bytes.

In every Arrow batch what was merged for the first time, words and texts that are not split,
is held against the sentencepiece library; other ids raise ValueError (``verify=False``
leaves that out).

Supported are merge-type models with byte pieces whose normalizer only marks spaces; any
other raises ValueError. Nulls encode as the empty text: no ids, decoded to the empty text.
A very long text is one chain whose cost is n log n; a task holds one Arrow batch and its
ids. Equal rows give equal rows, each with its own answer; order and ties play no part. An empty
table gives an empty table. Columns of the input named like a result are replaced, others
stay.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from eraflow.llm.common import arrow_slices, release_memory, spread_words, with_fields

SPACE = "▁"
# Parts of one generation of remembered ones, and the longest (code points) that are kept.
MEMO_PARTS, MEMO_LENGTH = 400_000, 40
# Code points up to which a chain's agenda is a row instead of a heap.
SHORT = 24
# Bytes of texts that are encoded, decoded and checked at once.
SLICE_BYTES = 16 << 20

ENCODED = {"ids": "array<int>", "decoded": "string"}
DIGESTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}

# A byte that continues nothing stands for one replacement mark, as in the library.
codecs.register_error("eraflow-byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """One vocabulary: ``encode`` and ``decode`` by its pieces' scores."""

    def __init__(self, path: str, memo: int = MEMO_PARTS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = proto.ModelProto.FromString(file.read())
        marks, trained = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        kind = proto.ModelProto.SentencePiece
        if (
            trained.model_type != proto.TrainerSpec.BPE or not trained.byte_fallback
            or trained.treat_whitespace_as_suffix or marks.precompiled_charsmap
            or marks.remove_extra_whitespaces or not marks.escape_whitespaces
            or kinds & {kind.USER_DEFINED, kind.UNUSED} or spec.denormalizer_spec.precompiled_charsmap
        ):
            raise ValueError(f"not a plain merge-type vocabulary with byte pieces: {path}")
        self.prefix = SPACE if marks.add_dummy_prefix else ""
        normal = {i: p for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in normal.items()}
        self.scores = {p.piece: -p.score for p in normal.values()}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.surfaces = [b""] * len(spec.pieces)
        for i, p in normal.items():
            self.surfaces[i] = p.piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.surfaces[i] = bytes([byte])
        for i, p in enumerate(spec.pieces):
            if p.type == kind.UNKNOWN:
                self.surfaces[i] = trained.unk_surface.encode()
        self.marked = {i for i, p in normal.items() if p.piece.startswith(SPACE)}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kind.CONTROL}
        self.name_array = pa.array([str(i) for i in range(len(spec.pieces))])
        self.surface_array = pa.array(self.surfaces, pa.binary())
        self.pairs = {p.piece[k : k + 2] for p in normal.values() for k in range(len(p.piece) - 1)}
        # Whether a new word starts at every space mark that follows something else.
        self.by_words = all(pair[0] == SPACE or pair[1] != SPACE for pair in self.pairs)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.memo = memo

    def _row_agenda(self, part: str) -> list[str]:
        """Symbols of a short chain: the agenda is the row of its pairs' scores, whose
        least (the first of equals) is the next to merge."""
        score, symbols = self.scores.get, list(part)
        row = [score(part[i : i + 2], _NEVER) for i in range(len(part) - 1)]
        while row:
            best = min(row)
            if best == _NEVER:
                break
            i = row.index(best)
            symbols[i] += symbols.pop(i + 1)
            del row[i]
            if i < len(row):
                row[i] = score(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                row[i - 1] = score(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _heap_agenda(self, part: str) -> list[str]:
        """Symbols of a chain of any length: the agenda is a heap of (score, place)."""
        scores = self.scores
        symbols: list[str] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [
            (scores[both], i, i + 1, both) for i in range(n - 1) if (both := part[i : i + 2]) in scores
        ]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != len(both):
                continue
            symbols[i], symbols[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (wider := both + symbols[k]) in scores:
                    heapq.heappush(agenda, (scores[wider], i, k, wider))
            if (h := before[i]) >= 0 and (wider := symbols[h] + both) in scores:
                heapq.heappush(agenda, (scores[wider], h, i, wider))
        return [symbol for symbol in symbols if symbol]

    def merge(self, part: str) -> list[int]:
        """The ids of one chain of symbols, by the agenda of its adjacent pairs."""
        found: list[int] = []
        for symbol in (self._row_agenda if len(part) <= SHORT else self._heap_agenda)(part):
            known = self.ids.get(symbol)
            if known is None:
                found += [self.byte_ids[b] for b in symbol.encode()]
            else:
                found.append(known)
        return found

    def _cut(self, chain: str) -> list[str]:
        """``chain`` cut between code points that are adjacent in no piece."""
        pairs = self.pairs
        at = [k for k in range(1, len(chain)) if chain[k - 1 : k + 1] not in pairs]
        return [chain[a:b] for a, b in zip([0, *at], [*at, len(chain)], strict=True)]

    def _keep(self, part: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(part) <= MEMO_LENGTH:
            if len(self.young) >= self.memo:
                self.old, self.young = self.young, {}
            self.young[part] = ids
        return ids

    def _new(self, chain: str) -> tuple[int, ...]:
        found = self.old.get(chain)
        if found is None:
            if chain[1:].isalpha():
                found = tuple(self.merge(chain))
            else:
                whole: list[int] = []
                for part in self._cut(chain):
                    known = self.young.get(part) or self.old.get(part)
                    whole += known or self._keep(part, tuple(self.merge(part)))
                found = tuple(whole)
        return self._keep(chain, found)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end."""
        if not text:
            return []
        chain = self.prefix + text.replace(" ", SPACE)
        words = _WORDS.findall(chain) if self.by_words else [chain]
        ids: list[int] = []
        get, new = self.young.get, self._new
        for word in words:
            found = get(word)
            if found is None:
                found = new(word)
                get = self.young.get
            ids += found
        return ids

    def encode_batch(self, texts: pa.Array, verify: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the
        last one's end). A text without runs of spaces is split at its spaces; each
        distinct word of the batch is encoded once. ``verify`` holds all that was merged
        here against the library: new words, and texts that are not split."""
        odd = self._odd(texts)
        if not odd.any():
            return self._by_words(texts, verify)
        chains = texts.filter(pa.array(odd)).to_pylist()
        coded = [self.encode(text) for text in chains]
        if verify:
            self.check(chains, coded)
        whole = iter(coded)
        flat, starts = self._by_words(texts.filter(pa.array(~odd)), verify)
        plain = iter(np.split(flat, starts[1:-1]))
        return _joined([np.array(next(whole), np.int32) if is_odd else next(plain) for is_odd in odd])

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts whose space marks do not stand one by one between words (or no text)."""
        if not (self.by_words and self.prefix):
            return np.ones(len(texts), bool)
        found = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        found = pc.or_(found, pc.or_(pc.match_substring(texts, SPACE), pc.equal(texts, "")))
        return found.to_numpy(zero_copy_only=False)

    def _by_words(self, texts: pa.Array, verify: bool) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        get, new, prefix = self.young.get, self._new, self.prefix
        known: list[tuple[int, ...]] = []
        fresh: list[str] = []
        fresh_ids: list[tuple[int, ...]] = []
        for word in coded.dictionary.to_pylist():
            marked = prefix + word
            found = get(marked)
            if found is None:
                merged = marked not in self.old
                found = new(marked)
                get = self.young.get
                if merged and word:
                    fresh.append(word)
                    fresh_ids.append(found)
            known.append(found)
        if verify:
            self.check(fresh, fresh_ids)  # alone, a word stands behind a space mark too
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        return spread_words(words, coded, sizes, np.fromiter(chain.from_iterable(known), np.int32, int(sizes.sum())))

    def _cleaned(self, raw: bytes, first: int | None) -> bytes:
        """Bytes of decoded ids without the first mark, wrong ones replaced."""
        if self.prefix and first in self.marked:
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="eraflow-byte").encode()
        return raw

    def decode_batch(self, flat: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The texts (UTF-8) of many sequences of ids."""
        joined = pc.binary_join(_lists(self.surface_array.take(pa.array(flat)), starts), pa.scalar(b"", pa.binary()))
        firsts = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            while a < b and int(flat[a]) in self.control:
                a += 1
            firsts.append(int(flat[a]) if a < b else None)
        return [self._cleaned(raw.as_py(), first) for raw, first in zip(joined, firsts, strict=True)]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: bytes joined, the mark before the first piece dropped."""
        flat = np.array(ids, np.int32)
        return self.decode_batch(flat, np.array([0, len(flat)]))[0].decode()

    def written(self, flat: np.ndarray, starts: np.ndarray) -> list[str]:
        """Each sequence in decimal, joined by commas."""
        return pc.binary_join(_lists(self.name_array.take(pa.array(flat)), starts), ",").to_pylist()

    def check(self, texts: list[str], ids: Sequence[Sequence[int]]) -> None:
        """Raise ValueError unless the library gives the same ids."""
        for text, mine, want in zip(texts, ids, self.library.encode(texts, num_threads=1), strict=True):
            if list(mine) != want:
                raise ValueError(f"the library gives other ids: {text[:200]!r}")


_NEVER = float("inf")
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return np.concatenate([np.zeros(0, np.int32), *parts]), starts


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


@cache
def piece_model(path: str) -> PieceModel:
    """The process's model: what it remembers serves all tasks of a worker."""
    return PieceModel(path)


def _with(docs: DataFrame, vocabulary: str, verify: bool, kinds: dict[str, str], columns) -> DataFrame:
    """``docs`` with the columns ``columns(model, flat, starts)`` gives."""
    docs = docs.drop(*kinds)
    at = docs.columns.index("text")
    arrow = [_ARROW[kind] for kind in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary)
        for batch in batches:
            done: list[list] = [[] for _ in kinds]
            for some in arrow_slices(pc.fill_null(batch.column(at).cast(pa.string()), ""), SLICE_BYTES):
                flat, starts = model.encode_batch(some, verify)
                for column, new in zip(done, columns(model, flat, starts), strict=True):
                    column += new
            added = [pa.array(c, t) for c, t in zip(done, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *kinds])
        release_memory()

    return docs.mapInArrow(run, with_fields(docs, **kinds))


_ARROW = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}


def encode_texts(docs: DataFrame, vocabulary: str, verify: bool = True) -> DataFrame:
    """``docs`` with ids and the text they decode to. ``vocabulary`` is a path every
    executor has."""

    def both(model: PieceModel, flat: np.ndarray, starts: np.ndarray):
        return np.split(flat, starts[1:-1]), [text.decode() for text in model.decode_batch(flat, starts)]

    return _with(docs, vocabulary, verify, ENCODED, both)


def digest_texts(docs: DataFrame, vocabulary: str, verify: bool = True) -> DataFrame:
    """Like ``encode_texts``, with the number of ids and digests in place of ids (decimal,
    joined by commas) and decoded text (UTF-8)."""

    def digests(model: PieceModel, flat: np.ndarray, starts: np.ndarray):
        sha = hashlib.sha256
        return (
            np.diff(starts).tolist(),
            [sha(ids.encode()).hexdigest() for ids in model.written(flat, starts)],
            [sha(text).hexdigest() for text in model.decode_batch(flat, starts)],
        )

    return _with(docs, vocabulary, verify, DIGESTS, digests)
