"""Token ids in Arrow IPC files of fixed-size lists.

Documents are sorted (by id, unless told otherwise) over range partitions; each task encodes its texts, ends
every document with the end id, and cuts its stream into sequences of equal length. A
file holds record batches of two columns: ``ids``, a fixed-size list of unsigned ids, and
``mask``, a fixed-size list of booleans that is false only in the padding after the
file's last document. Every sequence has a known place, so a reader maps the file and
takes sequence ``i`` without copying or decoding anything (``SequenceFile``). Documents
run on over the ends of sequences and batches, never over the end of a file.

A task needs one open batch and one Arrow batch of texts. Files are written under names
no other attempt uses; the index (one row per document: file, place, length) names only
files of finished tasks.

Null and empty texts are the end id alone. Rows with equal ids follow each other, ordered
by their text hash; null ids come first. An empty table gives no file and an empty
index. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraflow.llm.common import arrow_slices, file_system, new_file, release_memory, spread_words, store

SEQUENCE_LENGTH = 2048
# Sequences of one record batch.
BATCH_SEQUENCES = 128
# Pieces of one generation of remembered ones, and the longest that are remembered.
MEMO_WORDS, MEMO_LENGTH = 200_000, 60
# Bytes of texts that are encoded at once, and ids that one task reads back.
SLICE_BYTES, READ_IDS = 8 << 20, 1 << 25
# Lower-case letters that may be plain.
_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))

INDEX = "doc_id long, path string, shard int, place long, n_tokens long"


# The settings of a vocabulary that drops white space and never joins across
# it: NFC, white space as one blank, lower case; then letters, digits and marks apart.
DROPS_SPACES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordEncoder:
    """Ids of texts from the ids of their white-space separated pieces.

    A vocabulary with the settings ``DROPS_SPACES`` and plain added tokens (no white space
    in them, matched as they stand) gives a text the ids of its pieces one after the
    other. A batch is split at ASCII white space and each distinct piece is looked up
    once. Texts in which an added token could begin are left as they are; the others are
    put in lower case and split before marks that follow a letter, as the vocabulary does
    it, so that fewer pieces are distinct. Known pieces are held in two generations: when
    the young one is full it becomes the old one, and pieces that are used again move back
    to the young one. Plain lower-case letters need no normalizing or splitting and go
    straight to the library's model. Any other vocabulary gets whole texts.
    """

    def __init__(self, vocabulary: str, memo: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            settings = json.load(file)
        added = settings["added_tokens"]
        plain_tokens = all(
            not any(t[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")) and len(t["content"][:1].upper()) == 1 and not re.search(r"\s", t["content"])
            for t in added
        )
        self.by_words = plain_tokens and all(settings[part] == wanted for part, wanted in DROPS_SPACES.items())
        # First characters of added tokens: texts with one go to the library piece by piece.
        self.touchy = "[" + "".join(sorted({rf"\x{{{ord(c):x}}}" for t in added for c in (t["content"][0].lower(), t["content"][0].upper())})) + "]" if added else "$^"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.memo = memo
        self.plain = self._plain_letters() if self.by_words else {}
        self.only_plain = re.compile(f"[{''.join(map(chr, self.plain))}]+") if self.plain else None

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain_letters(self) -> dict[int, str]:
        """Lower-case letters as the model gets them, if they make one piece with others."""
        found = {}
        for c in _LETTERS:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")
            if self.tokenizer.normalizer.normalize_str(c) == c and len(pieces) == 1:
                found[ord(c)] = pieces[0][0][1:-1]
        return found

    def _new(self, word: str) -> bytes:
        if self.only_plain and self.only_plain.fullmatch(word):
            ids = [t.id for t in self.tokenizer.model.tokenize(word.translate(self.plain))]
        else:
            ids = self._whole(word)
        return np.array(ids, self.dtype).tobytes()

    def _known(self, words: Sequence[str]) -> list[bytes]:
        """The ids of distinct pieces as bytes, remembered or from the library."""
        if len(self.young) >= self.memo:
            self.old, self.young = self.young, {}
        young, old, found = self.young, self.old, []
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = self._new(word) if word else b""
                if len(word) <= MEMO_LENGTH:
                    young[word] = ids
            found.append(ids)
        return found

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        return spread_words(words, coded, sizes, np.frombuffer(b"".join(known), self.dtype))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the
        last one's end)."""
        if not self.by_words:
            return joined([np.array(self._whole(t.as_py()), self.dtype) for t in texts], self.dtype)
        touchy = pc.match_substring_regex(texts, self.touchy).to_numpy(zero_copy_only=False)
        if touchy.all():
            return self._by_pieces(texts)
        plain = texts.filter(pa.array(~touchy)) if touchy.any() else texts
        # A run of letters ends before a mark, wherever it stands, and case does not matter.
        apart = pc.replace_substring_regex(pc.ascii_lower(plain), r"(\pL)([.,;:!?])", r"\1 \2")
        flat, starts = self._by_pieces(apart)
        if not touchy.any():
            return flat, starts
        sides = [iter(np.split(f, s[1:-1])) for f, s in ((flat, starts), self._by_pieces(texts.filter(pa.array(touchy))))]
        return joined([next(sides[int(t)]) for t in touchy], self.dtype)

    def __call__(self, text: str | None) -> list[int]:
        return self.batch(pa.array([text or ""]))[0].tolist()


def joined(parts: Sequence[np.ndarray], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return np.concatenate([np.zeros(0, kind), *parts]), starts


@cache
def encoder(vocabulary: str) -> WordEncoder:
    """The process's encoder: what it knows serves all tasks of a worker."""
    return WordEncoder(vocabulary)


def schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([
        pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
        pa.field("mask", pa.list_(pa.bool_(), length)),
    ])


class SequenceWriter:
    """Packs ids into sequences and writes full batches as they come."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.schema = schema(length, dtype)
        self.length, self.writer = length, pa.ipc.new_file(sink, self.schema)
        self.open = np.zeros(length * BATCH_SEQUENCES, dtype)
        self.used = self.written = 0

    def _batch(self, sequences: int) -> None:
        cells = sequences * self.length
        ids = pa.FixedSizeListArray.from_arrays(pa.array(self.open[:cells]), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(cells) < self.used), self.length)
        self.writer.write_batch(pa.record_batch([ids, mask], schema=self.schema))
        self.written += cells
        self.used = 0

    def add(self, data: np.ndarray) -> int:
        """Append ids; the first one's place in the file."""
        place, done = self.written + self.used, 0
        while done < len(data):
            n = min(len(data) - done, len(self.open) - self.used)
            self.open[self.used : self.used + n] = data[done : done + n]
            self.used += n
            done += n
            if self.used == len(self.open):
                self._batch(BATCH_SEQUENCES)
        return place

    def close(self) -> None:
        if self.used:
            sequences = -(-self.used // self.length)
            self.open[self.used : sequences * self.length] = 0
            self._batch(sequences)
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file, without copies when it is mapped."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        local = system.type_name == "local"
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray] | None = None

    def _cells(self, batch: int) -> np.ndarray:
        """The ids of a batch; the last one asked for is kept open."""
        if self.held is None or self.held[0] != batch:
            self.held = (batch, self.reader.get_batch(batch).column(0).flatten().to_numpy())
        return self.held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of the file's sequence ``i``."""
        batch, row = divmod(i, BATCH_SEQUENCES)
        at = slice(row * self.length, (row + 1) * self.length)
        mask = self.reader.get_batch(batch).column(1).slice(row, 1).flatten()
        return self._cells(batch)[at], mask.to_numpy(zero_copy_only=False)

    def pieces(self, place: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``place`` on, in pieces that each lie in one batch."""
        size = self.length * BATCH_SEQUENCES
        while n > 0:
            batch, start = divmod(place, size)
            piece = self._cells(batch)[start : start + n]
            yield piece
            place, n = place + len(piece), n - len(piece)

    def close(self) -> None:
        self.source.close()


def write_sequences(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, length: int = SEQUENCE_LENGTH, order: Sequence[Column] | None = None
) -> DataFrame:
    """Encode and write all of ``docs`` (doc_id, text); the stored index. ``vocabulary``
    is a path every executor has. Documents stand in ``order``: of their ids, and of their
    texts' hashes where these are equal, unless another is given."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, shard = encoder(vocabulary), None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                uri = new_file(f"{folder}/sequences", f"shard-{shard:05d}", ".arrow")
                system, path = file_system(uri)
                sink = system.open_output_stream(path)
                out = SequenceWriter(sink, length, encode.dtype)
            places, sizes = [], []
            for texts in arrow_slices(pc.fill_null(batch.column(1), ""), SLICE_BYTES):
                flat, starts = encode.batch(texts)
                place = out.add(np.insert(flat, starts[1:], end_id))
                places.append(place + starts[:-1] + np.arange(len(texts)))
                sizes.append(np.diff(starts) + 1)
            n = batch.num_rows
            yield pa.record_batch(
                [batch.column(0), pa.array([uri] * n), pa.array([shard] * n, pa.int32()),
                 pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))],
                ["doc_id", "path", "shard", "place", "n_tokens"],
            )
        if out is not None:
            out.close()
            sink.close()
        release_memory()

    by = list(order) if order else [F.col("doc_id").cast("long"), F.xxhash64("text")]
    named = [f"_{i}" for i in range(len(by))]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(n) for c, n in zip(by, named, strict=True)])
        .repartitionByRange(*named, F.monotonically_increasing_id())
        .sortWithinPartitions(*named).select("doc_id", "text")
    )
    return store(ordered.mapInArrow(write, INDEX), f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, over all files in order. Only one
    row per file is summed up in order."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = shards.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("_base"))
    return index.join(F.broadcast(base), "shard").withColumn("start", F.col("_base") + F.col("place")).drop("_base")


def read_back(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), with every id read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            sums = []
            columns = [batch.column(c).to_pylist() for c in ("path", "place", "n_tokens")]
            for uri, place, n in zip(*columns, strict=True):
                if uri != path:
                    if file is not None:
                        file.close()
                    path, file = uri, SequenceFile(uri)
                crc = 0
                for piece in file.pieces(place, n):
                    crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if file is not None:
            file.close()

    rows = with_starts(index).select("doc_id", "start", "n_tokens", "path", "place")
    # The rows are small; what they point to decides over how many tasks they go.
    total = index.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    placed = rows.repartition(max(1, -(-total // READ_IDS)), "path").sortWithinPartitions("path", "place")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
