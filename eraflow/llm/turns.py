"""Conversations in order, cut into chunks of bounded size.

The turns of all conversations are sorted once over range partitions by conversation,
turn and a hash of what the turn says, so a conversation of any length lies on as many
partitions as it needs. Each task cuts its stream into chunks: turns of one conversation,
at most ``chunk_turns`` of them, never over the end of an Arrow batch. ``ord`` orders the
chunks of the table; within a chunk every list follows the turns' order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.llm.common import broadcast_if_small, store

CHUNK_TURNS = 1024
# Blank characters, as the contract's word pattern leaves them out.
BLANKS = " \t\n\x0b\x0c\r"


def conversation_key(conv_id: Column) -> Column:
    """A key that is never null: two null ids are one conversation."""
    return F.coalesce(F.concat(F.lit("i"), conv_id.cast("string")), F.lit("null"))


def turn_mark(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def starts_of_chunks(keys: pa.Array, chunk_turns: int) -> np.ndarray:
    """Where chunks begin in sorted keys: at each new key, and every ``chunk_turns``."""
    coded = keys.dictionary_encode().indices.to_numpy()
    runs = np.concatenate(([0], np.flatnonzero(np.diff(coded)) + 1))
    within = np.arange(len(coded)) - np.repeat(runs, np.diff(np.append(runs, len(coded))))
    return np.flatnonzero(within % chunk_turns == 0)


def chunked(rows: DataFrame, lists: Sequence[str], folder: str, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The stored chunks of ``rows`` (conv_key, conv_id, turn, mark and ``lists``): one row
    a chunk with conv_key, conv_id, ord and a list of each of ``turn``, ``mark`` and
    ``lists``. Equal turns of a conversation stand in the order of their marks."""
    order = [F.col("conv_key"), F.col("turn").asc_nulls_first(), F.col("mark")]
    listed = list(dict.fromkeys(["turn", "mark", *lists]))
    kinds = dict(rows.dtypes)
    # Turns that are equal in all of the order are alike; a random last key only spreads them.
    ordered = (
        rows.select("conv_key", "conv_id", *listed)
        .repartitionByRange(*order, F.monotonically_increasing_id())
        .sortWithinPartitions(*order)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = starts_of_chunks(batch.column("conv_key"), chunk_turns)
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_key").take(at), batch.column("conv_id").take(at),
                 pa.array(done + np.arange(len(starts), dtype=np.int64)),
                 *[pa.ListArray.from_arrays(offsets, batch.column(name)) for name in listed]],
                ["conv_key", "conv_id", "ord", *listed],
            )
            done += len(starts)

    schema = T.StructType(
        [T.StructField("conv_key", T.StringType()), rows.schema["conv_id"], T.StructField("ord", T.LongType())]
        + [T.StructField(name, T.ArrayType(T.DataType.fromDDL(kinds[name]))) for name in listed]
    )
    return store(ordered.mapInArrow(cut, schema), folder)


def cut_conversations(chunks: DataFrame, folder: str) -> DataFrame:
    """Keys of the conversations that have more than one chunk, stored."""
    found = chunks.groupBy("conv_key").agg(F.count(F.lit(1)).alias("n_chunks")).where("n_chunks > 1")
    return store(found, folder)


def split_off(chunks: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that are whole conversations, and the others."""
    keys = broadcast_if_small(cut.select("conv_key"))
    return chunks.join(keys, "conv_key", "left_anti"), chunks.join(keys, "conv_key", "left_semi")
