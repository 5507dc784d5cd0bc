"""Shared pieces: tables, working folders, files on shared storage, words, checked
broadcasts."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eraflow.session import shared_dir

# Bytes a table may have before it is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder on the storage every executor shares."""
    return f"{shared_dir(spark)}/eraflow/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet on shared storage and read it back: what follows does
    not depend on executors that were lost meanwhile."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files that no later plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder URI and the folder's path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, name: str, suffix: str) -> str:
    """URI of a file that no other attempt of the same task writes. A file of an
    attempt that failed stays unreferenced: only rows of finished tasks name files."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    return posixpath.join(folder, f"{name}-{uuid.uuid4().hex[:12]}{suffix}")


def estimated_bytes(df: DataFrame) -> int:
    """Upper estimate of the bytes of a stored table: rows counted, 16 bytes a cell and
    the measured length of strings, binaries and arrays."""
    sizes = [F.count(F.lit(1)) * (16 * len(df.columns))]
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.sum(F.octet_length(F.col(name))), F.lit(0)))
        elif kind.startswith("array"):
            sizes.append(F.coalesce(F.sum(F.size(F.col(name))), F.lit(0)) * 16)
    return int(df.select(sum(sizes[1:], sizes[0])).first()[0])


def by_shuffle(df: DataFrame) -> DataFrame:
    """Join ``df`` by shuffle, whatever size Spark takes it for: it counts files as they are
    compressed, an array as one value and what Python makes of a row as one row, so that
    it would send tables of gigabytes through the driver."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast when the measured size is within the bound; otherwise the join
    shuffles, and adaptive execution splits its hot keys."""
    if estimated_bytes(df) <= (BROADCAST_BYTES if limit is None else limit):
        return F.broadcast(df)
    return by_shuffle(df)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hidden(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns that are called like one of ``names`` (in any case) under
    new names; the function that tells a column's present name; and the one that gives
    them their names back. Operators hide what clashes with names of their own."""
    own = {name.lower() for name in names}
    new = {c: f"hidden_{uuid.uuid4().hex}" for c in df.columns if c.lower() in own}
    old = {v: k for k, v in new.items()}
    return df.withColumnsRenamed(new), lambda name: new.get(name, name), lambda out: out.withColumnsRenamed(old)


def arrow_slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of strings of about so many bytes; a longer string is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        floor = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, floor + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give back what Arrow keeps of freed buffers; workers live on between stages."""
    pa.default_memory_pool().release_unused()


def spread_words(words: pa.ListArray, coded: pa.DictionaryArray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's begin (and the last
    one's end). ``ids`` are those of the distinct ``words``, ``sizes`` of each."""
    starts = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))
    offsets = words.offsets.to_numpy()
    listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), ids)
    return listed.take(coded.indices).flatten().to_numpy(), starts[offsets - offsets[0]]


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` followed by new columns, given as name and type."""
    added = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in kinds.items()]
    return T.StructType([*df.schema.fields, *added])
