"""Tables that are published as a whole.

Every version of a table is a folder of its own; a small manifest, written last and under a
name that no other version has, says which folder is current. Readers take the highest
manifest, so they see the former version until the new one is complete, and a job that
fails half-way leaves a folder nobody names. Publishing a version again changes nothing,
which makes a repeated streaming batch harmless.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Versions whose folders stay for readers that began before.
KEPT = 2
_MANIFEST = re.compile(r"^version-(\d{19})\.json$")


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    system, folder = _files(spark, f"{root}/_manifests")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(found[1]) for found in map(_MANIFEST.match, names) if found)


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    system, path = _files(spark, f"{root}/_manifests/version-{version:019d}.json")
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _name(spark: SparkSession, root: str, version: int, text: str) -> None:
    """Write a manifest aside and give it its name in one step."""
    system, aside = _files(spark, f"{root}/_manifests/.new-{uuid.uuid4().hex}")
    stream = system.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    _, path = _files(spark, f"{root}/_manifests/version-{version:019d}.json")
    if not system.rename(aside, path):
        system.delete(aside, False)
        if not system.exists(path):
            raise OSError(f"manifest {version} of {root} could not be written")


def write_folder(df: DataFrame, root: str, version: int) -> str:
    """The rows of a version in a folder that no manifest names yet."""
    folder = f"data-{version:019d}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def publish(df: DataFrame, root: str, version: int | None = None, kept: int = KEPT) -> int:
    """Make ``df`` the current version of the table at ``root``; the version's number. A
    version that is there already stays as it is, and one below the current one does not
    become current. Folders older than the last ``kept`` versions are deleted."""
    spark = df.sparkSession
    known = versions(spark, root)
    version = (known[-1] + 1 if known else 0) if version is None else version
    if version in known:
        return version
    folder = write_folder(df, root, version)
    _name(spark, root, version, json.dumps({"folder": folder, "schema": json.loads(df.schema.json())}))
    for old in [v for v in known if v < version][: -(kept - 1) or None]:
        gone = _manifest(spark, root, old)["folder"]
        for path in (f"{root}/_manifests/version-{old:019d}.json", f"{root}/{gone}"):
            system, at = _files(spark, path)
            system.delete(at, True)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table as it was last published."""
    known = versions(spark, root)
    if not known:
        raise ValueError(f"nothing is published at {root}")
    from pyspark.sql.types import StructType

    found = _manifest(spark, root, known[-1])
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{root}/{found['folder']}")
