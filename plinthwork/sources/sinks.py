"""Sinks: versioned snapshots with a pointer that is added last, upserts, match logs, exports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinthwork.operators.relational import first_by, upsert


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class Superseded(RuntimeError):
    """Another version was published first."""


def publish(df: DataFrame, root: str, guard=None, after: int | None = None) -> str:
    """Write a new version and point to it once it is whole; readers see the old one until then.

    ``guard`` may look at the written table and raise: then nothing is pointed to. Pointers are numbered, and a
    number is taken by one publisher only: of two at once the second takes the next number, or with ``after``
    (the number that its table rests on) raises ``Superseded``.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    if guard:
        guard(spark.read.parquet(f"{root}/{version}"))
    fs, Path = _fs(spark, root)
    number = (max(_pointers(spark, root), default=0) if after is None else after) + 1
    while True:
        try:
            out = fs.create(Path(f"{root}/CURRENT/{number:012d}"), False)
        except Py4JJavaError:
            if not fs.exists(Path(f"{root}/CURRENT/{number:012d}")):
                raise
            if after is not None:
                raise Superseded(f"version {number} of {root} is taken") from None
            number += 1
            continue
        out.write(bytearray(version.encode()))
        out.close()
        return version


def _pointers(spark: SparkSession, root: str) -> dict[int, str]:
    """Numbered pointers, each with the name of its version; one that is still empty does not count yet."""
    fs, Path = _fs(spark, root)
    if not fs.exists(Path(f"{root}/CURRENT")):
        return {}
    files = [(str(f.getPath().getName()), f.getPath()) for f in fs.listStatus(Path(f"{root}/CURRENT")) if f.getLen() > 0]
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    out = {}
    for name, path in sorted(files, key=lambda f: f[0])[-1:]:  # the last one is all that is asked for
        stream = fs.open(path)
        out[int(name)] = bytes(read.toByteArray(stream)).decode()
        stream.close()
    return out


def current(spark: SparkSession, root: str) -> DataFrame:
    pointers = _pointers(spark, root)
    if not pointers:
        raise FileNotFoundError(f"nothing is published at {root}")
    return spark.read.parquet(f"{root}/{pointers[max(pointers)]}")


def merge(change: DataFrame, root: str, keys: list[str], newest: str, tries: int = 5) -> str:
    """Upsert into the current version as a new one; if another version comes first, again into that."""
    for _ in range(tries):
        pointers = _pointers(change.sparkSession, root)
        try:
            return publish(upsert(current(change.sparkSession, root), change, keys, newest), root, after=max(pointers, default=0))
        except Superseded:
            continue
    raise Superseded(f"{tries} versions of {root} came first")


def current_matches(log: DataFrame) -> DataFrame:
    """Latest entry of each source and system in an append-only match log, if it is active."""
    return first_by(log, ["source_system", "source_id"], [F.desc("run_id"), F.desc("entry")]).where("status = 'active'")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quoteAll=False, escape='"').csv(path)
