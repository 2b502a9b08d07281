"""Several tables that change together: a log of numbered versions, each naming the folder of every table.

A writer stages new folders, which no reader knows, and publishes them by adding one file to the log; that file
appears under its number at once or not at all, and a number that another writer took is a conflict. A reader takes one version and
keeps to its folders, whatever is published meanwhile. Old versions go by `vacuum`, with the folders that only they name.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Snapshot:
    """version: -1 before the first. tables: folder of each, below the log's path. properties: what the writer says about it."""

    path: str
    version: int = -1
    tables: dict[str, str] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{self.tables[name]}")


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """All that are published and not yet vacuumed, ascending."""
    fs, to = _fs(spark, path)
    log = to(f"{path}/_log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The latest version, or the one named; an error if that is not there."""
    there = versions(spark, path)
    if version is None and not there:
        return Snapshot(path)
    number = there[-1] if version is None else version
    if number not in there:
        raise ValueError(f"version {number} is not published, or vacuumed")
    fs, to = _fs(spark, path)
    stream = fs.open(to(f"{path}/_log/{number:020d}.json"))
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Snapshot(path, number, told["tables"], told["properties"])


def stage(rows: DataFrame, path: str, name: str) -> str:
    """Writes a table's new folder; nothing reads it before it is published. Returns its name below path."""
    place = f"data/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{place}")
    return place


def publish(spark: SparkSession, base: Snapshot, tables: dict[str, str], properties: dict) -> Snapshot:
    """Makes the version after `base`: its tables with `tables` in their place. Conflict if that number is taken."""
    fs, to = _fs(spark, base.path)
    new = Snapshot(base.path, base.version + 1, base.tables | tables, properties)
    temporary = to(f"{base.path}/_log/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps({"tables": new.tables, "properties": properties}, sort_keys=True).encode()))
    finally:
        out.close()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(temporary, to(f"{base.path}/_log/{new.version:020d}.json"), never)
    except Exception as e:
        fs.delete(temporary, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"version {new.version} of {base.path} was published by another writer") from None
        raise
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 2, staged_for: float = 86_400.0) -> list[str]:
    """Removes all but the last `keep` versions and the folders that none of those left names. Folders that no version ever named are
    those of writers that failed or still write: they go when they have not changed for `staged_for` seconds. Returns what went."""
    if keep < 1:
        raise ValueError("one version stays at least")
    fs, to = _fs(spark, path)
    there = versions(spark, path)
    old = [snapshot(spark, path, v) for v in there[:-keep]]
    kept = {place for v in there[-keep:] for place in snapshot(spark, path, v).tables.values()}
    before = {place for s in old for place in s.tables.values()}
    gone = []
    for s in old:  # the log first: no version names a folder that is not there
        fs.delete(to(f"{path}/_log/{s.version:020d}.json"), False)
    if fs.exists(to(f"{path}/data")):
        for status in fs.listStatus(to(f"{path}/data")):
            place = f"data/{status.getPath().getName()}"
            idle = time.time() - status.getModificationTime() / 1000
            if place not in kept and (place in before or idle >= staged_for):
                fs.delete(status.getPath(), True)
                gone.append(place)
    return sorted(gone)
