"""Members of ZIP packages and of packages within them, with the checks that make an archive safe to read.

A package is never a row: Spark lists the files, one step reads their central directories by ranges, and a second one,
dealt by member, reads each member's bytes where they stand. So memory does not grow with a package, a large package is read by many
tasks, and one with a broken member loses nothing else.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.operators.inventory import legacy_signature, member_category
from quarrylight.session import for_workers
from quarrylight.sources.archives import STORED, Damaged, Member, Part, data_start, directory, ends, opened, pieces

MEMBER = "package string, name string, size long, compressed long, sha256 string, problem string"
#: A member, and where it stands.
PLACED = "package string, name string, flags int, method int, crc long, compressed long, size long, attributes long, header long, problem string"
# What an archive may have: members, bytes when expanded, and expansion of a member of a size and more.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO, RATIO_FROM = 100_000, 8 << 30, 500, 1 << 20
#: A package that lies deflated within another is opened up to this size, as it is inflated whole; one that is stored is read in place.
MOST_NESTED = 256 << 20
#: Bytes of members, about, for a task.
TASK_BYTES = 128 << 20


def problem(info: Member, seen: set[str]) -> str | None:
    parts = info.filename.replace("\\", "/").split("/")
    if info.filename.startswith("/") or ".." in parts or "\0" in info.filename:
        return "unsafe-name"
    if info.filename in seen:
        return "duplicate"
    if info.flag_bits & 1:
        return "encrypted"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "symlink"
    if info.file_size > RATIO_FROM and info.file_size > MOST_RATIO * max(1, info.compress_size):
        return "ratio"
    return None


def listed(file) -> Iterator[tuple[Member | None, str | None]]:
    """The members of an archive that are no folders, each with its problem; no member and a problem if it is damaged or too large."""
    seen: set[str] = set()
    try:
        end = ends(file)
        some = list(directory(file, end)) if end.members <= MOST_MEMBERS else None
    except (Damaged, OSError):
        yield None, "damaged"
        return
    if some is None or len(some) > MOST_MEMBERS or sum(m.file_size for m in some) > MOST_BYTES:
        yield None, "too-large"
        return
    for m in some:
        if not m.filename.endswith("/"):
            yield m, problem(m, seen)
            seen.add(m.filename)


def read(package: str, file, m: Member) -> Iterator[tuple]:
    """Rows of MEMBER: the member's, with its digest, and if it is a package those of its own members."""
    inner, apk = f"{package}!/{m.filename}", m.filename.lower().endswith(".apk") and "!/" not in package
    held = io.BytesIO() if apk and m.method != STORED and m.file_size <= MOST_NESTED else None
    digest = hashlib.sha256()
    try:
        for piece in pieces(file, m):
            digest.update(piece)
            if held is not None:
                held.write(piece)
    except Damaged:
        yield package, m.filename, m.file_size, m.compress_size, None, "checksum"
        return
    yield package, m.filename, m.file_size, m.compress_size, digest.hexdigest(), None
    if not apk:
        return
    if held is None and m.method != STORED:
        yield inner, None, None, None, None, "too-large"
        return
    within = held if held is not None else Part(file, data_start(file, m), m.file_size)
    for x, wrong in listed(within):
        if x is None or wrong:
            yield (inner, *((x.filename, x.file_size, x.compress_size) if x else (None,) * 3), None, wrong)
        else:
            yield from read(inner, within, x)


def _batches(rows: Iterator[tuple], schema: str, size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    kind, some = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], names=kind.names)

    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield out()
            some = []
    if some:
        yield out()


def placed(spark: SparkSession, path: str) -> DataFrame:
    """A row of PLACED for each member of every package below path; no name and a problem for a package that cannot be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with opened(name) as file:
                        for m, wrong in listed(file):
                            told = (m.filename, m.flag_bits, m.method, m.crc, m.compress_size, m.file_size, m.external_attr, m.header) if m else (None,) * 8
                            yield (name, *told, wrong)

        yield from _batches(rows(), PLACED)

    files = for_workers(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(run, PLACED)


def members(spark: SparkSession, path: str) -> DataFrame:
    """A row of MEMBER, with its category, for each member of every package below path and of packages within these
    (package: outer!/inner). A member with a problem is listed and not read; an archive that cannot be opened, or is too large, is one
    row with a problem. An archive without members gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            file, name = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["problem"]:
                        yield r["package"], r["name"], r["size"], r["compressed"], None, r["problem"]
                        continue
                    if r["package"] != name:
                        if file is not None:
                            file.close()
                        file, name = opened(r["package"]), r["package"]
                    m = Member(r["name"], r["flags"], r["method"], r["crc"], r["compressed"], r["size"], r["attributes"], r["header"])
                    yield from read(name, file, m)
            if file is not None:
                file.close()

        yield from _batches(rows(), MEMBER)

    found = placed(spark, path)
    total = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    # neighbours in a package stay together; a large package is dealt to several tasks
    dealt = found.repartition(tasks, "package", F.floor(F.col("header") / TASK_BYTES)).sortWithinPartitions("package", "header")
    category = F.coalesce(
        member_category(F.col("name")),
        F.when(legacy_signature(F.col("name")), "signature"),
        F.when(F.endswith(F.lower("name"), F.lit(".apk")), "package"),
    )
    return dealt.mapInArrow(run, MEMBER).withColumn("category", category)


def bundles(rows: DataFrame) -> DataFrame:
    """members' rows as (bundle, name, has_dex, size, sha256) of the packages that each outer package holds, for inventory.base_packages."""
    outer = F.substring_index("package", "!/", 1)
    inside = rows.where(F.contains("package", F.lit("!/"))).groupBy(
        outer.alias("bundle"), F.substring_index("package", "!/", -1).alias("name")
    )
    code = inside.agg(F.coalesce(F.bool_or(F.col("category") == "dex"), F.lit(False)).alias("has_dex"))
    own = rows.where("category = 'package' and problem is null").select(
        F.col("package").alias("bundle"), "name", "size", "sha256"
    )
    return own.join(code, ["bundle", "name"], "left").withColumn("has_dex", F.coalesce("has_dex", F.lit(False)))
