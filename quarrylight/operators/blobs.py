"""A content-addressed store of files: each content once under its SHA-256, copied by Spark's tasks.

A task copies a file to a staging name and digests it on the way, in pieces; only a whole copy gets its final name, by a rename. So a
killed or repeated task leaves at most a staging file, never half a blob, and two tasks with one content leave one blob. What
is there already is digested again before it counts as known.
"""

from __future__ import annotations

import hashlib
import mimetypes
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.operators.inventory import stored_path
from quarrylight.session import filesystem, for_workers

BLOB = "project_id string, source string, name string, sha256 string, size long, media_type string, stored_path string, state string"
CHECKED = "stored_path string, sha256 string, size long, state string"
STAGING, PIECE = ".staging", 1 << 20
# Fixed value: what the name of a project is made of.
PROJECT = re.compile("[A-Za-z0-9_-]+")


def _pieces(where, path: str) -> Iterator[bytes]:
    with where.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            yield piece


def _digest(where, path: str) -> tuple[str, int]:
    h, n = hashlib.sha256(), 0
    for piece in _pieces(where, path):
        h.update(piece)
        n += len(piece)
    return h.hexdigest(), n


def _is_file(where, path: str) -> bool:
    from pyarrow import fs

    return where.get_file_info(path).type == fs.FileType.File


def place(root: str, project: str, source: str) -> tuple[str, int, str]:
    """Stores one file below root: (sha256, size, state). state: new, known, or damaged, if what is there has other content."""
    (there, path), (where, base) = filesystem(source), filesystem(root)
    staging = f"{base}/{STAGING}/{uuid.uuid4().hex}"
    where.create_dir(posixpath.dirname(staging), recursive=True)
    h, n = hashlib.sha256(), 0
    try:
        with where.open_output_stream(staging) as out:
            for piece in _pieces(there, path):
                h.update(piece)
                n += len(piece)
                out.write(piece)
        sha = h.hexdigest()
        target = f"{base}/{project}/{sha[:2]}/{sha}/blob"
        if _is_file(where, target):
            return sha, n, "known" if _digest(where, target) == (sha, n) else "damaged"
        where.create_dir(posixpath.dirname(target), recursive=True)
        where.move(staging, target)
        return sha, n, "new"
    finally:
        if _is_file(where, staging):
            where.delete_file(staging)


def import_files(files: DataFrame, root: str) -> DataFrame:
    """Stores files (project_id, path) below root; a row of BLOB for each. Running it again changes nothing and gives known; write what it
    gives, as each action runs the copies again.

    state: new, known (both may be told of one content in one run, but there is one blob), damaged (what is stored has other
    content and stays), missing (no such file), or refused (the project's name has other characters than letters, digits, _ and -).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = posixpath.basename(source or "")
                if project is None or not PROJECT.fullmatch(project):
                    rows.append((project, source, name, None, None, None, "refused"))
                    continue
                try:
                    sha, size, state = place(root, project, source or "/")
                except (FileNotFoundError, IsADirectoryError, OSError) as e:
                    if isinstance(e, FileNotFoundError) or not source or not _is_file(*filesystem(source)):
                        rows.append((project, source, name, None, None, None, "missing"))
                        continue
                    raise
                rows.append((project, source, name, sha, size, mimetypes.guess_type(name)[0] or "application/octet-stream", state))
            kinds = (*[pa.string()] * 4, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 7, kinds)],
                names=["project_id", "source", "name", "sha256", "size", "media_type", "state"],
            )

    for_workers(files.sparkSession)
    done = files.select(F.col("project_id").cast("string"), F.col("path").cast("string")).mapInArrow(
        run, "project_id string, source string, name string, sha256 string, size long, media_type string, state string"
    )
    where = F.when(F.col("sha256").isNotNull(), stored_path(F.col("project_id"), F.col("sha256")))
    return done.select("project_id", "source", "name", "sha256", "size", "media_type", where.alias("stored_path"), "state")


def check(spark: SparkSession, root: str) -> DataFrame:
    """A row of CHECKED for each blob below root, digested anew: ok, or damaged if its content is not what its place says. Spark lists
    no file without a byte, so the blob of the empty content has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                where, inside = filesystem(path)
                sha, size = _digest(where, inside)
                rows.append(("/".join(inside.split("/")[-4:]), sha, size, "ok" if sha == inside.split("/")[-2] else "damaged"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 4, (pa.string(), pa.string(), pa.int64(), pa.string()))],
                names=[c.split()[0] for c in CHECKED.split(", ")],
            )

    files = for_workers(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "blob").load(root)
    return files.select("path").repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, CHECKED)


def import_packages(spark: SparkSession, inspected: DataFrame, path: str, root: str) -> DataFrame:
    """Packages as they were inspected (project_id, path, size, sha256), stored below root: adds state: imported; changed, if what
    was stored has another size or digest than at the inspection; or what import_files says otherwise. path: a new folder for its rows."""
    import_files(inspected.select("project_id", "path").distinct(), root).write.parquet(path)
    now = spark.read.parquet(path).select(
        "project_id", F.col("source").alias("path"), F.col("sha256").alias("_sha"), F.col("size").alias("_size"), F.col("state").alias("_state")
    )
    met = inspected.join(now, ["project_id", "path"], "left")
    same = (F.col("_sha") == F.col("sha256")) & (F.col("_size") == F.col("size"))
    state = F.when(F.col("_sha").isNull() | (F.col("_state") == "damaged"), F.col("_state")).when(same, "imported").otherwise("changed")
    return met.select(*inspected.columns, state.alias("state"))
