"""What the training-data operators share: the shared folder, written tables and files in it."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Kept = TypeVar("Kept")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (with --py-files they need nothing else), and send
    them texts in batches of fewer rows, where the session does not say how many."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    # Spark's default suits short rows; these are texts, held by both sides at once
    if spark.conf.get(BATCH[0]) == "10000":
        spark.conf.set(*BATCH)
    return spark


BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], Kept]) -> Kept:
    """What a Python worker keeps between its tasks: one operator's tables at a time, so that stages do not add up."""
    if name not in _HELD:
        alone()
        _HELD[name] = make()
    return _HELD[name]


def alone() -> None:
    """Drops what another operator left in this Python worker, and gives its memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all run on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quarrylight_shared", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._quarrylight_shared = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` wrote for these. Only for tables that nothing still to be computed reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow's file system and the path in it, for a URI or a plain path."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names like these that are not among `taken` (case does not tell names apart), so that helper columns never clash."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def map_in_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name: it takes a dot in one for a field. run sees and gives the real names."""
    names, inner = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(inner)

    plain = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(inner, schema)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def least_of_most(df: DataFrame, count: str, most: int, top: int) -> int:
    """The least count that at most `most` rows reach; one more than the largest count, if more than `most` rows share that.

    Counts are binned by value up to `top`. Where more rows than `most` reach that, the range above is cut into 4096 bins, and the
    bin that holds the bound again, until the bound is exact. So no more than `top` sums reach the driver.
    """
    held, least = 0, None
    for r in df.groupBy(F.least(F.col(count), F.lit(top)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        if held + r.n > most:
            break
        held, least = held + r.n, r.c
    if least is not None:
        return least
    over = df.where(F.col(count) >= top).agg(F.min(count).alias("a"), F.max(count).alias("b")).first()
    if over.a is None:
        over = df.agg(F.min(count).alias("a"), F.max(count).alias("b")).first()
    if over.a is None:
        return 1
    a, b, held = over.a, over.b, 0
    while True:
        width = (b - a) // 4096 + 1
        cell = F.expr(f"(`{count}` - {a}) div {width}")
        bins = df.where(F.col(count).between(a, b)).groupBy(cell.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
        for r in bins:
            if held + r.n > most:
                break
            held += r.n
        else:
            return a
        a, b = a + r.k * width, min(b, a + (r.k + 1) * width - 1)
        if a == b:
            return a + 1


@dataclass(frozen=True)
class Ranges:
    """Ranges of a long key with about `target` bytes each. Null keys come first. All rows of a key share a range but for a
    key with so many bytes that it takes several: these are told apart by the hash of the row's content.
    """

    first: np.ndarray  # least key of each run of ranges but the first
    base: np.ndarray  # number of the first range of each run
    parts: np.ndarray  # ranges of each run: 1, or more for one large key
    null_parts: int

    @property
    def count(self) -> int:
        return self.null_parts + int(self.parts.sum())

    def of(self, key: Column, tie: Column) -> Column:
        """The range of a row, from 0. tie: a long that depends on the row's content alone."""
        first, base, parts, nulls = self.first, self.base, self.parts, self.null_parts  # a few longs for each range

        @F.pandas_udf("int")
        def place(k: pd.Series, null: pd.Series, t: pd.Series) -> pd.Series:
            missing = null.to_numpy(bool)
            run = np.searchsorted(first, k.to_numpy(np.int64), side="right")
            n = np.where(missing, nulls, parts[run])
            share = (t.to_numpy(np.int64) >> 32) + 2**31  # 0 to 2**32 - 1, in the order of t
            return pd.Series((np.where(missing, 0, base[run]) + share * n // 2**32).astype(np.int32))

        # a column with nulls would reach pandas as floats, in which large keys lose their low bits
        return place(F.coalesce(key.cast("long"), F.lit(0)), key.isNull(), tie)


def _cell(lo: np.ndarray, hi: np.ndarray, width: np.ndarray):
    """The span that a key lies in (-1: none) and its cell there."""

    @F.pandas_udf("struct<s:long,c:long>")
    def cell(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64)
        s = np.maximum(np.searchsorted(lo, k, side="right") - 1, 0)
        c = (k.view(np.uint64) - lo[s].view(np.uint64)) // width[s]
        return pd.DataFrame({"s": np.where((k >= lo[s]) & (k <= hi[s]), s, -1), "c": c.astype(np.int64)})

    return cell


def ranges(
    df: DataFrame, key: Column, size: Column, target: int, fewest: int = 64, least: int = 4 << 20, cells: int = 4096
) -> Ranges:
    """Ranges of about `target` bytes; of fewer, but not under `least`, if there would not be `fewest` ranges.

    Bytes are summed by cells of the key's span; cells with too many bytes and several keys are cut again, until none is
    left. So the bounds depend on the rows alone, and only sums by cell reach the driver: a few for each range.
    """
    rows = df.select(key.cast("long").alias("k"), size.cast("long").alias("n"))
    r = rows.agg(
        F.min("k").alias("lo"),
        F.max("k").alias("hi"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("nulls"),
        F.count_if(F.col("k").isNull()).alias("some"),
    ).first()
    total = r.n or 0
    target = max(1, min(target, max(least, total // fewest)))
    null_parts = max(1, -(-(r.nulls or 0) // target)) if r.some else 0
    if r.lo is None:
        return Ranges(np.zeros(0, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64) * (not null_parts), null_parts)
    open_spans, done = [(r.lo, r.hi)], []
    while open_spans:
        lo = np.array([a for a, _ in open_spans], np.int64)
        hi = np.array([b for _, b in open_spans], np.int64)
        each = max(cells, 4 * (total // target) // len(lo))
        width = np.array([(b - a) // each + 1 for a, b in open_spans], np.uint64)

        sums = rows.where("k is not null").withColumn("at", _cell(lo, hi, width)("k")).where("at.s >= 0").groupBy("at").agg(
            F.min("k").alias("a"), F.max("k").alias("b"), F.sum("n").alias("n")
        )
        got = [(x.a, x.b, x.n or 0) for x in sums.collect()]
        open_spans = sorted((a, b) for a, b, n in got if n > target // 2 and a < b)
        done += [x for x in got if x[2] <= target // 2 or x[0] == x[1]]
    first, parts, held = [], [], 0
    for a, b, n in sorted(done):
        alone = a == b and n > target
        if not parts or held + n > target or alone:
            first.append(a)
            parts.append(-(-n // target) if alone else 1)
            held = target if alone else 0
        held += n
    base = null_parts + np.cumsum([0, *parts[:-1]])
    return Ranges(np.array(first[1:], np.int64), base.astype(np.int64), np.array(parts, np.int64), null_parts)
