"""Chunks of texts: overlapping line windows, gaps between known intervals, instruction ordinals, stable ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarrylight.functions.text import identity_sha, lines
from quarrylight.session import for_workers


def line_windows(files: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """files (path, language, content, ...) as windows of `size` lines that share `overlap`; the last one ends with the text.

    Adds symbol, kind, start_line, end_line and puts the window's lines into content. A text without lines has no window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap is 0 or more and less than size")
    step = size - overlap
    cut = files.withColumn("_lines", lines(F.col("content"))).where(F.size("_lines") > 0)
    count = F.when(F.size("_lines") <= size, 1).otherwise(F.ceil((F.size("_lines") - size) / step) + 1).cast("int")
    placed = cut.withColumn("_all", F.size("_lines")).select(
        "*", F.explode(F.sequence(F.lit(0), count - 1)).alias("_w")
    )
    start, end = F.col("_w") * step + 1, F.least(F.col("_w") * step + size, F.col("_all"))
    symbol = F.when(F.col("_all") <= size, F.lit("<file>")).otherwise(
        F.concat(F.lit("<file>:"), start.cast("string"), F.lit("-"), end.cast("string"))
    )
    return placed.withColumns(
        {
            "kind": F.lit("file"),
            "symbol": symbol,
            "start_line": start.cast("int"),
            "end_line": end.cast("int"),
            "content": F.array_join(F.slice("_lines", F.col("_w") * step + 1, size), "\n"),
        }
    ).drop("_lines", "_all", "_w")


def chunk_id(start_instruction: Column | None = None, end_instruction: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.concat(
        F.lit("chk_"),
        identity_sha(
            schema_version=F.lit("1.0"),
            language=F.col("language"),
            kind=F.col("kind"),
            path=F.col("path"),
            symbol=F.col("symbol"),
            start_line=F.col("start_line"),
            end_line=F.col("end_line"),
            start_instruction=none if start_instruction is None else start_instruction,
            end_instruction=none if end_instruction is None else end_instruction,
            content_sha256=F.sha2("content", 256),
        ),
    )


def islands(intervals: DataFrame, key: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Intervals of each key merged where they overlap or touch (end + 1 = start): (key, start, end)."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.where(F.col(start) <= F.col(end)).withColumn(
        "_new", F.coalesce((F.col(start) > reach + 1).cast("int"), F.lit(1))
    )
    grouped = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(intervals: DataFrame, totals: DataFrame, key: str, total: str, piece: int = 200) -> DataFrame:
    """Lines of each key of totals that no interval covers, in pieces of at most `piece` lines: (key, start_line, end_line)."""
    inside = intervals.join(totals, key).select(
        key,
        F.greatest(F.lit(1), F.col("start_line")).alias("start_line"),
        F.least(F.col("end_line"), F.col(total)).alias("end_line"),
    )
    merged = islands(inside, key)
    # a virtual island before the first line and one behind the last make every gap one between neighbours
    ends = totals.select(
        key, F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line")
    ).union(totals.select(key, (F.col(total) + 1).cast("long"), (F.col(total) + 1).cast("long")))
    order = Window.partitionBy(key).orderBy("start_line", "end_line")
    between = merged.select(
        key, F.col("start_line").cast("long"), F.col("end_line").cast("long")
    ).union(ends).withColumn("_before", F.lag("end_line").over(order)).where(F.col("start_line") > F.col("_before") + 1)
    pieces = between.select(
        key, (F.col("_before") + 1).alias("a"), (F.col("start_line") - 1).alias("b")
    ).select(key, "b", F.explode(F.expr(f"sequence(a, b, {piece}L)")).alias("start_line"))
    return pieces.select(key, "start_line", F.least(F.col("start_line") + piece - 1, F.col("b")).alias("end_line"))


def ordinals(rows: DataFrame, key: str, order: str, counted: Column) -> DataFrame:
    """Adds ordinal: how many rows of the key up to this one are counted; null on rows that aren't."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ordinal", F.when(counted, F.sum(counted.cast("long")).over(upto)))


def ordinal_ranges(instructions: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """First and last ordinal of the instructions within each range of lines (key, start_line, end_line)."""
    at = instructions.where("ordinal is not null").select(key, "line", "ordinal")
    # ordinals rise with lines: the first at or behind a range's start, and the last up to its end, are its bounds
    marks = at.select(key, "line", "ordinal", F.lit(1).alias("_kind")).withColumns(
        {c: F.lit(None).cast(ranges.schema[c].dataType) for c in ranges.columns if c != key}
    )
    rows = marks
    for side, kind in (("start_line", 0), ("end_line", 2)):
        rows = rows.unionByName(
            ranges.select(
                "*",
                F.col(side).cast("int").alias("line"),
                F.lit(None).cast("long").alias("ordinal"),
                F.lit(kind).alias("_kind"),
            )
        )
    order = Window.partitionBy(key).orderBy("line", "_kind")
    behind = F.first("ordinal", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    upto = F.last("ordinal", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumns({"_behind": behind, "_upto": upto}).where("_kind <> 1")
    both = found.groupBy(*ranges.columns).agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_behind"))).alias("a"),
        F.max(F.when(F.col("_kind") == 2, F.col("_upto"))).alias("b"),
    )
    some = F.col("a") <= F.col("b")
    return both.select(
        *ranges.columns,
        F.when(some, F.col("a")).alias("start_instruction"),
        F.when(some, F.col("b")).alias("end_instruction"),
    )


def enclosing(points: DataFrame, spans: DataFrame, key: str = "path") -> DataFrame:
    """Adds nesting: names of the spans (open, close, name) strictly around each point (offset), outermost first.

    A sweep: points and openings of a key in order, spans still open in memory, so a key costs a sort (that spills) and not a
    product. Spans may overlap. A point with a null key or offset, or without spans, has an empty nesting; spans with a null
    bound or key surround nothing; null names are left out. Columns of points may have any other names.
    """
    none = lambda kind: F.lit(None).cast(kind)
    at = points.select(
        F.col(key).alias("_key"),
        F.col("offset").cast("long").alias("_at"),
        none("long").alias("_close"),
        none("string").alias("_name"),
        F.struct("*").alias("_point"),
    )
    opened = spans.where(F.col(key).isNotNull() & F.col("open").isNotNull() & F.col("close").isNotNull()).select(
        F.col(key).alias("_key"),
        F.col("open").cast("long").alias("_at"),
        F.col("close").cast("long").alias("_close"),
        F.col("name").cast("string").alias("_name"),
        none(at.schema["_point"].dataType).alias("_point"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, around = None, []
        for batch in batches:
            kept, nesting = [], []
            for i, (k, x, close, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if k != now:
                    now, around = k, []
                if close is not None:
                    around.append((x, name, close))
                    continue
                if x is not None:
                    around = [y for y in around if y[2] > x]
                kept.append(i)
                names = [y[1] for y in sorted(around, key=lambda y: (y[0], y[1] or ""))] if x is not None else ()
                nesting.append(".".join(y for y in names if y is not None))
            point = batch.column(4).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([point, pa.array(nesting, pa.string())], names=["_point", "nesting"])

    out = T.StructType([at.schema["_point"], T.StructField("nesting", T.StringType())])
    # a point comes before what opens at its own place
    for_workers(points.sparkSession)
    rows = at.unionByName(opened).repartition("_key").sortWithinPartitions(
        "_key", "_at", F.col("_close").isNotNull()
    )
    return rows.mapInArrow(run, out).select("_point.*", "nesting")


def fingerprint(chunks: DataFrame, key: str, version: str) -> DataFrame:
    """One SHA-256 for each key over its sorted chunk ids. The ids of a key meet in one row: key by something bounded."""
    text = F.concat(F.lit(f"source-index\n{version}\n"), F.array_join(F.array_sort(F.collect_list("id")), "\n"))
    return chunks.groupBy(key).agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("chunks"))
