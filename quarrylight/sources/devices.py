"""What device tools print, as rows: device lists, process lists and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def devices(lines: DataFrame, column: str = "value") -> DataFrame:
    """(serial, state, model, product, transport_id) of each line of a device list; headings and notices give none."""
    text = F.trim(F.col(column))
    kept = lines.where((text != "") & ~F.startswith(text, F.lit("*")) & ~F.contains(text, F.lit("List of devices")))
    cut = kept.withColumn("_p", F.split(text, r"\s+")).where(F.size("_p") >= 2)
    info = F.array_join(F.slice("_p", 3, F.greatest(F.size("_p"), F.lit(1))), " ")
    field = lambda name: F.regexp_extract(info, rf"{name}:(\S+)", 1).alias(name)
    return cut.select(
        F.get("_p", F.lit(0)).alias("serial"),
        F.get("_p", F.lit(1)).alias("state"),
        field("model"),
        field("product"),
        field("transport_id"),
    )


def processes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(pid, name) of each line that is a number and a name."""
    row = r"^\s*(\d+)\s+(.*\S)\s*$"
    found = lines.where(F.col(column).rlike(row))
    return found.select(
        F.regexp_extract(column, row, 1).cast("long").alias("pid"), F.regexp_extract(column, row, 2).alias("name")
    )


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, pid, tid, level, tag, message) of each log line in the format with threads and times; others give none."""
    row = r"^(\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+(.*?)\s*: (.*)$"
    part = lambda i: F.regexp_extract(column, row, i)
    found = lines.where(F.col(column).rlike(row))
    return found.select(
        part(1).alias("at"),
        part(2).cast("long").alias("pid"),
        part(3).cast("long").alias("tid"),
        part(4).alias("level"),
        part(5).alias("tag"),
        part(6).alias("message"),
    )
