"""A live feed of growing files as a streaming source: every complete line once, from byte offsets that the checkpoint keeps.

A micro-batch is a range of bytes for each file: from where the last one ended to the last line feed there is, so a line that is
still being written waits. Ranges are cut into partitions by size, each with the lines that begin in it, so a large backlog is read by
many tasks and none holds more than a piece of it. Files are followed by name: one that grows goes on, a new one starts at 0, one that
shrinks is an error, as lines may have been lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarrylight.session import filesystem, for_workers

NAME = "growing_lines"
LINE = "file string, at long, line string"
PIECE, PART = 1 << 20, 32 << 20


@dataclass
class Lines(InputPartition):
    """The lines of a file that begin from `start` on and before `stop`; first: where the micro-batch begins, end: where it ends."""

    file: str
    first: int
    start: int
    stop: int
    end: int


def _sizes(path: str) -> dict[str, int]:
    from pyarrow import fs

    where, inside = filesystem(path)
    info = where.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        return {}
    some = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inside, recursive=True))
    return {i.path: i.size for i in some if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}


def last_line_feed(file, least: int, size: int) -> int:
    """Behind the last line feed from `least` on; `least` if there is none. Read backwards in pieces."""
    at = size
    while at > least:
        lo = max(least, at - PIECE)
        file.seek(lo)
        found = file.read(at - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        at = lo
    return least


def lines_of(file, p: Lines) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its line feed) of the partition's lines."""
    at, held, skip = p.start, b"", p.start > p.first
    if skip:  # a line begins here only behind a line feed
        at -= 1
    begin, read = at, at
    while begin < p.stop:
        cut = held.find(b"\n")
        if cut < 0:
            file.seek(read)
            piece = file.read(min(PIECE, p.end - read))
            if not piece:
                return
            held, read = held + piece, read + len(piece)
            continue
        if not skip:
            yield begin, held[:cut]
        skip = False
        begin, held = begin + cut + 1, held[cut + 1 :]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("part_bytes", PART))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        where, _ = filesystem(self.path)
        now = dict(self.known)
        for name, size in sorted(_sizes(self.path).items()):
            if size > now.get(name, 0):
                with where.open_input_file(name) as f:
                    now[name] = last_line_feed(f, now.get(name, 0), size)
        self.known = {k: v for k, v in now.items() if v}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        self.known = {**end}
        sizes, out = _sizes(self.path), []
        for name, stop in sorted(end.items()):
            first = start.get(name, 0)
            if stop > first and sizes.get(name, 0) < stop:
                raise ValueError(f"{name} has fewer bytes than were read of it")
            out += [Lines(name, first, a, min(a + self.part, stop), stop) for a in range(first, stop, self.part)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        where, _ = filesystem(self.path)
        with where.open_input_file(partition.file) as f:
            for at, line in lines_of(f, partition):
                yield partition.file, at, line.decode("utf-8", "replace")


class GrowingLines(DataSource):
    """Options: path (a file or a folder), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def tail(spark: SparkSession, path: str, part_bytes: int = PART) -> DataFrame:
    """A stream of LINE: each complete line of the files at or below path once, with the file and the byte where it begins."""
    for_workers(spark).dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("path", path).option("part_bytes", part_bytes).load()


def parsed(lines: DataFrame, schema: str, prefix: str = "FLOW:", needed: tuple[str, ...] = ("id", "url")) -> DataFrame:
    """lines with state and record (of `schema`): flow (a record), malformed (the prefix, but broken JSON or without a needed field; no
    record), or other (no prefix)."""
    marked = F.startswith("line", F.lit(prefix))
    record = F.from_json(F.substring("line", F.lit(len(prefix) + 1), F.length("line")), schema)
    whole = marked
    for c in needed:
        whole = whole & F.col("record").getField(c).isNotNull()
    out = lines.withColumn("record", F.when(marked, record))
    state = F.when(whole, "flow").when(marked, "malformed").otherwise("other")
    return out.withColumn("state", state).withColumn("record", F.when(F.col("state") == "flow", F.col("record")))


def line_states(parsed_lines: DataFrame) -> DataFrame:
    """(file, state, lines): how many of each kind; for a stream in complete or update mode."""
    return parsed_lines.groupBy("file", "state").agg(F.count("*").alias("lines"))
