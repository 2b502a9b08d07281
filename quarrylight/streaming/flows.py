"""Flow feeds: JSON lines to idempotent documents and running endpoint counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylight.functions.text import url_host, url_pattern

#: Lists of an upserted table that stay readable.
KEPT = 2
FLOW = "id string, url string, method string, status int, ts timestamp"


def feed(spark: SparkSession, path: str, prefix: str = "FLOW:", most_files: int = 100) -> DataFrame:
    """Flows of new files of lines `prefix` + JSON; other lines and broken JSON give none."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", most_files).load(path).where(
        F.startswith("value", F.lit(prefix))
    )
    parsed = raw.select(
        F.from_json(F.substring(F.col("value"), F.lit(len(prefix) + 1), F.length("value")), FLOW).alias("f")
    )
    return parsed.where("f.id is not null and f.url is not null").select("f.*")


def running_endpoints(flows: DataFrame) -> DataFrame:
    """Counts by pattern, method and host; write it in complete or update mode."""
    return flows.groupBy(
        url_pattern(F.col("url")).alias("pattern"), "method", url_host(F.col("url")).alias("host")
    ).agg(F.count("*").alias("flow_count"))


def once(flows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each id once within the delay."""
    return flows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what there is, writes Parquet, and ends. A rerun goes on where the checkpoint is."""
    q = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_latest(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64
) -> None:
    """Keeps the latest row of each key below path, by buckets of the keys' hash: a micro-batch writes the buckets that it touches.

    A batch writes new files for its buckets under its own number and then the list of each bucket's number, beginning from the latest
    list of a batch before it; a repeated batch does the same again. What only lists older than the last `KEPT` name is removed. Read the
    table with upserted().
    """

    def batch(rows: DataFrame, number: int) -> None:
        from quarrylight.operators.store import upsert

        spark = rows.sparkSession
        placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        places = _places(spark, path, max([n for n in _numbers(spark, path) if n < number], default=-1))
        touched = [r["_bucket"] for r in placed.select("_bucket").distinct().collect()]  # at most `buckets`
        old = [f"{path}/table/{places[b]}/_bucket={b}" for b in touched if b in places]
        current = spark.read.schema(rows.schema).parquet(*old) if old else rows.limit(0)
        merged = upsert(current, rows, keys, [F.desc(order)]).withColumn(
            "_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        )
        merged.repartition(
            len(touched) or 1, "_bucket"
        ).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/table/{number}")
        now = places | dict.fromkeys(touched, number)
        spark.createDataFrame(
            sorted(now.items()) or [(-1, -1)], "bucket int, number long"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/places/{number}")
        _sweep(spark, path, number)

    stream.writeStream.foreachBatch(batch).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


def index_flows(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Keeps the search documents of a feed of flows (with headers, status, duration and ts) below path: the latest of each, by its id."""
    from quarrylight.operators.netflow import flow_documents

    upsert_latest(flow_documents(stream, keep=("ts",)), path, checkpoint, ["doc_id"], "ts", buckets)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The batches whose lists are there and whole."""
    from quarrylight.operators.snapshots import _fs

    fs, to = _fs(spark, path)
    if not fs.exists(to(f"{path}/places")):
        return []
    found = [s.getPath() for s in fs.listStatus(to(f"{path}/places"))]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(to(f"{p}/_SUCCESS")))


def _sweep(spark: SparkSession, path: str, number: int) -> None:
    """Removes the lists before the last KEPT up to this batch, and the buckets that no list left names."""
    from quarrylight.operators.snapshots import _fs

    fs, to = _fs(spark, path)
    before = [n for n in _numbers(spark, path) if n <= number]
    kept = {(n, b) for at in before[-KEPT:] for b, n in _places(spark, path, at).items()}
    for n in before[:-KEPT]:
        fs.delete(to(f"{path}/places/{n}"), True)
    for folder in fs.listStatus(to(f"{path}/table")):
        n = folder.getPath().getName()
        if not n.isdigit() or int(n) > number:
            continue
        buckets = [b.getPath() for b in fs.listStatus(folder.getPath()) if b.getPath().getName().startswith("_bucket=")]
        left = [b for b in buckets if (int(n), int(b.getName().partition("=")[2])) in kept]
        for b in buckets if left else ():
            if b not in left:
                fs.delete(b, True)
        if not left:
            fs.delete(folder.getPath(), True)


def _places(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch wrote each bucket last, as batch `number` left it."""
    if number < 0:
        return {}
    return {r.bucket: r.number for r in spark.read.parquet(f"{path}/places/{number}").where("bucket >= 0").collect()}


def upserted(spark: SparkSession, path: str, number: int, schema) -> DataFrame:
    """The table as batch `number` left it."""
    files = [f"{path}/table/{n}/_bucket={b}" for b, n in sorted(_places(spark, path, number).items())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def drained_events(spark: SparkSession, path: str, out: str, checkpoint: str, most_files: int = 100) -> DataFrame:
    """A hook session's lines, all that there are, as events: parsed as they come, written, and read back."""
    from quarrylight.sources.corpus import hook_events

    lines = spark.readStream.format("text").option("maxFilesPerTrigger", most_files).load(path)
    run_available(hook_events(lines).drop("raw"), out, checkpoint)
    return spark.read.parquet(out)
