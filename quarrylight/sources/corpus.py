"""Source trees, HAR captures and event lines as DataFrames; and tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarrylight.functions.text import language_of, url_host

PARSE_LIMIT, FALLBACK_LIMIT = 2 << 20, 64 << 20


def admissibility(
    path: Column, size: Column, content: Column, parse_limit: int = PARSE_LIMIT, fallback_limit: int = FALLBACK_LIMIT
) -> Column:
    """Why a file is left out, or `indexed`, or `fallback` for one that is only cut into line windows. content: binary."""
    return (
        F.when(
            language_of(path).isNull(), "unsupported-suffix"
        ).when(size > fallback_limit, "too-large").when(content.isNull(), "unreadable").when(size == 0, "empty")
        .when(F.contains(content.cast("string"), F.lit("\x00")), "binary")
        .when(
            ~F.is_valid_utf8(content.cast("string")), "invalid-utf8"
        ).when(size > parse_limit, "fallback").otherwise("indexed")
    )


def source_tree(
    spark: SparkSession, root: str, parse_limit: int = PARSE_LIMIT, fallback_limit: int = FALLBACK_LIMIT
) -> DataFrame:
    """(path, language, size, state, content) of every file below root; content is null unless it is indexed or fallback.

    Spark's file scan leaves out files without a byte, so these have no row.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the content of larger files is not read: the bound reaches the reader
    files = every.where(F.col("length") <= fallback_limit).unionByName(
        every.where(F.col("length") > fallback_limit).withColumn("content", F.lit(None).cast("binary"))
    )
    base = F.regexp_replace(F.col("path"), F.lit("^.*?" + root.rstrip("/").replace(".", r"\.") + "/"), F.lit(""))
    named = files.select(base.alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))
    judged = named.withColumn(
        "state", admissibility(F.col("path"), F.col("size"), F.col("raw"), parse_limit, fallback_limit)
    )
    text = F.replace(F.col("raw").cast("string"), F.lit("\r\n"), F.lit("\n"))
    return judged.select(
        "path",
        language_of(F.col("path")).alias("language"),
        "size",
        "state",
        F.when(F.col("state").isin("indexed", "fallback"), text).alias("content"),
    )


def oversize_windows(
    spark: SparkSession,
    root: str,
    parse_limit: int = PARSE_LIMIT,
    fallback_limit: int = FALLBACK_LIMIT,
    size: int = 200,
    overlap: int = 20,
) -> DataFrame:
    """(path, start_line, end_line, content): line windows of files between the limits, read in splits: no file is a row.

    Lines are numbered by the counts of the splits before theirs and their place in their own; a window gathers `size` lines at most.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    large = sizes.where((F.col("length") > parse_limit) & (F.col("length") <= fallback_limit)).select("path")
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    rows = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = rows.join(
        F.broadcast(large), "path", "left_semi"
    ) if large.limit(100_001).count() <= 100_000 else rows.join(large, "path", "left_semi")
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    numbered = rows.withColumn(
        "i", F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    ).join(counts.withColumn("before", before), ["path", "block"])
    numbered = numbered.select("path", (F.col("i") + F.col("before")).alias("number"), "line")
    step = size - overlap
    totals = counts.groupBy("path").agg(F.sum("n").alias("total"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / step)).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col("number") - size) / step)).cast("long")
    place = F.least(last, F.floor((F.col("number") - 1) / step).cast("long"))
    spread = numbered.join(totals, "path").withColumn("w", F.explode(F.sequence(F.least(first, place), place)))
    ordered = F.array_sort(F.collect_list(F.struct("number", "line")))
    got = spread.groupBy("path", "w").agg(
        F.min("number").alias("start_line"),
        F.max("number").alias("end_line"),
        F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("content"),
    )
    base = F.regexp_replace(F.col("path"), F.lit("^.*?" + root.rstrip("/").replace(".", r"\.") + "/"), F.lit(""))
    return got.select(base.alias("path"), "start_line", "end_line", "content")


def warnings(files: DataFrame, most: int = 20) -> DataFrame:
    """(path, state) of the first `most` files, by path, that are left out or only cut into windows."""
    return files.where("state <> 'indexed'").select("path", "state").orderBy("path").limit(most)


def accounting(files: DataFrame) -> DataFrame:
    """Counts of the states of files."""
    skipped = ~F.col("state").isin("indexed", "fallback")
    return files.agg(
        F.count_if(~skipped).alias("indexed"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(F.col("state") == "fallback").alias("fallback"),
        F.count_if(skipped | (F.col("state") == "fallback")).alias("warnings"),
    )


HAR = "struct<log:struct<entries:array<struct<startedDateTime:string,time:double,request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,bodySize:bigint,postData:struct<text:string>>,response:struct<status:int,headers:array<struct<name:string,value:string>>,bodySize:bigint,content:struct<text:string>>>>>>"


def har(spark: SparkSession, path: str) -> DataFrame:
    """Flows of HAR files, an id for each entry of each file; bodies as digests."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", HAR).alias("h")
    )
    e = files.select("file", F.posexplode("h.log.entries").alias("n", "e"))

    def heads(column: str) -> Column:
        """By lower-cased name; of repeated names the last counts."""
        named = F.transform(
            F.coalesce(F.col(column), F.array()),
            lambda h: F.struct(F.lower(h["name"]).alias("k"), h["value"].alias("v")),
        )
        last = F.filter(
            named, lambda x, i: x.k.isNotNull() & ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y.k == x.k)
        )
        return F.map_from_entries(last)

    return e.select(
        F.concat(
            F.lit("flow_"), F.sha2(F.concat_ws("\n", "file", F.col("n").cast("string"), "e.request.url"), 256)
        ).alias("id"),
        F.col("e.request.url").alias("url"),
        F.col("e.request.method").alias("method"),
        F.col("e.response.status").alias("status"),
        heads("e.request.headers").alias("request_headers"),
        heads("e.response.headers").alias("response_headers"),
        F.sha2("e.request.postData.text", 256).alias("request_body_hash"),
        F.sha2("e.response.content.text", 256).alias("response_body_hash"),
        F.greatest(F.lit(0), F.coalesce("e.request.bodySize", F.lit(0))).cast("long").alias("request_size"),
        F.greatest(F.lit(0), F.coalesce("e.response.bodySize", F.lit(0))).cast("long").alias("response_size"),
        F.col("e.time").cast("long").alias("duration_ms"),
        F.to_timestamp("e.startedDateTime").alias("ts"),
    )


def hook_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events that JSON objects within noisy lines describe; lines without one, or without a type, give none."""
    raw = F.regexp_extract(F.col(column), r"(\{.*\})", 1)
    shape = "type string, timestamp double, `class` string, `method` string, args array<string>, result string, stacktrace string"
    parsed = lines.withColumn("_json", raw).withColumn("_e", F.from_json("_json", shape)).where("_e.type is not null")
    return parsed.select(
        F.col("_e.type").alias("hook_type"),
        F.timestamp_micros((F.col("_e.timestamp") * 1_000_000).cast("long")).alias("ts"),
        F.coalesce("_e.class", F.lit("")).alias("class_name"),
        F.coalesce("_e.method", F.lit("")).alias("method_name"),
        F.coalesce("_e.args", F.array()).alias("args"),
        F.col("_e.result"),
        F.try_parse_json("_json").alias("raw"),
    )


# Tables that stand in for chunks, flows and runs.


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, source, doc_id, content)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(
        F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")
    )
    return d.select(
        path.alias("path"), F.col("lang").alias("language"), "source", "doc_id", F.col("text").alias("content")
    )


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk of each file: (id, path, language, kind, symbol, start_line, content, doc_id)."""
    f = documents_as_files(spark, sf_dir)
    return f.select(
        F.concat(F.lit("chk_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"),
        "path",
        "language",
        F.when(F.col("doc_id") % 2 == 0, "method").otherwise("file").alias("kind"),
        F.concat(F.lit("sym_"), (F.col("doc_id") % 7).cast("string")).alias("symbol"),
        F.lit(1).alias("start_line"),
        "content",
        "doc_id",
    )


def pages_as_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    heads = F.create_map(
        F.lit("Host"),
        url_host(F.col("url")),
        F.lit("Cookie"),
        F.concat(F.lit("session="), F.col("page_id").cast("string")),
    )
    return p.select(
        F.col("page_id").alias("id"),
        "url",
        F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.lit(200).alias("status"),
        heads.alias("request_headers"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("response_headers"),
        (F.col("page_id") % 100).alias("duration_ms"),
        F.lit(0).cast("long").alias("request_size"),
        F.octet_length("html").cast("long").alias("response_size"),
    )


def events_as_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("project_id"),
        F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("ts").alias("started_at"),
        "value",
        "props",
    )
