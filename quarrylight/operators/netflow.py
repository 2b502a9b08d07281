"""HTTP flows: endpoints, documents for search, and live flows beside indexed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrylight.functions.text import redact_headers, url_host, url_pattern


def endpoints(flows: DataFrame, most_urls: int = 50) -> DataFrame:
    """(pattern, method, host, flow_count, urls): counts by URL pattern; urls: the first distinct ones, sorted."""
    named = flows.select(
        url_pattern(F.col("url")).alias("pattern"), "method", url_host(F.col("url")).alias("host"), "url"
    )
    # a hot endpoint shrinks before its shuffle
    per_url = named.groupBy("pattern", "method", "host", "url").agg(F.count("*").alias("n"))
    keys = ["pattern", "method", "host"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("url"))
    kept = per_url.withColumn("_nth", nth).where(F.col("_nth") <= most_urls)  # only these meet in a row
    urls = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return per_url.groupBy(*keys).agg(F.sum("n").alias("flow_count")).join(urls, keys)


def flow_documents(flows: DataFrame, most_chars: int = 4000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two documents of each flow (id, url, method, status, duration_ms, request_headers, response_headers, and bodies if there):
    (doc_id, flow_id, chunk_type, text, and the columns `keep`)."""
    heads = lambda c: F.array_join(
        F.transform(
            F.array_sort(F.map_entries(redact_headers(F.col(c)))),
            lambda e: F.concat(F.lit("  "), e.key, F.lit(": "), e.value, F.lit("\n")),
        ),
        "",
    )
    status = F.concat(F.lit("\nStatus: "), F.col("status").cast("string"), F.lit("\n"))
    request = F.concat(
        F.lit("[NETWORK FLOW] "),
        "method",
        F.lit(" "),
        "url",
        status,
        F.lit("Duration: "),
        F.col("duration_ms").cast("string"),
        F.lit("ms\nRequest Headers:\n"),
        heads("request_headers"),
    )
    response = F.concat(
        F.lit("[NETWORK RESPONSE] "),
        "method",
        F.lit(" "),
        "url",
        status,
        F.lit("Response Headers:\n"),
        heads("response_headers"),
    )
    for body, text in (("request_body", "request"), ("response_body", "response")):
        if body in flows.columns:
            more = F.when(
                F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(F.lit("Body:\n"), body)
            ).otherwise(F.lit(""))
            request, response = (
                F.concat(request, more), response
            ) if text == "request" else (request, F.concat(response, more))
    both = F.array(
        F.struct(F.lit("request_summary").alias("chunk_type"), request.alias("text")),
        F.struct(F.lit("response_summary").alias("chunk_type"), response.alias("text")),
    )
    cut = flows.select(F.col("id").cast("string").alias("flow_id"), *keep, F.explode(both).alias("d"))
    cut = cut.select("flow_id", *keep, "d.chunk_type", F.left("d.text", F.lit(most_chars)).alias("text"))
    return cut.select(
        F.sha2(F.concat("flow_id", F.lit(":"), "chunk_type"), 256).alias("doc_id"),
        "flow_id",
        "chunk_type",
        "text",
        *keep
    )


def merge_live(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """Live hits, and those indexed ones whose url no live hit has."""
    old = indexed.join(live.select("url").distinct(), "url", "left_anti")
    return live.withColumn("origin", F.lit("live")).unionByName(old.withColumn("origin", F.lit("indexed")))


def traffic(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count("*").alias("flows"),
        F.coalesce(F.sum("request_size"), F.lit(0)).cast("long").alias("request_bytes"),
        F.coalesce(F.sum("response_size"), F.lit(0)).cast("long").alias("response_bytes"),
    )


def search_flows(flows: DataFrame, phrase: str, most: int, order: str) -> DataFrame:
    """The first `most` flows (by `order`) whose url, host or bodies (if there) hold the phrase, without regard to case."""
    p = F.lit(phrase.lower())
    hit = F.contains(F.lower("url"), p) | F.contains(F.lower(url_host(F.col("url"))), p)
    for body in ("request_body", "response_body"):
        if body in flows.columns:
            hit = hit | F.coalesce(F.contains(F.lower(body), p), F.lit(False))
    return flows.where(hit).orderBy(order).limit(most)


def captured(flows: DataFrame, most_chars: int = 5000) -> DataFrame:
    """flows with bodies cut as a capture keeps them; adds {body}_cut, whether it was longer."""
    for body in ("request_body", "response_body"):
        cut = F.coalesce(F.length(body) > most_chars, F.lit(False))
        flows = flows.withColumns({f"{body}_cut": cut, body: F.left(body, F.lit(most_chars))})
    return flows
