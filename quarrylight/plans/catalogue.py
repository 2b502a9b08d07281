"""Named queries over the tables of a folder. Each has a twin in SQL in quarrylight.plans.twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarrylight.functions import text as X
from quarrylight.operators import ann, chunking, evaluate, lineage, manifest, netflow, ranking, report, retrieval, rollup, search, signals, store, vectors
from quarrylight.session import shared_folder
from quarrylight.sources import corpus, manifests
from quarrylight.streaming import flows as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PHRASE, WORDS, PATTERN = "that the", ["that", "edth", "nonesuch"], "th[a-z]+tion"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


chunks, files, flows, runs = corpus.documents_as_chunks, corpus.documents_as_files, corpus.pages_as_flows, corpus.events_as_runs


@query
def chunk_line_windows(spark, sf_dir):
    w = chunking.line_windows(files(spark, sf_dir), size=4, overlap=1)
    return w.select(
        "path",
        "symbol",
        F.col("start_line").cast("long"),
        F.col("end_line").cast("long"),
        F.length("content").cast("long").alias("chars"),
    )


@query
def chunk_identity_sha(spark, sf_dir):
    w = chunking.line_windows(files(spark, sf_dir), size=4, overlap=1)
    return w.select(
        "path",
        F.col("start_line").cast("long"),
        chunking.chunk_id().alias("id"),
        F.sha2("content", 256).alias("content_sha256"),
    )


@query
def chunk_gap_intervals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        (F.col("l_partkey") % 900 + 1).alias("start_line"),
        (F.col("l_partkey") % 900 + F.col("l_quantity").cast("long")).alias("end_line"),
    )
    totals = li.select("k").distinct().withColumn("total", F.lit(1000).cast("long"))
    return chunking.gaps(li, totals, "k", "total", piece=200)


@query
def chunk_islands(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        (F.col("l_partkey") % 900 + 1).alias("start_line"),
        (F.col("l_partkey") % 900 + F.col("l_quantity").cast("long")).alias("end_line"),
    )
    return chunking.islands(li, "k")


@query
def chunk_ordinals(spark, sf_dir):
    lines = files(spark, sf_dir).select(
        "path", F.posexplode(X.lines(F.col("content"))).alias("i", "l")
    ).select("path", (F.col("i") + 1).cast("long").alias("line"), "l")
    return chunking.ordinals(lines, "path", "line", F.length("l") > 200).select("path", "line", "ordinal")


@query
def file_admissibility(spark, sf_dir):
    f = files(spark, sf_dir)
    state = corpus.admissibility(
        F.col("path"),
        F.octet_length("content").cast("long"),
        F.col("content").cast("binary"),
        parse_limit=2000,
        fallback_limit=20000,
    )
    return f.select("path", state.alias("state"), X.language_of(F.col("path")).alias("inferred"))


@query
def index_accounting(spark, sf_dir):
    f = files(spark, sf_dir)
    state = corpus.admissibility(
        F.col("path"),
        F.octet_length("content").cast("long"),
        F.col("content").cast("binary"),
        parse_limit=2000,
        fallback_limit=20000,
    )
    return corpus.accounting(f.select(state.alias("state")))


@query
def source_fingerprint(spark, sf_dir):
    w = chunking.line_windows(files(spark, sf_dir), size=4, overlap=1).withColumn("id", chunking.chunk_id())
    return chunking.fingerprint(w, "path", "1")


@query
def search_exact_topk(spark, sf_dir):
    return search.top_hits(search.search(chunks(spark, sf_dir), PHRASE), 10).select(
        "id", "path", "match_count", "distinct_match_line_count"
    )


@query
def search_exact_case_sensitive(spark, sf_dir):
    return search.search(chunks(spark, sf_dir), "The", ignore_case=False).select("id", "match_count")


@query
def search_regex_topk(spark, sf_dir):
    return search.top_hits(
        search.search(chunks(spark, sf_dir), PATTERN, regex=True), 25
    ).select("id", "path", "match_count")


@query
def search_match_lines(spark, sf_dir):
    hits = search.search(chunks(spark, sf_dir), PHRASE, most_lines=5)
    return hits.select(
        "id",
        "distinct_match_line_count",
        F.array_join(F.transform("match_lines", lambda x: x.cast("string")), ",").alias("match_lines"),
        "match_lines_truncated",
    )


@query
def search_excerpt(spark, sf_dir):
    hits = search.search(chunks(spark, sf_dir), PHRASE)
    return search.excerpt(hits, PHRASE, context_lines=1, most_chars=120).select(
        "id", "excerpt", F.col("excerpt_start_line").cast("long"), F.col("excerpt_end_line").cast("long")
    )


@query
def path_prefix_candidates(spark, sf_dir):
    return search.path_prefixes(chunks(spark, sf_dir), ["src1/en", "src2/fr/doc_1", "src3_"]).select("id", "path")


@query
def id_candidates_semi(spark, sf_dir):
    return search.by_ids(
        chunks(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id"
    ).select("id", "path")


@query
def token_estimate(spark, sf_dir):
    return files(spark, sf_dir).select("path", X.token_estimate(F.col("content")).alias("tokens"))


@query
def token_features(spark, sf_dir):
    t = F.transform(F.regexp_extract_all("content", F.lit(X.TOKEN), F.lit(0)), F.lower)
    made = files(spark, sf_dir).select("path", t.alias("t"))  # a projection of its own: the expression is computed once
    return made.select(
        "path",
        F.size("t").cast("long").alias("tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
        F.greatest(F.lit(0), F.size("t") - 1).cast("long").alias("bigrams"),
    )


@query
def lexical_score(spark, sf_dir):
    score = X.lexical_score(F.col("content"), F.concat("path", F.lit(" "), "symbol"), PHRASE, WORDS)
    return chunks(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


@query
def knn_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.nearest(
        e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, k=10
    ).select("query_id", F.col("rank").cast("long"), "id", "cosine")


@query
def ivf_exact(spark, sf_dir):
    """knn_exact's rows from the inverted file: the nearest lists first, then those that may still hold something nearer."""
    index, asked = _ivf(spark, sf_dir)
    found = ann.search_exact(index, asked, k=10, path=shared_folder(spark, "first"))
    return found.select("query_id", F.col("rank").cast("long"), "id", "cosine")


@query
def ivf_approximate(spark, sf_dir):
    """Nearest vectors in the nearest lists only, as many as a sample of queries needs for a recall of 0.95; tests measure all."""
    index, asked = _ivf(spark, sf_dir)
    found = ann.search(index, asked, k=10, probes=ann.calibrate(index, asked, 10, shared_folder(spark, "sample")))
    return found.select("query_id", F.col("rank").cast("long"), "id", "cosine")


def _ivf(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings")
    index = ann.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), shared_folder(spark, "ivf"))
    return index, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query
def knn_affine_vs_cosine(spark, sf_dir):
    return knn_exact(spark, sf_dir).where("rank <= 5").select(
        "query_id", "id", "cosine", vectors.affine(F.col("cosine")).alias("affine")
    )


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked neighbours of the query vectors, relevant if of the same label."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = knn_exact(spark, sf_dir).where("id <> query_id").select(F.col("query_id").alias("case_id"), "rank", "id")
    mine, theirs = label.select(
        F.col("vec_id").alias("case_id"), F.col("label").alias("expected")
    ), label.select(F.col("vec_id").alias("id"), "label")
    return evaluate.dedupe_ranks(found, 10).join(mine, "case_id").join(theirs, "id")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"))


@query
def retrieval_metrics_by_case(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return evaluate.first_relevant(c, _asked(spark, sf_dir), F.col("label") == F.col("expected")).select(
        "case_id", F.col("first_rank").cast("long"), F.round("reciprocal_rank", 6).alias("reciprocal_rank")
    )


@query
def retrieval_metrics(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return evaluate.metrics(
        evaluate.first_relevant(c, _asked(spark, sf_dir), F.col("label") == F.col("expected")), [1, 3, 5]
    )


@query
def retrieval_regressions(spark, sf_dir):
    return evaluate.regressions(
        retrieval_metrics(spark, sf_dir), {"hit_rate_at_1": 0.99, "hit_rate_at_5": 0.0, "mrr": 0.999}
    )


@query
def benchmark_containment(spark, sf_dir):
    """Documents that hold a whole benchmark text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return search.containing(
        table(spark, sf_dir, "documents").select("doc_id", "text"), items, "text", "phrase"
    ).select("item_id", "doc_id")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks for each query: a vector, a phrase and words; vectors belong to chunks by number."""
    e = table(spark, sf_dir, "embeddings")
    c = chunks(spark, sf_dir).withColumns(
        {
            "end_line": F.lit(9),
            "start_instruction": F.lit(None).cast("long"),
            "end_instruction": F.lit(None).cast("long"),
        }
    )
    named = e.join(
        c.select("id", "doc_id"), F.col("vec_id") == F.col("doc_id")
    ).select("id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query_id"),
        F.lit(PHRASE).alias("phrase"),
        F.array(*[F.lit(w) for w in WORDS]).alias("words"),
        F.col("embedding").alias("vector"),
    )
    told = c.where("doc_id % 3 = 0").select(
        F.col("id").alias("scope"), F.concat(F.lit("summary of "), "id").alias("content")
    )
    return retrieval.hybrid(c, named, asked, 20, summaries=told, known=["src1/", "src2/fr/doc_1"])


@query
def hybrid_rank(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", F.col("rank").cast("long"), "id", "score", "summary")


@query
def hybrid_packed(spark, sf_dir):
    return retrieval.pack(_hybrid(spark, sf_dir), 3000, overhead=8).select(
        "query_id",
        F.col("rank").cast("long"),
        "id",
        "representation",
        "estimated_tokens",
        F.sha2("text", 256).alias("text_sha256"),
    )


@query
def pack_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("query_id"),
        F.col("doc_id").cast("string").alias("id"),
        F.octet_length("text").alias("source_bytes"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(80)).alias("summary_bytes"),
        F.col("doc_id").alias("rank"),
    )
    return ranking.pack_budget(d, 6000, overhead=8).select(
        "query_id", F.col("rank").cast("long"), "id", "representation", "estimated_tokens"
    )


@query
def summary_file(spark, sf_dir):
    w = chunking.line_windows(files(spark, sf_dir), size=4, overlap=1)
    return rollup.file_summaries(w).select(
        "path",
        "chunks",
        "methods",
        F.array_join("indicators", ",").alias("indicators"),
        F.col("symbols_count").alias("symbols"),
    )


@query
def summary_package(spark, sf_dir):
    return rollup.package_summaries(chunks(spark, sf_dir)).select("package", "files", "chunks", "content")


@query
def summary_project(spark, sf_dir):
    return rollup.project_summary(chunks(spark, sf_dir))


@query
def summary_union_levels(spark, sf_dir):
    return rollup.levels(chunks(spark, sf_dir))


@query
def report_table(spark, sf_dir):
    return report.markdown_table(
        rollup.package_summaries(chunks(spark, sf_dir)), ["package", "files", "chunks"], ["package"], most=30
    )


@query
def indicators(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(X.indicators(F.col("html")), ",").alias("indicators"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source texts: names, reflection, encoded strings and jumps depend on the part."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(
        F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("p_size") % 26 + 1, F.lit(1))
    )
    body = F.when(
        i % 7 == 0, 'Object o = Class.forName("x").invoke (y);'
    ).when(i % 7 < 3, "switch (x) { default: goto z; }").otherwise("return 1;")
    text = F.when(
        i % 5 == 0, F.concat(F.lit('"'), F.repeat(F.lit("QUJD"), F.lit(10)), F.lit('"'))
    ).otherwise(F.lit('"00ff"'))
    code = F.concat(
        F.lit("class "),
        name,
        F.lit(" {\n  void "),
        name,
        (i % 3).cast("string"),
        F.lit("() { "),
        body,
        F.lit(" }\n  String s = "),
        text,
        F.lit(";\n}\n"),
    )
    return signals.file_signals(p.select((i % 10).alias("k"), code.alias("content")))


@query
def signal_scores(spark, sf_dir):
    s = signals.scores(signals.totals(_signals(spark, sf_dir), "k"))
    return s.select(
        "k",
        "files",
        "names",
        "short_names",
        "reflection",
        "encoded",
        "control",
        "lines",
        *[F.round(f"{x}_score", 6).alias(f"{x}_score") for x in ("name", "reflection", "string", "control")]
    )


@query
def signal_classification(spark, sf_dir):
    return signals.classify(
        signals.scores(signals.totals(_signals(spark, sf_dir), "k"))
    ).select("k", "kind", "confidence")


LICENSES = {"Mit": "MIT License", "Apache": "apache license", "Gpl": "General Public"}


@query
def product_markers(spark, sf_dir):
    return signals.product_markers(chunks(spark, sf_dir), LICENSES)


@query
def marker_locators(spark, sf_dir):
    told = signals.marker_locators(signals.product_markers(chunks(spark, sf_dir), LICENSES), most=3)
    return told.select("product", "files", F.array_join("locators", ",").alias("locators"))


@query
def marked_classification(spark, sf_dir):
    """Documents by language: a product's marker in one of its files decides where nothing else does."""
    files_ = chunks(spark, sf_dir).select("path", "content", F.col("language").alias("k"))
    marks = signals.product_markers(files_, {"Gpl": LICENSES["Gpl"]}).join(files_.select("path", "k"), "path")
    scored = signals.scores(signals.totals(signals.file_signals(files_), "k")).join(
        marks.groupBy("k").agg(F.lit(True).alias("marked")), "k", "left"
    )
    return signals.classify(scored, F.coalesce("marked", F.lit(False))).select(
        "k", F.coalesce("marked", F.lit(False)).alias("marked"), "kind", "confidence"
    )


@query
def search_regex_bounded(spark, sf_dir):
    """As search_regex_topk, but all matches, and a pattern that may take exponential time under a limit for each chunk."""
    found = search.search_bounded(chunks(spark, sf_dir), "th(?:[a-z]+)+tion", seconds=20.0, most_lines=3)
    return found.select("id", "state", "match_count", "distinct_match_line_count", F.array_join("match_lines", ",").alias("match_lines"))


@query
def identifier_entropy(spark, sf_dir):
    return signals.name_entropy(_signals(spark, sf_dir), "k")


@query
def url_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_pattern(F.col("url")).alias("pattern"))


@query
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))


@query
def endpoint_groups(spark, sf_dir):
    return netflow.endpoints(flows(spark, sf_dir)).select(
        "pattern", "method", "host", "flow_count", F.size("urls").cast("long").alias("urls")
    )


@query
def header_redaction(spark, sf_dir):
    h = flows(spark, sf_dir).select("id", X.redact_headers(F.col("request_headers")).alias("h"))
    return h.select("id", F.col("h")["Host"].alias("host"), F.col("h")["Cookie"].alias("cookie"))


@query
def flow_documents(spark, sf_dir):
    return netflow.flow_documents(flows(spark, sf_dir))


@query
def flow_traffic(spark, sf_dir):
    return netflow.traffic(flows(spark, sf_dir))


@query
def flow_search(spark, sf_dir):
    return netflow.search_flows(flows(spark, sf_dir), "EXAMPLE.com", 20, "id").select("id", "url")


@query
def flow_merge_live_history(spark, sf_dir):
    f = flows(spark, sf_dir).select("id", X.url_pattern(F.col("url")).alias("url"))
    return netflow.merge_live(f.where("id % 4 = 0"), f)


@query
def hook_event_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    noisy = e.select(
        "event_id",
        F.concat(
            F.lit("[Device::1]-> {\"type\": \""),
            "event_type",
            F.lit('", "class": "c'),
            (F.col("user_id") % 5).cast("string"),
            F.lit('", "metadata": '),
            "props",
            F.lit("}"),
        ).alias("value"),
    )
    got = corpus.hook_events(
        noisy.where("event_id % 11 <> 0").union(
            noisy.where("event_id % 11 = 0").select("event_id", F.lit("no json here"))
        )
    )
    return got.groupBy("hook_type", "class_name").agg(F.count("*").alias("n"))


@query
def hook_event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        "event_type", F.get_json_object("props", "$.k").alias("k")
    ).agg(F.count("*").alias("n"))


@query
def latest_run_per_tool(spark, sf_dir):
    return lineage.latest(
        runs(spark, sf_dir), ["project_id", "tool"], [F.desc("started_at"), F.desc("run_id")]
    ).select("project_id", "tool", "run_id", "started_at")


@query
def lineage_chain(spark, sf_dir):
    tools = ["click", "purchase", "view"]
    return lineage.chain(runs(spark, sf_dir), tools, "project_id").select("project_id", *[f"{t}_run" for t in tools])


@query
def loop_detection(spark, sf_dir):
    return lineage.repeated_calls(
        runs(spark, sf_dir), "project_id", ["tool"], ["started_at", "run_id"], 3
    ).select("run_id", "nth", "looping")


@query
def dependency_ready(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    steps = c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("step_id"),
        F.when(F.length("text") % 3 == 0, "failed").otherwise("completed").alias("status"),
        F.when(
            F.col("turn") > 0, F.array(F.col("turn") - 1)
        ).otherwise(F.array().cast("array<bigint>")).alias("depends_on"),
    )
    return lineage.ready_steps(steps).select("session_id", "step_id", "status", "ready")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 0 or toxic = 1").select(
        F.col("doc_id").alias("finding_id"),
        F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 100000000).alias("evidence_ids"),
    )


@query
def finding_evidence_semi(spark, sf_dir):
    evidence = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return lineage.findings_with(_findings(spark, sf_dir), evidence).select("finding_id")


@query
def finding_evidence_missing(spark, sf_dir):
    return lineage.missing_evidence(
        _findings(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    )


@query
def correlation_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("edge_id"),
        (F.col("event_id") % 3000).alias("source_id"),
        (F.col("user_id") % 700).alias("network_id"),
        F.lit(0.8).alias("confidence"),
    )
    known = {
        "source": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")),
        "network": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")),
    }
    return lineage.correlate(edges, known).select(
        "edge_id", "source_id", "network_id", "confidence", "source_found", "network_found"
    )


@query
def orphan_orders(spark, sf_dir):
    return lineage.orphans(
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "customer").where("c_acctbal > 0"),
        "o_custkey",
        "c_custkey",
    ).select("o_orderkey", "o_custkey")


@query
def usage_ledger(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("provider"),
        F.col("l_quantity").cast("long").alias("tokens"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("actual_cost"),
    )
    return lineage.usage(li, ["model", "provider"])


@query
def store_upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return store.upsert(
        e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], [F.desc("ts"), F.desc("event_id")]
    )


@query
def store_insert_absent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "doc_id")
    return store.insert_absent(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), ["sha"]).select("sha")


@query
def store_update_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return store.update(
        o, o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey", ["o_orderstatus"]
    )


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as components: every kind with every attribute, filter, SDK and permission, by the digits of the key."""
    i = F.col("p_partkey")
    digit = lambda by, n: (F.floor(i / by) % n).cast("int")
    one = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    return table(spark, sf_dir, "part").select(
        i.alias("id"),
        one(["activity", "service", "provider"], digit(1, 3)).alias("kind"),
        one(["true", "false", "@bool/x", None], digit(3, 4)).alias("exported_attribute"),
        (digit(12, 2) == 0).alias("has_filter"),
        one([16, 17, 30, 31, None], digit(24, 5)).alias("sdk"),
        one(["p.OWN", None], digit(120, 2)).alias("permission"),
        F.when(F.col("p_size") % 2 == 0, "p.READ").alias("read_permission"),
        F.lit(None).cast("string").alias("write_permission"),
        F.when(F.col("p_size") % 5 == 0, False).when(F.col("p_size") % 5 == 1, True).alias("enabled"),
        F.when(F.col("p_size") % 3 == 0, "p.APP").alias("application_permission"),
    )


@query
def exported_state_table(spark, sf_dir):
    return manifest.export_state(_components(spark, sf_dir)).select("id", "exported", "exported_source", "violation")


@query
def permission_inheritance(spark, sf_dir):
    return manifest.inherit_permissions(_components(spark, sf_dir), F.col("application_permission")).select(
        "id", "effective_permission", "permission_source", "effective_read", "effective_write"
    )


@query
def attack_surface(spark, sf_dir):
    c = _components(spark, sf_dir)
    s = manifest.attack_surface(manifest.export_state(manifest.inherit_permissions(c, F.col("application_permission"))))
    return s.select("id", "reason", F.array_join("unguarded", ",").alias("unguarded"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as manifests: each asks for permissions and has an activity with a filter and a provider."""
    i = F.col("s_suppkey")
    space = "xmlns:android='http://schemas.android.com/apk/res/android'"
    asked = F.when(i % 3 == 0, "<uses-permission android:name='android.permission.SEND_SMS' android:maxSdkVersion='22'/>").otherwise("")
    text = F.concat(
        F.lit(f"<manifest {space} package='p"), i.cast("string"), F.lit("'><uses-permission android:name='android.permission.INTERNET'/>"), asked,
        F.lit("<uses-sdk android:targetSdkVersion='"), F.when(i % 4 == 0, "@integer/x").otherwise((i % 40).cast("string")),
        F.lit("'/><application android:debuggable='"), F.when(i % 5 == 0, "@bool/d").otherwise("false"),
        F.lit("'><activity android:name='.A"), (i % 7).cast("string"), F.lit("'><intent-filter><action android:name='view'/><data android:scheme='h"),
        (i % 2).cast("string"), F.lit("' android:host='x'/></intent-filter></activity><provider android:name='q.P' android:permission='own'/></application></manifest>"),
    )
    return manifests.elements(table(spark, sf_dir, "supplier").select(i.cast("string").alias("file"), text.alias("content")))


@query
def manifest_permissions(spark, sf_dir):
    return manifests.permissions(_manifests(spark, sf_dir))


@query
def manifest_filters(spark, sf_dir):
    f = manifests.filters(_manifests(spark, sf_dir))
    pairs = F.array_join(F.transform(F.map_entries(F.get("data", F.lit(0))), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return f.select("file", "component", "locator", F.array_join("actions", ",").alias("actions"), pairs.alias("data"))


@query
def manifest_warnings(spark, sf_dir):
    """Warnings of the elements and of the export rules, by place."""
    rows = _manifests(spark, sf_dir)
    sdk = manifest.target_sdk(F.col("target_sdk"), F.col("min_sdk"))
    state = manifest.export_state(manifests.components(rows).where("problem is null").withColumn("sdk", sdk))
    return manifests.warnings(rows).unionByName(manifest.export_warnings(state))


@query
def manifest_surface(spark, sf_dir):
    """Components that may be reachable, with the places that say so."""
    sdk = manifest.target_sdk(F.col("target_sdk"), F.col("min_sdk"))
    c = manifests.components(_manifests(spark, sf_dir)).where("problem is null").withColumn("sdk", sdk)
    s = manifest.attack_surface(manifest.export_state(manifest.inherit_permissions(c, F.col("application_permission"))))
    return s.select("file", "name", "reason", F.array_join("evidence", ",").alias("evidence"))


@query
def hash_embedding(spark, sf_dir):
    """Rows only: DuckDB has no BLAKE2b."""
    v = vectors.hash_embedding(files(spark, sf_dir).select("path", "content"), 384)
    return v.select("path", F.round(vectors.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


@query
def flow_stream_docs(spark, sf_dir):
    """The events table as a stream of flows that pass once by id, written as they come; their endpoints when the feed is used up."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    url = F.concat(
        F.lit("https://h"), (F.col("user_id") % 3).cast("string"), F.lit("/u/"), F.col("event_id").cast("string")
    )
    flow = stream.select(
        F.col("event_id").cast("string").alias("id"),
        url.alias("url"),
        F.col("event_type").alias("method"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    out = shared_folder(spark, "flows")
    streaming.run_available(streaming.once(flow, "1 day"), f"{out}/rows", f"{out}/checkpoint")
    return streaming.running_endpoints(spark.read.parquet(f"{out}/rows")).select(
        "pattern", "method", "host", "flow_count"
    )


from quarrylight.plans import records  # noqa: E402, F401  (its queries register themselves)
