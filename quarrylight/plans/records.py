"""Named queries over packages, plans, evidence, lineage and device lines. The tables stand in for these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylight.functions import text as X
from quarrylight.operators import agentlog, inventory, lineage, manifest, netflow, report, rollup
from quarrylight.plans.catalogue import chunks, flows, query, table
from quarrylight.sources import devices

TOOLS = [
    "apk_import",
    "source_index",
    "source_search",
    "context_query",
    "proxy_start",
    "frida_run",
    "adb_logcat",
    "static_report"
]


def _text(*parts) -> F.Column:
    """Texts and columns, joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of packages: the source is the package, the name depends on the id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    names = [
        _text("assets/a", i),
        _text("res/layout/x", i, ".xml"),
        _text("lib/arm64/lib", i, ".so"),
        _text("lib/odd", i),
        _text("classes", i % 40 + 2, ".dex"),
        _text("META-INF/C", i, ".RSA"),
        _text("other", i)
    ]
    name = F.element_at(F.array(*names), (i % 7 + 1).cast("int"))
    return d.select(
        F.col("source").alias("package"),
        name.alias("name"),
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        "doc_id",
    )


@query
def member_category_totals(spark, sf_dir):
    return inventory.category_totals(_members(spark, sf_dir), "doc_id")


@query
def package_tree_hash(spark, sf_dir):
    return inventory.tree_hash(_members(spark, sf_dir), "package")


@query
def decompiler_cache_state(spark, sf_dir):
    now = inventory.tree_hash(
        _members(spark, sf_dir).where("doc_id % 5 <> 0 or package not like '%1'"), "package"
    ).where("package not like '%2'")
    then = inventory.tree_hash(_members(spark, sf_dir), "package").where("package not like '%3'")
    return inventory.cache_state(then, now, "package")


@query
def content_addressed_import(spark, sf_dir):
    f = _members(spark, sf_dir).select(F.lit("prj_1").alias("project_id"), "name", "size", "sha256", "doc_id")
    stored = f.where("doc_id % 3 = 0").select(
        "project_id",
        "sha256",
        F.when(F.col("doc_id") % 2 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"),
        "doc_id",
    )
    stored = lineage.latest(stored, ["sha256"], [F.desc("doc_id")])
    return inventory.import_blobs(f, stored).select("sha256", "size", "name", "stored_path", "state")


@query
def bundle_import(spark, sf_dir):
    m = _members(spark, sf_dir).where("doc_id % 7 < 4")
    seen = m.select(F.col("package").alias("bundle"), "name", "size", "sha256", "doc_id")
    stored = seen.where("doc_id % 11 <> 0").withColumn(
        "size", F.when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size"))
    )
    return inventory.import_bundle(seen, stored).select("bundle", "name", "state")


@query
def base_package_choice(spark, sf_dir):
    """Conversations as bundles of their turns."""
    c = table(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") == F.col("conv_id") % 4, "x/Base.APK").otherwise(_text("split_", F.col("turn"), ".apk"))
    p = c.select(
        F.col("conv_id").alias("bundle"), name.alias("name"), (F.col("role") == "user").alias("has_dex"), "turn"
    )
    told = p.where("bundle % 5 = 0 and turn <= bundle % 3").select("bundle", "name")
    return inventory.base_packages(p, told)


@query
def member_references(spark, sf_dir):
    m = _members(spark, sf_dir).select(F.col("package").alias("bundle"), "name", "doc_id")
    asked = m.select(
        "bundle",
        F.when(F.col("doc_id") % 3 == 0, _text("./", F.col("name"))).when(
            F.col("doc_id") % 3 == 1, _text("x\\", F.substring_index("name", "/", -1))
        ).otherwise(_text("gone", F.col("doc_id"))).alias("reference"),
    )
    return inventory.resolve(asked.distinct(), m)


@query
def split_ids(spark, sf_dir):
    return _members(spark, sf_dir).select(
        "package",
        "name",
        inventory.split_id(F.concat(F.lit("a/split_"), F.substring_index("name", "/", -1))).alias("split_id"),
    )


def _output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines that a decompiler prints; users are runs."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 5 == 0, _text("ERROR - class ", F.col("event_id") % 20)).when(F.col("event_id") % 5 == 1, _text("  warning: method ", F.col("event_id") % 30)).when(
        F.col("event_id") % 50 == 2, _text("finished with errors, count: ", F.col("event_id") % 97)
    ).otherwise("processing")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("n"),
        line.alias("line"),
        (F.col("user_id") % 2).alias("code"),
    )


@query
def tool_diagnostics(spark, sf_dir):
    return inventory.diagnostics(
        _output(spark, sf_dir).where("run_id % 3 <> 1 or line = 'processing'"), "run_id", "code"
    )


@query
def reported_error_counts(spark, sf_dir):
    return inventory.reported_errors(_output(spark, sf_dir), "run_id")


@query
def nested_evidence_count(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    signer = F.struct(
        F.array_repeat(F.lit("c"), F.lit(2)).alias("certificates"),
        F.array_repeat(F.lit("s"), F.lit(3)).alias("signatures"),
    )
    repeat = lambda k: F.array_repeat(F.lit("x"), F.col("n") * k)
    rows = c.select(
        "conv_id",
        repeat(1).alias("assets"),
        repeat(2).alias("resources"),
        repeat(0).alias("native"),
        repeat(1).alias("dex"),
        repeat(0).alias("legacy"),
        repeat(1).alias("unsupported"),
        F.array_repeat(F.struct(F.array_repeat(signer, F.col("n")).alias("signers")), F.lit(2)).alias("schemes"),
    )
    return inventory.evidence_count(rows).select("conv_id", "evidence")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tool = F.element_at(
        F.array(*[F.lit(t) for t in [*TOOLS, "no_such_tool"]]),
        ((F.col("conv_id") + F.col("turn") * 5) % 9 + 1).cast("int"),
    )
    return c.select(
        F.col("conv_id").alias("plan_id"),
        F.col("turn").cast("int").alias("step"),
        tool.alias("tool"),
        F.array((F.col("turn") - 1 + F.col("conv_id") % 3).cast("int")).alias("depends_on"),
        (F.length("text") * 1.0).alias("timeout"),
    )


@query
def plan_validation(spark, sf_dir):
    s = _steps(spark, sf_dir)
    goals = s.select("plan_id").distinct().withColumn(
        "goal",
        F.when(
            F.col("plan_id") % 2 == 0, "Look at it and finish the plan with `static_report`."
        ).otherwise("Look at it."),
    )
    return agentlog.plan_problems(s, goals, TOOLS, 3, 200.0)


@query
def scope_gate(spark, sf_dir):
    s = _steps(spark, sf_dir)
    i = F.col("plan_id")
    devices_ = F.when(i % 3 == 0, F.array(F.lit("emu-1"))).when(i % 3 == 1, F.array().cast("array<string>"))
    serial, package = _text("emu-", F.col("step")), F.when(F.col("step") % 2 == 0, "app.a").otherwise("app.b")
    denied = agentlog.scope_denial(
        F.col("tool"), serial, package, i % 4 != 0, devices_, F.array(F.lit("app.a")), i % 5 == 0
    )
    return s.select(
        "plan_id", "step", "tool", denied.alias("denied"), agentlog.evidence_kind(F.col("tool")).alias("evidence_kind")
    )


@query
def memory_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    words = lambda s: F.transform(F.slice(F.split(F.col("text"), " "), s, 4), F.lower)
    return c.select("conv_id", "turn", F.array_join(agentlog.merge_memory(words(1), words(3)), "|").alias("memory"))


@query
def memory_order(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    memory = l.groupBy((F.col("doc_id") % 50).alias("session_id")).agg(
        F.reverse(F.array_sort(F.collect_list("doc_id"))).alias("finding_ids")
    )
    return agentlog.in_memory_order(
        memory, l.where("quality = 1").select(F.col("doc_id").alias("finding_id"), "toxic")
    ).select("session_id", F.col("place").cast("long"), "finding_id", "toxic")


@query
def ordered_distinct(spark, sf_dir):
    return agentlog.once_in_order(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query
def source_references(spark, sf_dir):
    """Outputs with good and bad places, as JSON."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    place = lambda n: _text(
        '{"path":"p',
        i,
        '","start_line":',
        i % 90 + n,
        ',"end_line":',
        F.when(i % 4 == n, F.lit('"9"')).otherwise((i % 90 + n + 3).cast("string")),
        ',"symbol":"',
        F.when(i % 2 == 0, "").otherwise("s"),
        '"}',
    )
    output = _text('{"hits":[', place(0), ",", place(1), ',7,{"path":5,"start_line":1,"end_line":2}]}')
    tool = F.when(i % 3 == 0, "source_search").when(i % 3 == 1, "context_query").otherwise("apk_import")
    r = d.select("doc_id", F.posexplode(agentlog.source_references(tool, output)).alias("nth", "r"))
    return r.select("doc_id", F.col("nth").cast("long"), "r.path", "r.start_line", "r.end_line", "r.symbol")


@query
def reviewer_payload(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    p = agentlog.reviewer_payload(
        F.lit("goal"),
        F.lit("t"),
        F.repeat(F.lit("ab"), (F.col("doc_id") % 3 * 15000).cast("int")),
        F.lit(None).cast("string"),
        F.col("doc_id"),
    )
    return d.select("doc_id", F.sha2(p, 256).alias("payload_sha256"), F.length(p).cast("long").alias("chars"))


@query
def scope_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.groupBy((F.col("c_custkey") % 30).alias("project_id"), F.col("c_mktsegment").alias("kind")).agg(
        F.collect_set(
            F.when(F.col("c_nationkey") % 5 == 0, " ").otherwise(_text("N", F.col("c_nationkey")))
        ).alias("values")
    )
    return agentlog.scope_labels(s).select("project_id", F.array_join("labels", ",").alias("labels"))


@query
def run_estimate(spark, sf_dir):
    return agentlog.run_estimate(table(spark, sf_dir, "nation").select("n_nationkey"), F.col("n_nationkey"))


@query
def default_artifact(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select(
        F.col("conv_id").alias("project_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("artifact_id"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "in/BASE.apk").otherwise("x.apk").alias("original_name"),
        "turn",
    )
    return agentlog.default_artifact(a.where("project_id % 4 <> 0 or turn = 0"))


@query
def artifact_ownership(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 25).alias("project_id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("artifact_id"),
    )
    return agentlog.owned(
        o,
        table(spark, sf_dir, "customer").select(
            F.col("c_nationkey").cast("long").alias("project_id"), F.col("c_custkey").alias("artifact_id")
        ),
    ).select("o_orderkey", "artifact_id")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").where("doc_id % 4 <> 0")
    ref = F.struct(
        _text("src/F", F.col("doc_id"), ".java").alias("path"),
        F.col("doc_id").alias("start_line"),
        (F.col("doc_id") + F.col("quality")).alias("end_line"),
        F.when(F.col("toxic") == 1, "Sym").alias("symbol"),
    )
    return l.select(
        F.col("doc_id").alias("evidence_id"),
        _text("tool-run:", F.col("doc_id")).alias("locator"),
        F.lit("seen").alias("summary"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("tool_run_id"),
        F.array(ref).alias("source_references"),
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return l.select(
        F.col("doc_id").alias("finding_id"),
        (F.col("doc_id") % 20).alias("session_id"),
        F.array(F.col("doc_id"), F.col("doc_id") + 1).alias("evidence_ids"),
        _text("Finding ", F.col("doc_id")).alias("title"),
        F.when(F.col("toxic") == 1, "high").otherwise("low").alias("severity"),
        (F.col("doc_id") % 4 / 4.0).alias("confidence"),
    )


@query
def finding_lines(spark, sf_dir):
    r = agentlog.finding_lines(_findings(spark, sf_dir), _evidence(spark, sf_dir))
    return r.select("finding_id", F.col("nth").cast("long"), F.col("sub").cast("long"), "line")


@query
def session_report(spark, sf_dir):
    f = _findings(spark, sf_dir)
    sessions = spark.range(25).select(
        F.col("id").alias("session_id"),
        _text("Goal\n ", F.col("id")).alias("goal"),
        F.lit("completed").alias("status"),
        (F.col("id") / 8.0).alias("cost"),
    )
    steps = spark.range(60).select(
        (F.col("id") % 20).alias("session_id"),
        F.floor(F.col("id") / 20).cast("int").alias("step"),
        F.lit("look").alias("objective"),
        F.lit("source_search").alias("tool"),
        F.lit("completed").alias("status"),
        F.lit(1).alias("attempts"),
    )
    return agentlog.session_report(sessions, steps, f, agentlog.finding_lines(f, _evidence(spark, sf_dir)))


@query
def last_flows(spark, sf_dir):
    return agentlog.last_rows(flows(spark, sf_dir), "id", 15).select("id", "url")


@query
def schema_version(spark, sf_dir):
    return agentlog.schema_version(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("version")))


@query
def report_lineage(spark, sf_dir):
    """Events as tool runs of 40 projects; digests, trees and indexes follow from ids."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    tool = F.element_at(
        F.array(
            *[
                F.lit(t)
                for t in (
                    "apk_import",
                    "apk_inspect",
                    "apk_metadata",
                    "jadx_decompile",
                    "manifest_analyze",
                    "source_index",
                    "context_query",
                    "detect_obfuscation",
                )
            ]
        ),
        (i % 8 + 1).cast("int"),
    )
    tree = _text("/w/t", i % 3)
    runs = e.select(
        (F.col("user_id") % 40).alias("project_id"),
        i.alias("run_id"),
        tool.alias("tool"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        F.col("ts").alias("started_at"),
        _text("sha", F.col("user_id") % 3).alias("apk_sha"),
        F.when(i % 5 > 0, _text("art", F.col("user_id") % 2)).alias("artifact_id"),
        F.when(F.col("user_id") % 4 > 0, tree).alias("output_dir"),
        F.when(i % 2 == 0, _text(tree, "/AndroidManifest.xml")).otherwise("/w/t1x/m.xml").alias("path"),
        _text("idx", F.col("user_id") % 2).alias("index_id"),
        _text(tree, "/sources").alias("source_root"),
    )
    return lineage.report_lineage(runs)


@query
def report_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), "doc_id")
    parts = {
        "project": d,
        "jadx": d.where("doc_id % 40 = 0"),
        "manifest": d.where("doc_id % 90 = 1"),
        "source_evidence": d.where("doc_id % 60 = 2"),
    }
    return report.section_states(parts)


def _query_runs(spark, sf_dir):
    """Orders as runs of a query: their lines are its matches, some of them broken."""
    line = table(spark, sf_dir, "lineitem")
    whole = F.to_json(
        F.struct(
            F.concat(F.lit("src/"), F.col("l_partkey").cast("string")).alias("path"),
            F.col("l_linenumber").cast("int").alias("start_line"),
            F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") + 9).cast("int")).alias("end_line"),
            F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("symbol"),
            F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("chunk_id"),
        )
    )
    broken = F.when(F.col("l_linenumber") == 5, F.lit('{"path":1,"start_line":1,"end_line":2}')).when(F.col("l_linenumber") == 6, F.lit('"text"')).otherwise(whole)
    matches = line.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", broken.alias("j")))), lambda x: x.j), ",").alias("m")
    )
    k = F.col("l_orderkey")
    output = F.when(k % 7 == 0, F.lit("{broken")).when(k % 7 == 1, F.lit('{"matches":{}}')).otherwise(
        F.concat(F.when(k % 7 == 2, F.lit("{")).otherwise(F.concat(F.lit('{"query":"q'), k.cast("string"), F.lit('",'))), F.lit('"matches":['), "m", F.lit("]}"))
    )
    return matches.select(k.alias("run_id"), output.alias("output"))


@query
def report_source_references(spark, sf_dir):
    """References into the sources from the outputs of query runs; broken outputs and matches are left out."""
    return report.source_references(_query_runs(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query
def report_index_inputs(spark, sf_dir):
    """Index metrics and warnings from the outputs of index runs."""
    n = F.col("s_suppkey")
    warning = F.concat(F.lit('[{"path":"p","reason":"r'), n.cast("string"), F.lit('","detail":"d"},{"path":"p","reason":1,"detail":"d"},7]'))
    output = F.when(n % 5 == 0, F.lit('{"index":[]}')).otherwise(
        F.concat(F.lit('{"index":{"id":"i'), n.cast("string"), F.lit('"},"chunk_count":'), n.cast("string"), F.lit(',"source_index_warnings":'), warning, F.lit("}"))
    )
    runs = table(spark, sf_dir, "supplier").select(n.alias("run_id"), output.alias("output"))
    told = report.index_metrics(runs).join(report.index_warnings(runs).select("run_id", "warning"), "run_id", "left")
    return told.select("run_id", "index_id", "source_file_count", "chunk_count", "vector_document_count", "summary_count", "warning")


@query
def static_reports(spark, sf_dir):
    """A report for each nation: suppliers as packages, large orders' customers as findings, parts of its runs as provenance."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("title"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"), "s_suppkey", "s_name")
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), "c_custkey", "c_mktsegment")
    sections = {
        "package": report.section_tables(supplier, "project_id", ["s_suppkey", "s_name"], ["s_suppkey"], most=3),
        "manifest": report.section_tables(customer.where("c_custkey % 20 = 0"), "project_id", ["c_custkey", "c_mktsegment"], ["c_custkey"], most=2),
        "obfuscation": report.section_tables(customer.where("c_custkey % 90 = 1"), "project_id", ["c_custkey"], ["c_custkey"], most=2),
    }
    runs = report.section_tables(supplier.where("s_suppkey % 4 <> 0"), "project_id", ["s_suppkey"], ["s_suppkey"], most=5)
    told = report.project_reports(nation, "for study", sections, runs, ["no device"])
    return told.select("project_id", "text", "sha256", F.array_join("missing", ",").alias("missing"))


@query
def retrieval_benchmark_json(spark, sf_dir):
    from quarrylight.plans.catalogue import retrieval_metrics

    return report.benchmark_json(retrieval_metrics(spark, sf_dir))


@query
def retrieval_by_id_or_path(spark, sf_dir):
    """The nearest vectors, relevant by id or by path; a vector's path is its label."""
    from quarrylight.operators import evaluate
    from quarrylight.plans.catalogue import knn_exact

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    path = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("path"))
    found = knn_exact(spark, sf_dir).where("id <> query_id").select(
        F.col("query_id").alias("case_id"), "rank", "id"
    ).join(path, "id")
    cases = e.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("case_id"),
        F.array(F.col("vec_id") + 1, F.col("vec_id") + 2).alias("expected_ids"),
        F.array(((F.col("label") + 1) % 5).cast("string")).alias("expected_paths"),
    )
    return evaluate.relevant(found, cases).select(
        "case_id", F.col("first_rank").cast("long"), F.round("reciprocal_rank", 6).alias("reciprocal_rank")
    )


@query
def method_summaries(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("end_line", F.lit(9))
    return rollup.method_summaries(c).select(
        "id", F.sha2("content", 256).alias("content_sha256"), F.length("content").cast("long").alias("chars")
    )


@query
def captured_bodies(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.col("html").alias("request_body"), F.left("html", F.lit(20)).alias("response_body")
    )
    return netflow.captured(p, 100).select(
        "page_id", F.md5("request_body").alias("body_md5"), "request_body_cut", "response_body_cut"
    )


@query
def device_list(spark, sf_dir):
    c = table(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 7 == 0, "List of devices attached").when(F.col("s_suppkey") % 7 == 1, "* daemon started").when(F.col("s_suppkey") % 7 == 2, _text("only", F.col("s_suppkey"))).otherwise(
        _text(
            "  emu-",
            F.col("s_suppkey"),
            "\tdevice product:p",
            F.col("s_nationkey"),
            " model:M1 transport_id:",
            F.col("s_suppkey") % 9,
        )
    )
    return devices.devices(c.select(line.alias("value")))


@query
def process_list(spark, sf_dir):
    c = table(spark, sf_dir, "supplier")
    return devices.processes(
        c.select(
            F.when(F.col("s_suppkey") % 3 == 0, " PID  Name").otherwise(
                _text("  ", F.col("s_suppkey"), "  app ", F.col("s_name"), " ")
            ).alias("value")
        )
    )


@query
def log_lines(spark, sf_dir):
    c = table(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 5 == 0, "--------- beginning of main").otherwise(
        _text("01-02 03:04:05.678  ", F.col("s_suppkey"), "  12 I Tag", F.col("s_nationkey"), " : m: ", F.col("s_name"))
    )
    return devices.log_lines(c.select(line.alias("value"))).select("at", "pid", "tid", "level", "tag", "message")


@query
def permission_rows(spark, sf_dir):
    """Permissions, SDK texts and flags: dangerous ones, the effective SDK, three-valued flags and their conjunction."""
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    name = F.when(i % 3 == 0, "android.permission.CAMERA").when(
        i % 3 == 1, "android.permission.INTERNET"
    ).otherwise("READ_SMS")
    target, least = F.when(
        i % 4 == 0, F.lit(None).cast("string")
    ).when(i % 4 == 1, "33").when(i % 4 == 2, "x").otherwise("16"), F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise("21")
    flag = lambda n: F.element_at(F.array(F.lit("true"), F.lit("FALSE"), F.lit("@bool/a")), (i % n % 3 + 1).cast("int"))
    both = manifest.tri_state(flag(7)) & manifest.tri_state(flag(11))
    return p.select(
        "p_partkey",
        manifest.dangerous(name).alias("dangerous"),
        manifest.target_sdk(target, least).cast("long").alias("sdk"),
        both.alias("enabled"),
    )


@query
def slugs_and_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.when(
        F.col("p_partkey") % 4 == 0, _text("a\\", F.col("p_name"), ".kt")
    ).when(F.col("p_partkey") % 4 == 1, "../x.java").when(F.col("p_partkey") % 4 == 2, "/abs/y.smali").otherwise(_text(
        "b/c/", F.col("p_brand"), ".JAVA"
    ))
    return p.select(
        "p_partkey",
        X.slug(F.col("p_name")).alias("slug"),
        X.normal_path(path).alias("path"),
        X.parent(path).alias("parent"),
        X.language_of(path).alias("language"),
        X.within(path, "b/c").alias("inside"),
    )
