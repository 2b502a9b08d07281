"""Plans, scopes, evidence and working memory of analysis sessions as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylight.functions.text import one_line

# Which tools need a dynamic scope, and the kinds of evidence by the beginning of a tool's name.
DYNAMIC_PREFIXES = ["adb_", "frida_", "proxy_"]
DYNAMIC_TOOLS = ["interaction_wait"]
EVIDENCE_KINDS = {"frida_": "runtime_event", "proxy_": "network_flow"}
OTHER_EVIDENCE = "tool_output"
# Where a tool's output lists its hits, how many become references, and how much output a reviewer sees.
REFERENCE_LISTS = {"source_search": "hits", "context_query": "matches"}
MOST_REFERENCES, MOST_OUTPUT = 20, 40_000
# Tokens that an estimate counts for each model call, and calls beside the steps.
INPUT_TOKENS, OUTPUT_TOKENS, EXTRA_CALLS = 1024, 512, 2

REFERENCE = "array<struct<path:string,start_line:bigint,end_line:bigint,symbol:string>>"


def evidence_kind(tool: Column) -> Column:
    """By the beginning of the tool's name."""
    out = F.lit(OTHER_EVIDENCE)
    for prefix, kind in EVIDENCE_KINDS.items():
        out = F.when(F.startswith(tool, F.lit(prefix)), kind).otherwise(out)
    return out


def scope_denial(
    tool: Column, serial: Column, package: Column, dynamic: Column, devices: Column, packages: Column, proxy: Column
) -> Column:
    """Why a project's scope forbids a step, or null. An empty or null list of devices or packages allows all."""

    def outside(value: Column, allowed: Column) -> Column:
        return value.isNotNull() & (value != "") & (F.coalesce(F.size(allowed), F.lit(0)) > 0) & ~F.coalesce(
            F.array_contains(allowed, value), F.lit(False)
        )

    starts = {p: F.startswith(tool, F.lit(p)) for p in DYNAMIC_PREFIXES}
    needs = tool.isin(DYNAMIC_TOOLS)
    for s in starts.values():
        needs = needs | s
    device, hook = starts["adb_"] | starts["frida_"], starts["frida_"] | (tool == "adb_logcat")
    return (
        F.when(~F.coalesce(needs, F.lit(False)), F.lit(None).cast("string"))
        .when(~F.coalesce(dynamic, F.lit(False)), "dynamic-not-enabled")
        .when(device & outside(serial, devices), "device-not-in-scope")
        .when(hook & outside(package, packages), "package-not-in-scope")
        .when(starts["proxy_"] & ~F.coalesce(proxy, F.lit(False)), "proxy-not-allowed")
    )


def plan_problems(
    steps: DataFrame, goals: DataFrame, tools: list[str], most_steps: int, most_seconds: float
) -> DataFrame:
    """(plan_id, step, problem) for each rule that a plan breaks; step is null for rules of the whole plan.

    steps: (plan_id, step from 0, tool, depends_on array, timeout or null), goals: (plan_id, goal). A dependency is an earlier
    step; a tool is a known one; a timeout is within the limit; a goal that says to finish with a tool has it last.
    """
    of_step = F.array_compact(
        F.array(
            F.when(F.exists("depends_on", lambda d: (d < 0) | (d >= F.col("step"))), "dependency-not-earlier"),
            F.when(~F.coalesce(F.col("tool").isin(tools), F.lit(False)), "unknown-tool"),
            F.when(F.col("timeout") > most_seconds, "timeout-over-limit"),
        )
    )
    each = steps.select(
        "plan_id", "step", F.explode(of_step).alias("problem")
    ).withColumn("step", F.col("step").cast("long"))
    plans = steps.groupBy("plan_id").agg(F.count("*").alias("n"), F.max_by("tool", "step").alias("last"))
    named = F.lit(None).cast("string")
    for tool in reversed(tools):
        told = F.col("goal").rlike(rf"(?i)\b(?:finish|end|conclude)\s+(?:the\s+plan\s+)?with\s+`?{re.escape(tool)}`?\b")
        named = F.when(told & (F.col("last") != tool), tool).otherwise(named)
    whole = plans.join(goals, "plan_id", "left").select(
        "plan_id",
        F.lit(None).cast("long").alias("step"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n") > most_steps, "too-many-steps"),
                    F.when(named.isNotNull(), F.concat(F.lit("final-tool-is-not:"), named)),
                )
            )
        ).alias("problem"),
    )
    return each.union(whole)


def merge_memory(old: Column, new: Column) -> Column:
    """Both, each value once, in the order in which they came first."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))


def in_memory_order(memory: DataFrame, findings: DataFrame, key: str = "session_id") -> DataFrame:
    """memory (key, finding_ids): the findings (finding_id, ...) that it names and that exist, with their place (from 0)."""
    named = memory.select(key, F.posexplode("finding_ids").alias("_at", "finding_id"))
    first = named.groupBy(key, "finding_id").agg(F.min("_at").alias("place"))  # a repeated id counts once
    return first.join(findings, "finding_id")


def source_references(tool: Column, output: Column) -> Column:
    """The first places that a search's output (JSON) names: whole numbers and texts only, others are left out."""
    none = F.array().cast(REFERENCE)
    out = none
    parsed = F.try_parse_json(output)
    for name, key in REFERENCE_LISTS.items():
        listed = F.try_variant_get(parsed, f"$.{key}", "array<variant>")
        kind = lambda x, f: F.schema_of_variant(F.try_variant_get(x, f"$.{f}", "variant"))
        good = F.filter(
            F.slice(listed, 1, MOST_REFERENCES),
            lambda x: (kind(x, "path") == "STRING") & (
                kind(x, "start_line") == "BIGINT"
            ) & (kind(x, "end_line") == "BIGINT"),
        )
        made = F.transform(
            good,
            lambda x: F.struct(
                F.try_variant_get(x, "$.path", "string").alias("path"),
                F.try_variant_get(x, "$.start_line", "bigint").alias("start_line"),
                F.try_variant_get(x, "$.end_line", "bigint").alias("end_line"),
                F.when(
                    (kind(x, "symbol") == "STRING") & (F.try_variant_get(x, "$.symbol", "string") != ""),
                    F.try_variant_get(x, "$.symbol", "string"),
                ).alias("symbol"),
            ),
        )
        out = F.when(tool == name, F.coalesce(made, none)).otherwise(out)
    return out


def reviewer_payload(goal: Column, tool: Column, output: Column, error: Column, remaining: Column) -> Column:
    """JSON with sorted names of what a reviewer sees; the output is cut, and says so, past MOST_OUTPUT characters."""
    cut = F.when(
        F.length(output) > MOST_OUTPUT, F.concat(F.left(output, F.lit(MOST_OUTPUT)), F.lit("...[truncated]"))
    ).otherwise(output)
    whole = F.struct(
        goal.alias("goal"),
        remaining.alias("remaining_step_budget"),
        tool.alias("tool"),
        error.alias("tool_error"),
        cut.alias("tool_output_json"),
    )
    return F.to_json(whole, {"ignoreNullFields": "false"})


def scope_labels(scopes: DataFrame, key: str = "project_id") -> DataFrame:
    """scopes (key, kind, values array): (key, labels): the distinct `kind:value`, ordered without regard to case."""
    named = scopes.select(key, "kind", F.explode("values").alias("v")).where("trim(v) <> ''").select(
        key, F.concat("kind", F.lit(":"), "v").alias("label")
    ).distinct()
    ordered = F.array_sort(F.collect_set(F.struct(F.lower("label").alias("low"), "label")))  # a scope is a short list
    return named.groupBy(key).agg(F.transform(ordered, lambda x: x.label).alias("labels"))


def run_estimate(projects: DataFrame, most_steps: Column) -> DataFrame:
    """Adds the model calls and tokens that a run of at most so many steps is expected to take, and their cost."""
    calls = (most_steps + EXTRA_CALLS).cast("long")
    return projects.withColumns({
        "projected_model_calls": calls,
        "projected_input_tokens": calls * INPUT_TOKENS,
        "projected_output_tokens": calls * OUTPUT_TOKENS,
        "projected_cost_usd": F.lit(0.0),
    })


def owned(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows (project_id, artifact_id or null) whose artifact belongs to their project; a row without one stays."""
    own = artifacts.select("project_id", "artifact_id").distinct()
    return rows.where("artifact_id is null").unionByName(
        rows.where("artifact_id is not null").join(own, ["project_id", "artifact_id"], "left_semi")
    )


def default_artifact(artifacts: DataFrame) -> DataFrame:
    """(project_id, artifact_id, problem): the only base.apk, else the only artifact; more or none of them is a problem."""
    base = F.lower(F.substring_index("original_name", "/", -1)) == "base.apk"
    n = artifacts.groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(base).alias("bases"), F.max("artifact_id").alias("any"), F.max(
            F.when(base, F.col("artifact_id"))
        ).alias("base")
    )
    chosen = F.when(F.col("bases") == 1, F.col("base")).when((F.col("bases") == 0) & (F.col("n") == 1), F.col("any"))
    problem = F.when(F.col("bases") > 1, "several-base-packages").when(
        (F.col("bases") == 0) & (F.col("n") > 1), "no-default-package"
    )
    return n.select("project_id", chosen.alias("artifact_id"), problem.alias("problem"))


def finding_lines(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """A line of an agent report for each piece of evidence of each finding and each of its source references.

    findings: (finding_id, evidence_ids), evidence: (evidence_id, locator, summary, tool_run_id, source_references). Returns
    (finding_id, nth, sub, line): nth is the evidence's place in its finding, sub 0 or the reference's place. Missing evidence says so.
    """
    refs = findings.select("finding_id", F.posexplode("evidence_ids").alias("nth", "evidence_id"))
    met = refs.join(evidence.withColumn("_there", F.lit(True)), "evidence_id", "left")
    own = F.when(F.col("_there").isNull(), F.concat(F.lit("- Missing evidence record `"), F.col("evidence_id").cast("string"), F.lit("`"))).otherwise(
        F.concat(
            F.lit("- `"),
            "locator",
            F.lit("` — "),
            "summary",
            F.lit(" (tool run `"),
            F.coalesce(F.col("tool_run_id").cast("string"), F.lit("none")),
            F.lit("`)"),
        )
    )
    heads = met.select("finding_id", "nth", F.lit(0).alias("sub"), own.alias("line"))
    each = met.select("finding_id", "nth", F.posexplode("source_references").alias("_i", "r"))
    place = F.concat(
        "r.path",
        F.lit(":"),
        F.col("r.start_line").cast("string"),
        F.when(
            F.col("r.end_line") != F.col("r.start_line"), F.concat(F.lit("-"), F.col("r.end_line").cast("string"))
        ).otherwise(F.lit("")),
    )
    symbol = F.when(F.col("r.symbol").isNotNull(), F.concat(F.lit(" — `"), "r.symbol", F.lit("`"))).otherwise(F.lit(""))
    return heads.union(
        each.select(
            "finding_id", "nth", (F.col("_i") + 1).alias("sub"), F.concat(F.lit("  - `"), place, F.lit("`"), symbol)
        )
    )


def session_report(sessions: DataFrame, steps: DataFrame, findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(session_id, markdown): the goal, the plan's steps in order and the findings with their evidence lines.

    sessions: (session_id, goal, status, cost), steps: (session_id, step, objective, tool, status, attempts), findings:
    (session_id, finding_id, title, severity, confidence). A session's rows meet in one: a plan and its findings are short.
    """
    step = F.concat(
        F.lit("- Step "),
        (F.col("step") + 1).cast("string"),
        F.lit(": "),
        one_line(F.col("objective")),
        F.lit(" (`"),
        "tool",
        F.lit("`, "),
        "status",
        F.lit(", attempts="),
        F.col("attempts").cast("string"),
        F.lit(")"),
    )
    plan = steps.groupBy("session_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("step", step.alias("l")))), lambda x: x.l), "\n"
        ).alias("plan")
    )
    body = lines.groupBy("finding_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "sub", "line"))), lambda x: x.line), "\n"
        ).alias("body")
    )
    head = F.concat(
        F.lit("### "),
        one_line(F.col("title")),
        F.lit("\n\nSeverity: `"),
        "severity",
        F.lit("`; confidence: "),
        F.format_string("%.2f", "confidence"),
        F.lit("\n\n"),
        F.coalesce("body", F.lit("")),
    )
    found = findings.join(body, "finding_id", "left").groupBy("session_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("finding_id", head.alias("l")))), lambda x: x.l), "\n\n"
        ).alias("found")
    )
    whole = sessions.join(plan, "session_id", "left").join(found, "session_id", "left")
    text = F.concat(
        F.lit("## Session\n\n- Goal: "), one_line(F.col("goal")), F.lit("\n- Status: "), "status", F.lit("\n- Cost: $"), F.format_string("%.8f", F.coalesce("cost", F.lit(0.0))),
        F.lit("\n\n## Plan execution\n\n"), F.coalesce("plan", F.lit("No plan steps were persisted.")),
        F.lit("\n\n## Candidate findings\n\n"), F.coalesce("found", F.lit("No candidate findings were recorded.")), F.lit("\n"),
    )
    return whole.select("session_id", text.alias("markdown"))


def last_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by `order`, which is unique, in that order again."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def schema_version(migrations: DataFrame) -> DataFrame:
    """The largest version, 0 without any."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("version"))


def once_in_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each value of a key where it came first: (key, value, nth from 1)."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_first", value))
    return first.select(key, value, nth.cast("long").alias("nth"))
