"""Runs, findings, evidence and ledgers: latest states, chains, repeated calls, missing references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that `order` puts first. Partial limits run before the shuffle."""
    return rows.withColumn(
        "_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where("_nth = 1").drop("_nth")


def chain(runs: DataFrame, tools: list[str], key: str) -> DataFrame:
    """Of each key the latest completed run (run_id) of every tool, side by side: one pass, not a join for each tool."""
    last = lambda t: F.max_by("run_id", F.when(F.col("tool") == t, F.struct("started_at", "run_id"))).alias(f"{t}_run")
    return runs.where("status = 'completed'").groupBy(key).agg(*[last(t) for t in tools])


def report_lineage(runs: DataFrame, key: str = "project_id") -> DataFrame:
    """Of each key the runs that one static report rests on, each the latest that succeeded and belongs to what is before it.

    runs: (key, run_id, tool, status, started_at, apk_sha, artifact_id, output_dir, path, index_id, source_root). The package
    run (an import, else an inspection) gives the digest; metadata and decompilation have the same; the manifest lies below the
    decompiled tree; the index is of the imported artifact (if there is one) and of that tree's sources; query and signals are of that index.
    Returns (key, stage, run_id); a stage without such a run has no row, and a key without a package run none at all.
    """
    residual = ["apk_sha", "artifact_id", "output_dir", "path", "index_id", "source_root"]
    # of runs that are equal in all that a stage asks for only the newest can be chosen; these few meet in a row of their key
    newest = runs.where("status = 'succeeded'").groupBy(key, "tool", *residual).agg(
        F.max(F.struct("started_at", "run_id")).alias("at")
    )
    run = F.struct("at.started_at", "at.run_id", "tool", *residual)
    state = newest.groupBy(key).agg(F.collect_list(run).alias("_runs"))

    def last(fits) -> Column:
        return F.array_max(F.filter("_runs", fits))  # by time, then run

    imported = last(lambda r: r.tool == "apk_import")
    state = state.withColumn("package", F.coalesce(imported, last(lambda r: r.tool == "apk_inspect"))).where("package is not null")
    state = state.withColumns(
        {"_sha": F.col("package.apk_sha"), "_artifact": F.when(F.col("package.tool") == "apk_import", F.col("package.artifact_id"))}
    )
    same = lambda tool: last(lambda r: (r.tool == tool) & (r.apk_sha == F.col("_sha")))
    state = state.withColumns({"metadata": same("apk_metadata"), "tree": same("jadx_decompile")})
    root = F.col("tree.output_dir")
    of_tree = lambda r: F.when(
        root.isNotNull(), r.source_root == F.concat(root, F.lit("/sources"))
    ).otherwise(F.col("_artifact").isNotNull())
    of_artifact = lambda r: F.col("_artifact").isNull() | (r.artifact_id == F.col("_artifact"))
    below = lambda r: F.startswith(r.path, F.concat(root, F.lit("/"))) | (r.path == root)
    state = state.withColumns(
        {
            "manifest": last(lambda r: (r.tool == "manifest_analyze") & below(r)),
            "index": last(lambda r: (r.tool == "source_index") & of_artifact(r) & of_tree(r)),
        }
    )
    state = state.withColumns(
        {
            "query": last(lambda r: (r.tool == "context_query") & (r.index_id == F.col("index.index_id"))),
            "signals": last(lambda r: (r.tool == "detect_obfuscation") & (r.source_root == F.col("index.source_root"))),
        }
    )
    stages = ["package", "metadata", "tree", "manifest", "signals", "index", "query"]
    each = F.explode(
        F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}.run_id").alias("run_id")) for s in stages])
    )
    return state.select(key, each.alias("r")).select(key, "r.stage", "r.run_id").where("run_id is not null")


def repeated_calls(runs: DataFrame, session: str, call: list[str], order: list[str], limit: int) -> DataFrame:
    """Adds nth (how often the session made this call so far) and looping (nth > limit)."""
    upto = Window.partitionBy(session, *call).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("nth", F.count("*").over(upto)).withColumn("looping", F.col("nth") > limit)


def ready_steps(steps: DataFrame) -> DataFrame:
    """steps (session_id, step_id, status, depends_on): adds ready, true if all dependencies are known and completed."""
    deps = steps.select("session_id", "step_id", F.explode("depends_on").alias("needs"))
    states = steps.select("session_id", F.col("step_id").alias("needs"), (F.col("status") == "completed").alias("done"))
    met = deps.join(states, ["session_id", "needs"], "left").groupBy("session_id", "step_id").agg(
        F.bool_and(F.coalesce("done", F.lit(False))).alias("met")
    )
    return steps.join(met, ["session_id", "step_id"], "left").withColumn(
        "ready", F.coalesce("met", F.lit(True))
    ).drop("met")


def findings_with(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings one of whose evidence_ids is among evidence (id)."""
    hit = findings.select(
        "finding_id", F.explode("evidence_ids").alias("id")
    ).join(evidence.select("id"), "id", "left_semi").select("finding_id").distinct()
    return findings.join(hit, "finding_id", "left_semi")


def missing_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, evidence_id, missing) of every reference."""
    refs = findings.select("finding_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    return refs.join(
        evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("_there")), "evidence_id", "left"
    ).select("finding_id", "evidence_id", F.col("_there").isNull().alias("missing"))


def correlate(edges: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """edges with up to three references; adds {name}_found for each. An edge without any reference is an error."""
    given = F.coalesce(*[F.col(f"{n}_id").cast("string") for n in sources])
    out = edges.where(
        F.when(given.isNull(), F.raise_error("an edge names some evidence").cast("boolean")).otherwise(F.lit(True))
    )
    for name, rows in sources.items():
        out = out.join(
            rows.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(f"{name}_found")).distinct(),
            f"{name}_id",
            "left",
        ).withColumn(f"{name}_found", F.coalesce(f"{name}_found", F.lit(False)))
    return out


def usage(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and cost of each key; a missing actual cost counts as 0."""
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.round(F.sum(F.coalesce("actual_cost", F.lit(0.0))), 2).alias("cost"),
    )


def orphans(rows: DataFrame, parents: DataFrame, column: str, parent: str = "id") -> DataFrame:
    """Rows whose reference is set and has no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")
