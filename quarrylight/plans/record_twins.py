"""The queries of quarrylight.plans.records as SQL that DuckDB runs over the same tables."""

MEMBERS = """m AS (SELECT source AS package, doc_id, strlen(text) AS size, sha256(text) AS sha256, ['assets/a' || doc_id, 'res/layout/x' || doc_id || '.xml', 'lib/arm64/lib' || doc_id || '.so', 'lib/odd' || doc_id,
  'classes' || (doc_id % 40 + 2) || '.dex', 'META-INF/C' || doc_id || '.RSA', 'other' || doc_id][doc_id % 7 + 1] AS name FROM documents)"""
CATEGORIES = f"""{MEMBERS}, cat AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'asset' WHEN 1 THEN 'resource' WHEN 2 THEN 'native' WHEN 4 THEN 'dex' WHEN 5 THEN 'signature' END AS category FROM m)"""
HEX = "upper(lpad(format('{:x}', {0}), 16, '0'))"
TREE = """SELECT package, count(*) AS files, sum(size)::BIGINT AS bytes, sha256(unhex(string_agg(upper(lpad(format('{{:x}}', strlen(name)), 16, '0')) || hex(name) || upper(lpad(format('{{:x}}', size), 16, '0')) || upper(sha256), '' ORDER BY name, size, sha256))) AS sha256 FROM m WHERE {0} GROUP BY package"""
OUTPUT = """o AS (SELECT user_id AS run_id, event_id AS n, user_id % 2 AS code, CASE WHEN event_id % 5 = 0 THEN 'ERROR - class ' || (event_id % 20) WHEN event_id % 5 = 1 THEN 'warning: method ' || (event_id % 30) WHEN event_id % 50 = 2 THEN 'finished with errors, count: ' || (event_id % 97) ELSE 'processing' END AS line FROM events)"""
TOOLS = [
    "apk_import",
    "source_index",
    "source_search",
    "context_query",
    "proxy_start",
    "frida_run",
    "adb_logcat",
    "static_report",
    "no_such_tool"
]
STEPS = f"""s AS (SELECT conv_id AS plan_id, turn::INT AS step, {TOOLS}[(conv_id + turn * 5) % 9 + 1] AS tool, (turn - 1 + conv_id % 3)::INT AS dep, length(text) * 1.0::DOUBLE AS timeout FROM conversations)"""
EVIDENCE = """f AS (SELECT doc_id AS finding_id, doc_id % 20 AS session_id, 'Finding ' || doc_id AS title, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS severity, doc_id % 4 / 4.0 AS confidence FROM labels),
  r AS (SELECT finding_id, n AS nth, finding_id + n AS evidence_id FROM f, (SELECT unnest([0, 1]) AS n)),
  h AS (SELECT finding_id, nth::BIGINT AS nth, 0::BIGINT AS sub, CASE WHEN l.doc_id IS NULL THEN '- Missing evidence record `' || evidence_id || '`' ELSE '- `tool-run:' || evidence_id || '` — seen (tool run `' || CASE WHEN evidence_id % 2 = 0 THEN evidence_id::VARCHAR ELSE 'none' END || '`)' END AS line,
    l.doc_id IS NOT NULL AS there, evidence_id, quality, toxic FROM r LEFT JOIN (SELECT * FROM labels WHERE doc_id % 4 <> 0) l ON l.doc_id = evidence_id),
  li AS (SELECT finding_id, nth, sub, line FROM h UNION ALL SELECT finding_id, nth, 1, '  - `src/F' || evidence_id || '.java:' || evidence_id || CASE WHEN quality = 1 THEN '-' || (evidence_id + 1) ELSE '' END || '`' || CASE WHEN toxic = 1 THEN ' — `Sym`' ELSE '' END FROM h WHERE there)"""
PATH = "CASE p_partkey % 4 WHEN 0 THEN 'a\\' || p_name || '.kt' WHEN 1 THEN '../x.java' WHEN 2 THEN '/abs/y.smali' ELSE 'b/c/' || p_brand || '.JAVA' END"
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {0}started_at DESC, run_id DESC) AS nth FROM ({1})) WHERE nth = 1"
LINEAGE = f"""ru AS (SELECT user_id % 40 AS project_id, event_id AS run_id, ['apk_import', 'apk_inspect', 'apk_metadata', 'jadx_decompile', 'manifest_analyze', 'source_index', 'context_query', 'detect_obfuscation'][event_id % 8 + 1] AS tool, ts AS started_at,
    'sha' || (user_id % 3) AS apk_sha, CASE WHEN event_id % 5 > 0 THEN 'art' || (user_id % 2) END AS artifact_id, CASE WHEN user_id % 4 > 0 THEN '/w/t' || (event_id % 3) END AS output_dir, CASE WHEN event_id % 2 = 0 THEN '/w/t' || (event_id % 3) || '/AndroidManifest.xml' ELSE '/w/t1x/m.xml' END AS path,
    'idx' || (user_id % 2) AS index_id, '/w/t' || (event_id % 3) || '/sources' AS source_root FROM events WHERE event_type <> 'error'),
  b AS (SELECT project_id, run_id, apk_sha, CASE WHEN tool = 'apk_import' THEN artifact_id END AS art FROM ({LAST.format("(tool = 'apk_import') DESC, ", "SELECT * FROM ru WHERE tool IN ('apk_import', 'apk_inspect')")})),
  md AS ({LAST.format('', "SELECT ru.* FROM ru JOIN b USING (project_id) WHERE tool = 'apk_metadata' AND ru.apk_sha = b.apk_sha")}),
  tr AS ({LAST.format('', "SELECT ru.* FROM ru JOIN b USING (project_id) WHERE tool = 'jadx_decompile' AND ru.apk_sha = b.apk_sha")}),
  mf AS ({LAST.format('', "SELECT ru.* FROM ru JOIN tr USING (project_id) WHERE ru.tool = 'manifest_analyze' AND (starts_with(ru.path, tr.output_dir || '/') OR ru.path = tr.output_dir)")}),
  ix AS ({LAST.format('', "SELECT ru.* FROM ru JOIN b USING (project_id) LEFT JOIN tr USING (project_id) WHERE ru.tool = 'source_index' AND (b.art IS NULL OR ru.artifact_id = b.art) AND CASE WHEN tr.output_dir IS NOT NULL THEN ru.source_root = tr.output_dir || '/sources' ELSE b.art IS NOT NULL END")}),
  qu AS ({LAST.format('', "SELECT ru.* FROM ru JOIN ix USING (project_id) WHERE ru.tool = 'context_query' AND ru.index_id = ix.index_id")}),
  si AS ({LAST.format('', "SELECT ru.* FROM ru JOIN ix USING (project_id) WHERE ru.tool = 'detect_obfuscation' AND ru.source_root = ix.source_root")})"""

RECORD_TWINS = {
    "member_category_totals": f"""WITH {CATEGORIES} SELECT package, category, count(*) AS entries, sum(size)::BIGINT AS bytes FROM cat WHERE category IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT package, 'all', count(*), sum(size)::BIGINT FROM (SELECT package, name, any_value(size) AS size FROM cat WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "package_tree_hash": f"WITH {MEMBERS} {TREE.format('true')}",
    "decompiler_cache_state": f"""WITH {MEMBERS}, a AS ({TREE.format("package NOT LIKE '%3'")}), z AS ({TREE.format("(doc_id % 5 <> 0 OR package NOT LIKE '%1') AND package NOT LIKE '%2'")})
      SELECT coalesce(a.package, z.package) AS package, CASE WHEN z.package IS NULL THEN 'lost' WHEN a.package IS NULL THEN 'unmarked' WHEN (a.files, a.bytes, a.sha256) = (z.files, z.bytes, z.sha256) THEN 'valid' ELSE 'changed' END AS state FROM a FULL JOIN z ON a.package = z.package""",
    "content_addressed_import": f"""WITH {MEMBERS}, k AS (SELECT sha256, arg_max(CASE WHEN doc_id % 2 = 0 THEN size ELSE size + 1 END, doc_id) AS held FROM m WHERE doc_id % 3 = 0 GROUP BY 1), g AS (SELECT sha256, max(size) AS size, min(name) AS name FROM m GROUP BY 1)
      SELECT sha256, size, name, 'prj_1/' || left(sha256, 2) || '/' || sha256 || '/blob' AS stored_path, CASE WHEN held IS NULL THEN 'new' WHEN held = size THEN 'known' ELSE 'damaged' END AS state FROM g LEFT JOIN k USING (sha256)""",
    "bundle_import": f"WITH {MEMBERS} SELECT package AS bundle, name, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'changed' ELSE 'imported' END AS state FROM m WHERE doc_id % 7 < 4",
    "base_package_choice": """WITH p AS (SELECT conv_id AS bundle, CASE WHEN turn = conv_id % 4 THEN 'x/Base.APK' ELSE 'split_' || turn || '.apk' END AS name, role = 'user' AS has_dex, conv_id % 5 = 0 AND turn <= conv_id % 3 AS told, turn = conv_id % 4 AS called FROM conversations),
      g AS (SELECT bundle, count(*) AS n, max(name) AS anyone, count(*) FILTER (told) AS nt, max(name) FILTER (told) AS t, count(*) FILTER (called) AS nc, max(name) FILTER (called) AS c, count(*) FILTER (has_dex) AS nd, max(name) FILTER (has_dex) AS d FROM p GROUP BY 1),
      x AS (SELECT *, CASE WHEN nt > 1 THEN 'several-by-metadata' WHEN nt = 0 AND nc > 1 THEN 'several-by-name' END AS bad FROM g), y AS (SELECT *, CASE WHEN bad IS NOT NULL THEN NULL WHEN nt = 1 THEN t WHEN nc = 1 THEN c WHEN n = 1 THEN anyone WHEN nd = 1 THEN d END AS base FROM x)
      SELECT bundle, base, coalesce(bad, CASE WHEN base IS NULL THEN 'no-base' END) AS problem FROM y""",
    "member_references": f"""WITH {MEMBERS}, a AS (SELECT DISTINCT package AS bundle, CASE doc_id % 3 WHEN 0 THEN './' || name WHEN 1 THEN 'x\\' || regexp_extract(name, '[^/]*$') ELSE 'gone' || doc_id END AS reference FROM m),
      t AS (SELECT *, regexp_replace(replace(reference, '\\', '/'), '^\\./', '') AS tidy FROM a), e AS (SELECT DISTINCT package AS bundle, name FROM m), fi AS (SELECT bundle, regexp_extract(name, '[^/]*$') AS file, count(*) AS n, max(name) AS sole FROM e GROUP BY 1, 2),
      j AS (SELECT t.bundle, reference, coalesce(e.name, CASE WHEN n = 1 THEN sole END) AS name, n FROM t LEFT JOIN e ON e.bundle = t.bundle AND e.name = tidy LEFT JOIN fi ON fi.bundle = t.bundle AND fi.file = regexp_extract(tidy, '[^/]*$'))
      SELECT bundle, reference, name, CASE WHEN name IS NULL THEN CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END END AS problem FROM j""",
    "split_ids": f"WITH {MEMBERS} SELECT package, name, regexp_replace(regexp_extract(name, '[^/]*$'), '\\.[^.]*$', '') AS split_id FROM m",
    "tool_diagnostics": f"""WITH {OUTPUT}, k AS (SELECT * FROM o WHERE run_id % 3 <> 1 OR line = 'processing'), a AS (SELECT run_id, 'error' AS kind, line, min(n) AS n FROM k WHERE line LIKE 'ERROR %' GROUP BY 1, 3 UNION ALL SELECT run_id, 'warning', line, min(n) FROM k WHERE line LIKE 'warning%' GROUP BY 1, 3),
      z AS (SELECT * FROM a UNION ALL SELECT run_id, 'error', 'exit code ' || max(code) || ': ' || arg_max(line, n), max(n) FROM k WHERE code <> 0 AND run_id NOT IN (SELECT run_id FROM a WHERE kind = 'error') GROUP BY 1)
      SELECT run_id, kind, row_number() OVER (PARTITION BY run_id, kind ORDER BY n, line) AS nth, line FROM z""",
    "reported_error_counts": f"WITH {OUTPUT} SELECT run_id, max(regexp_extract(line, 'count: ([0-9]+)', 1)::BIGINT) AS errors FROM o WHERE line LIKE 'finished%' GROUP BY 1",
    "nested_evidence_count": "SELECT conv_id, 5 * count(*) + 2 * (1 + count(*) * 6) AS evidence FROM conversations GROUP BY 1",
    "plan_validation": f"""WITH {STEPS}, w AS (SELECT plan_id, count(*) AS n, arg_max(tool, step) AS last FROM s GROUP BY 1)
      SELECT plan_id, step::BIGINT AS step, 'dependency-not-earlier' AS problem FROM s WHERE dep < 0 OR dep >= step UNION ALL SELECT plan_id, step, 'unknown-tool' FROM s WHERE tool = 'no_such_tool' UNION ALL SELECT plan_id, step, 'timeout-over-limit' FROM s WHERE timeout > 200
      UNION ALL SELECT plan_id, NULL, 'too-many-steps' FROM w WHERE n > 3 UNION ALL SELECT plan_id, NULL, 'final-tool-is-not:static_report' FROM w WHERE plan_id % 2 = 0 AND last <> 'static_report'""",
    "scope_gate": f"""WITH {STEPS}, g AS (SELECT *, starts_with(tool, 'adb_') OR starts_with(tool, 'frida_') AS device, starts_with(tool, 'frida_') OR tool = 'adb_logcat' AS hook, starts_with(tool, 'proxy_') AS proxy FROM s)
      SELECT plan_id, step, tool, CASE WHEN NOT (device OR proxy) THEN NULL WHEN plan_id % 4 = 0 THEN 'dynamic-not-enabled' WHEN device AND plan_id % 3 = 0 AND step <> 1 THEN 'device-not-in-scope' WHEN hook AND step % 2 <> 0 THEN 'package-not-in-scope' WHEN proxy AND plan_id % 5 <> 0 THEN 'proxy-not-allowed' END AS denied,
      CASE WHEN starts_with(tool, 'frida_') THEN 'runtime_event' WHEN proxy THEN 'network_flow' ELSE 'tool_output' END AS evidence_kind FROM g""",
    "memory_merge": """WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: lower(x)) AS ws FROM conversations), b AS (SELECT conv_id, turn, list_concat(ws[1:4], ws[3:6]) AS l FROM w)
      SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS memory FROM b""",
    "memory_order": "WITH l AS (SELECT doc_id % 50 AS session_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) - 1 AS place, doc_id AS finding_id, toxic, quality FROM labels) SELECT session_id, place, finding_id, toxic FROM l WHERE quality = 1",
    "ordered_distinct": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS nth FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2)",
    "source_references": """WITH p AS (SELECT doc_id, n, doc_id % 4 <> n AS good FROM documents, (SELECT unnest([0, 1]) AS n) WHERE doc_id % 3 = 0)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS nth, 'p' || doc_id AS path, doc_id % 90 + n AS start_line, doc_id % 90 + n + 3 AS end_line, CASE WHEN doc_id % 2 = 1 THEN 's' END AS symbol FROM p WHERE good""",
    "reviewer_payload": """WITH p AS (SELECT doc_id, repeat('ab', (doc_id % 3 * 15000)::INT) AS o FROM documents WHERE lang = 'en'), q AS (SELECT doc_id, '{"goal":"goal","remaining_step_budget":' || doc_id || ',"tool":"t","tool_error":null,"tool_output_json":"' || CASE WHEN length(o) > 40000 THEN left(o, 40000) || '...[truncated]' ELSE o END || '"}' AS p FROM p)
      SELECT doc_id, sha256(p) AS payload_sha256, length(p) AS chars FROM q""",
    "scope_labels": """WITH l AS (SELECT DISTINCT c_custkey % 30 AS project_id, c_mktsegment || ':N' || c_nationkey AS label FROM customer WHERE c_nationkey % 5 <> 0) SELECT project_id, string_agg(label, ',' ORDER BY lower(label), label) AS labels FROM l GROUP BY 1""",
    "run_estimate": "SELECT n_nationkey, (n_nationkey + 2)::BIGINT AS projected_model_calls, (n_nationkey + 2)::BIGINT * 1024 AS projected_input_tokens, (n_nationkey + 2)::BIGINT * 512 AS projected_output_tokens, 0.0::DOUBLE AS projected_cost_usd FROM nation",
    "default_artifact": """WITH a AS (SELECT conv_id AS project_id, conv_id * 100 + turn AS id, (conv_id + turn) % 3 = 0 AS base FROM conversations WHERE conv_id % 4 <> 0 OR turn = 0), g AS (SELECT project_id, count(*) AS n, count(*) FILTER (base) AS b, max(id) AS anyone, max(id) FILTER (base) AS one FROM a GROUP BY 1)
      SELECT project_id, CASE WHEN b = 1 THEN one WHEN b = 0 AND n = 1 THEN anyone END AS artifact_id, CASE WHEN b > 1 THEN 'several-base-packages' WHEN b = 0 AND n > 1 THEN 'no-default-package' END AS problem FROM g""",
    "artifact_ownership": """WITH o AS (SELECT o_orderkey, o_custkey % 25 AS project_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS artifact_id FROM orders) SELECT o_orderkey, artifact_id FROM o WHERE artifact_id IS NULL OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = artifact_id AND c_nationkey = project_id)""",
    "finding_lines": f"WITH {EVIDENCE} SELECT finding_id, nth, sub, line FROM li",
    "session_report": f"""WITH {EVIDENCE}, bo AS (SELECT finding_id, string_agg(line, chr(10) ORDER BY nth, sub, line) AS body FROM li GROUP BY 1), fo AS (SELECT session_id, string_agg('### ' || title || chr(10) || chr(10) || 'Severity: `' || severity || '`; confidence: ' || printf('%.2f', confidence) || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY finding_id) AS found FROM f JOIN bo USING (finding_id) GROUP BY 1),
      se AS (SELECT range AS session_id FROM range(25)), pl AS (SELECT range % 20 AS session_id, string_agg('- Step ' || (range // 20 + 1) || ': look (`source_search`, completed, attempts=1)', chr(10) ORDER BY range) AS plan FROM range(60) GROUP BY 1)
      SELECT se.session_id, '## Session' || chr(10) || chr(10) || '- Goal: Goal ' || se.session_id || chr(10) || '- Status: completed' || chr(10) || '- Cost: $' || printf('%.8f', se.session_id / 8.0) || chr(10) || chr(10) || '## Plan execution' || chr(10) || chr(10) || coalesce(plan, 'No plan steps were persisted.') || chr(10) || chr(10) || '## Candidate findings' || chr(10) || chr(10) || coalesce(found, 'No candidate findings were recorded.') || chr(10) AS markdown FROM se LEFT JOIN pl USING (session_id) LEFT JOIN fo USING (session_id)""",
    "last_flows": "SELECT page_id AS id, url FROM pages ORDER BY page_id DESC LIMIT 15",
    "schema_version": "SELECT coalesce(max(r_regionkey), 0)::BIGINT AS version FROM region",
    "report_lineage": f"""WITH {LINEAGE} SELECT project_id, 'package' AS stage, run_id FROM b UNION ALL SELECT project_id, 'metadata', run_id FROM md UNION ALL SELECT project_id, 'tree', run_id FROM tr UNION ALL SELECT project_id, 'manifest', run_id FROM mf
      UNION ALL SELECT project_id, 'signals', run_id FROM si UNION ALL SELECT project_id, 'index', run_id FROM ix UNION ALL SELECT project_id, 'query', run_id FROM qu""",
    "report_sections": """WITH n AS (SELECT source AS project_id, count(*) AS project, count(*) FILTER (doc_id % 40 = 0) AS jadx, count(*) FILTER (doc_id % 90 = 1) AS manifest, count(*) FILTER (doc_id % 60 = 2) AS source_evidence FROM documents GROUP BY 1),
      s AS (SELECT unnest(['project', 'package', 'apk_metadata', 'jadx', 'manifest', 'obfuscation', 'context', 'source_evidence', 'provenance', 'limitations']) AS section, unnest(range(10)) AS place),
      x AS (SELECT project_id, section, place, CASE section WHEN 'project' THEN project WHEN 'jadx' THEN jadx WHEN 'manifest' THEN manifest WHEN 'source_evidence' THEN source_evidence ELSE 0 END AS rows FROM n, s)
      SELECT project_id, section, place, rows > 0 OR section IN ('project', 'package', 'provenance', 'limitations') AS included, rows FROM x""",
    "method_summaries": None,
    "captured_bodies": "SELECT page_id, md5(left(html, 100)) AS body_md5, length(html) > 100 AS request_body_cut, false AS response_body_cut FROM pages",
    "device_list": """SELECT 'emu-' || s_suppkey AS serial, 'device' AS state, 'M1' AS model, 'p' || s_nationkey AS product, (s_suppkey % 9)::VARCHAR AS transport_id FROM supplier WHERE s_suppkey % 7 > 2""",
    "process_list": "SELECT s_suppkey AS pid, 'app ' || s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0",
    "log_lines": "SELECT '01-02 03:04:05.678' AS at, s_suppkey AS pid, 12::BIGINT AS tid, 'I' AS level, 'Tag' || s_nationkey AS tag, 'm: ' || s_name AS message FROM supplier WHERE s_suppkey % 5 <> 0",
    "permission_rows": """WITH x AS (SELECT p_partkey, p_partkey % 3 = 0 AS dangerous, CASE p_partkey % 4 WHEN 1 THEN 33 WHEN 3 THEN 16 WHEN 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 21 END END::BIGINT AS sdk, [true, false, NULL][p_partkey % 7 % 3 + 1] AS a, [true, false, NULL][p_partkey % 11 % 3 + 1] AS b FROM part) SELECT p_partkey, dangerous, sdk, a AND b AS enabled FROM x""",
    "slugs_and_paths": f"""WITH p AS (SELECT *, {PATH} AS path FROM part) SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE p_partkey % 4 WHEN 0 THEN replace(path, '\\', '/') WHEN 3 THEN path END AS path, CASE p_partkey % 4 WHEN 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent,
      CASE p_partkey % 4 WHEN 0 THEN 'kotlin' WHEN 2 THEN 'smali' ELSE 'java' END AS language, CASE WHEN p_partkey % 4 = 3 THEN path END AS inside FROM p""",
}

RECORD_TWINS["report_source_references"] = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS place FROM lineitem)
  SELECT l_orderkey AS run_id, place, 'src/' || l_partkey AS path, l_linenumber::BIGINT AS start_line, (l_linenumber + 9)::BIGINT AS end_line, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS symbol, 'c' || l_suppkey AS chunk_id,
    'Retrieved for ' || CASE WHEN l_orderkey % 7 = 2 THEN 'context query' ELSE 'q' || l_orderkey END || '; hybrid score 0' AS summary
  FROM l WHERE l_orderkey % 7 > 1 AND l_linenumber NOT IN (5, 6) AND l_linenumber % 3 <> 0"""
RECORD_TWINS["report_index_inputs"] = """SELECT s_suppkey AS run_id, 'i' || s_suppkey AS index_id, NULL::BIGINT AS source_file_count, s_suppkey::BIGINT AS chunk_count, s_suppkey::BIGINT AS vector_document_count, 0::BIGINT AS summary_count, 'p (r' || s_suppkey || '): d' AS warning
  FROM supplier WHERE s_suppkey % 5 <> 0"""
SECTION = """SELECT {key} AS project_id, {place} AS place, '## {head}' || chr(10) || chr(10) || '| {columns} |' || chr(10) || '|{rule}|' || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (nth <= {most}) || chr(10) || chr(10) || CASE WHEN count(*) > {most} THEN (count(*) - {most}) || ' more rows are not shown.' || chr(10) || chr(10) ELSE '' END AS text
  FROM (SELECT *, {id} AS k, '| ' || {line} || ' |' AS line, row_number() OVER (PARTITION BY {key} ORDER BY {id}) AS nth FROM {rows}) GROUP BY 1"""
PARTS = " UNION ALL ".join(
    SECTION.format(key=key, place=place, head=head, columns=columns.replace(",", " | "), rule="|".join(["---"] * len(columns.split(","))), most=most, id=columns.split(",")[0], line=" || ' | ' || ".join(columns.split(",")), rows=rows)
    for place, (head, key, columns, most, rows) in enumerate([
        ("Package", "s_nationkey", "s_suppkey,s_name", 3, "supplier"),
        ("Manifest", "c_nationkey", "c_custkey,c_mktsegment", 2, "customer WHERE c_custkey % 20 = 0"),
        ("Obfuscation", "c_nationkey", "c_custkey", 2, "customer WHERE c_custkey % 90 = 1"),
        ("Provenance", "s_nationkey", "s_suppkey", 5, "supplier WHERE s_suppkey % 4 <> 0"),
    ])
)
RECORD_TWINS["static_reports"] = f"""WITH p AS ({PARTS}), w AS (SELECT n_nationkey AS project_id, n_name, [x FOR x IN ['Package', 'Manifest', 'Obfuscation'] IF NOT list_contains(coalesce(h, []), x)] AS missing, coalesce(h, []) AS h, body FROM nation LEFT JOIN (SELECT project_id AS k, string_agg(text, '' ORDER BY place) AS body, list(['Package', 'Manifest', 'Obfuscation', 'Provenance'][place + 1]) AS h FROM p GROUP BY 1) ON k = n_nationkey),
  t AS (SELECT *, '# ' || n_name || chr(10) || chr(10) || '> **Scope notice:** for study' || chr(10) || chr(10) || coalesce(body, '') || CASE WHEN list_contains(h, 'Provenance') THEN '' ELSE '## Provenance' || chr(10) || chr(10) || 'No runs are recorded.' || chr(10) || chr(10) END || '## Limitations' || chr(10) || chr(10) || array_to_string(list_concat(['- Not included: ' || x FOR x IN missing], ['- no device']), chr(10)) || chr(10) AS text FROM w)
  SELECT project_id, text, sha256(text) AS sha256, array_to_string(missing, ',') AS missing FROM t"""
