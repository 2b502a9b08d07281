"""The catalogue's queries as SQL that DuckDB runs over the same tables."""

from quarrylight.plans.record_twins import RECORD_TWINS

FILES = "f AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, source, doc_id, text AS content FROM documents)"
CHUNKS = "c AS (SELECT 'chk_' || lpad(doc_id::VARCHAR, 12, '0') AS id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'method' ELSE 'file' END AS kind, 'sym_' || (doc_id % 7) AS symbol, 1 AS start_line, text AS content, doc_id FROM documents)"
LINES = "l AS (SELECT *, CASE WHEN coalesce(content, '') = '' THEN [] WHEN right(content, 1) = chr(10) THEN string_split(left(content, length(content) - 1), chr(10)) ELSE string_split(content, chr(10)) END AS ls FROM {0})"
WINDOWS = f"""{FILES}, {LINES.format('f')}, n AS (SELECT *, len(ls) AS k FROM l WHERE len(ls) > 0),
  s AS (SELECT *, unnest(generate_series(0, CASE WHEN k <= 4 THEN 0 ELSE ((k - 4 + 2) // 3) END)) AS w FROM n),
  w AS (SELECT path, language, 'file' AS kind, CASE WHEN k <= 4 THEN '<file>' ELSE '<file>:' || (w * 3 + 1) || '-' || least(w * 3 + 4, k) END AS symbol, w * 3 + 1 AS start_line, least(w * 3 + 4, k) AS end_line, array_to_string(ls[w * 3 + 1 : w * 3 + 4], chr(10)) AS content FROM s)"""
IDS = """i AS (SELECT *, sha256(content) AS sha, 'chk_' || sha256(to_json({'content_sha256': sha256(content), 'end_instruction': NULL, 'end_line': end_line::INT, 'kind': kind, 'language': language, 'path': path, 'schema_version': '1.0', 'start_instruction': NULL, 'start_line': start_line::INT, 'symbol': symbol})::VARCHAR) AS id FROM w)"""
INTERVALS = "v AS (SELECT l_orderkey AS k, l_partkey % 900 + 1 AS a, l_partkey % 900 + l_quantity::BIGINT AS b FROM lineitem)"
ISLANDS = f"""{INTERVALS}, o AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v WHERE a <= b),
  g AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM o),
  m AS (SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, n)"""
STATES = f"""{FILES}, t AS (SELECT path, CASE WHEN strlen(content) > 20000 THEN 'too-large' WHEN content IS NULL THEN 'unreadable' WHEN strlen(content) = 0 THEN 'empty' WHEN contains(content, chr(0)) THEN 'binary' WHEN strlen(content) > 2000 THEN 'fallback' ELSE 'indexed' END AS state FROM f)"""
COUNT = "(length(lower(content)) - length(replace(lower(content), 'that the', ''))) // 8"
HITS = f"{CHUNKS}, {LINES.format('c')}, h AS (SELECT *, {COUNT} AS match_count, list_filter(list_transform(ls, lambda x, i: CASE WHEN contains(lower(x), 'that the') THEN i END), lambda x: x IS NOT NULL) AS hit FROM l WHERE {COUNT} > 0)"
COSINE = "round(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform({a}::DOUBLE[], lambda x: x * x)) * list_sum(list_transform({b}::DOUBLE[], lambda x: x * x))), 6)"
KNN = f"knn AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE.format(a='q.embedding', b='e.embedding')} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE.format(a='q.embedding', b='e.embedding')} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10)"
CASES = f"{KNN}, r AS (SELECT query_id AS case_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM knn WHERE id <> query_id), b AS (SELECT case_id, min(rank) FILTER (x.label = y.label) AS first_rank FROM r JOIN embeddings x ON x.vec_id = case_id JOIN embeddings y ON y.vec_id = id GROUP BY 1)"
METRICS = f"{CASES}, mm AS (SELECT count(*) AS cases, count(*) FILTER (first_rank <= 1) AS hit_at_1, count(*) FILTER (first_rank <= 3) AS hit_at_3, count(*) FILTER (first_rank <= 5) AS hit_at_5, round(avg(CASE WHEN first_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate_at_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate_at_3, round(avg(CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate_at_5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM b)"
HAS = lambda where: " + ".join(f"contains(lower({where}), '{w}')::INT" for w in ("that", "edth", "nonesuch"))
COALESCED = "coalesce(content, '')"
LEXICAL = f"least(1.0, CASE WHEN contains(lower(coalesce(content, '')), 'that the') OR contains(lower(path || ' ' || symbol), 'that the') THEN 0.45::DOUBLE ELSE 0 END + ({HAS(COALESCED)})::DOUBLE / 3 * 0.4::DOUBLE + ({HAS(chr(40) + 'path || chr(32) || symbol' + chr(41))})::DOUBLE / 3 * 0.15::DOUBLE)"
KNOWN = "(starts_with(path, 'src1/') OR starts_with(path, 'src2/fr/doc_1'))"
HYBRID = f"""{CHUNKS}, ve AS (SELECT vec_id, id, embedding FROM embeddings JOIN c ON doc_id = vec_id), qs AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), bud AS (SELECT least(count(*), 100) AS k FROM ve),
  nn AS (SELECT query_id, id, cosine FROM (SELECT query_id, ve.id, {COSINE.format(a='qs.embedding', b='ve.embedding')} AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE.format(a='qs.embedding', b='ve.embedding')} DESC, ve.id) AS n FROM ve, qs), bud WHERE n <= k),
  kn AS (SELECT id FROM c WHERE {KNOWN} ORDER BY path, id LIMIT 1000), ca AS (SELECT query_id, id FROM nn UNION SELECT query_id, kn.id FROM kn, qs),
  sc1 AS (SELECT ca.query_id, c.*, least(1.0, 0.5::DOUBLE * {LEXICAL} + 0.45::DOUBLE * greatest(0, least(1, coalesce(cosine, 0))) + 0.05::DOUBLE * {KNOWN}::INT) AS s FROM ca JOIN c USING (id) LEFT JOIN nn ON nn.query_id = ca.query_id AND nn.id = ca.id),
  hr AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'summary of ' || id END AS summary FROM (SELECT *, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, path, id) AS rank FROM sc1 WHERE s <> 0) WHERE rank <= 20)"""
PATTERN = r"""array_to_string(list_transform(string_split(url, '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN '{uuid}' WHEN regexp_matches(s, '^[0-9]+$') THEN '{id}' WHEN regexp_matches(s, '^[0-9a-f]{16,}$') THEN '{token}' ELSE s END), '/')"""
HOST = "regexp_extract(url, 'https?://([^/:]+)', 1)"
FLOWS = f"fl AS (SELECT page_id AS id, url, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, 200 AS status, page_id % 100 AS duration_ms, strlen(html) AS response_size FROM pages)"
RUNS = "ru AS (SELECT event_id AS run_id, user_id AS project_id, event_type AS tool, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS started_at FROM events)"
FINDINGS = "fi AS (SELECT doc_id AS finding_id, unnest([doc_id, doc_id + 1, doc_id + 100000000]) AS evidence_id FROM labels WHERE quality = 0 OR toxic = 1)"
CODE = """co AS (SELECT p_partkey % 10 AS k, 'class ' || name || ' {' || chr(10) || '  void ' || name || (p_partkey % 3) || '() { ' || CASE WHEN p_partkey % 7 = 0 THEN 'Object o = Class.forName("x").invoke (y);' WHEN p_partkey % 7 < 3 THEN 'switch (x) { default: goto z; }' ELSE 'return 1;' END || ' }' || chr(10) || '  String s = ' || CASE WHEN p_partkey % 5 = 0 THEN '"' || repeat('QUJD', 10) || '"' ELSE '"00ff"' END || ';' || chr(10) || '}' || chr(10) AS html
  FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE substr('abcdefghijklmnopqrstuvwxyz', p_size % 26 + 1, 1) END AS name FROM part))"""
NAMES = CODE + r""", sg AS (SELECT k, html, list_filter(list_concat(regexp_extract_all(html, '\b(?:class|interface|enum|object)\s+([A-Za-z_$][\w$]*)', 1), regexp_extract_all(html, '(?m)(?:\b(?:public|private|protected|internal|static|final|synchronized|native|abstract)\s+)*(?:fun\s+|[\w$<>\[\],.?]+\s+)([A-Za-z_$][\w$]*)\s*\(', 1)), lambda x: x NOT IN ('<init>', '<clinit>')) AS ids FROM co)"""
SCORES = rf"""{NAMES}, su AS (SELECT k, count(*) AS files, sum(len(ids))::BIGINT AS names, sum(len(list_filter(ids, lambda x: length(x) <= 2)))::BIGINT AS short_names,
  sum(len(regexp_extract_all(html, 'Class\.forName|getDeclaredMethod|getDeclaredField|java\.lang\.reflect|\.invoke\s*\(')))::BIGINT AS reflection,
  sum(len(regexp_extract_all(html, '"[A-Za-z0-9+/]{{32,}}={{0,2}}"')) + len(regexp_extract_all(html, '"(?:[0-9a-fA-F]{{2}}){{16,}}"')))::BIGINT AS encoded,
  sum(len(regexp_extract_all(html, '\b(?:switch|tableswitch|lookupswitch|goto)\b')))::BIGINT AS control, sum(length(html) - length(replace(html, chr(10), '')) + 1)::BIGINT AS lines FROM sg GROUP BY k),
  sc AS (SELECT *, CASE WHEN names >= 20 THEN least(1, greatest(0, (short_names::DOUBLE / names - 0.2::DOUBLE) / 0.6::DOUBLE)) ELSE 0.0::DOUBLE END AS name_score, least(1, reflection::DOUBLE / files / 2) AS reflection_score, least(1, encoded::DOUBLE / files / 3) AS string_score, least(1, greatest(0, (control / greatest(lines / 1000.0::DOUBLE, 1) - 8) / 40::DOUBLE)) AS control_score FROM su)"""
KINDS = "co AS (SELECT p_partkey AS id, ['activity', 'service', 'provider'][p_partkey % 3 + 1] AS kind, ['true', 'false', '@bool/x', NULL][(p_partkey // 3) % 4 + 1] AS attr, (p_partkey // 12) % 2 = 0 AS has_filter, [16, 17, 30, 31, NULL][(p_partkey // 24) % 5 + 1] AS sdk, ['p.OWN', NULL][(p_partkey // 120) % 2 + 1] AS permission, CASE WHEN p_size % 2 = 0 THEN 'p.READ' END AS own_read, CASE p_size % 5 WHEN 0 THEN false WHEN 1 THEN true END AS enabled, CASE WHEN p_size % 3 = 0 THEN 'p.APP' END AS app FROM part)"
EXPORT = f"""{KINDS}, ex AS (SELECT *, CASE WHEN attr = '@bool/x' THEN 'indeterminate-nonliteral' WHEN attr IS NOT NULL THEN 'explicit' WHEN kind = 'provider' AND sdk IS NULL THEN 'indeterminate-target-sdk' WHEN kind = 'provider' AND sdk < 17 THEN 'inferred-provider-target-sdk-16-or-lower' WHEN kind = 'provider' THEN 'inferred-provider-target-sdk-17-or-higher' WHEN NOT has_filter THEN 'inferred-no-intent-filter' WHEN sdk IS NULL THEN 'indeterminate-target-sdk' WHEN sdk >= 31 THEN 'missing-required-explicit' ELSE 'inferred-from-intent-filter' END AS exported_source,
  CASE WHEN attr IN ('true', 'false') THEN attr = 'true' WHEN attr IS NOT NULL THEN NULL WHEN kind = 'provider' THEN sdk < 17 WHEN NOT has_filter THEN false WHEN sdk < 31 THEN true END AS exported FROM co)"""
PERMISSIONS = "pe AS (SELECT *, coalesce(permission, app) AS effective_permission, CASE WHEN permission IS NOT NULL THEN 'component' WHEN app IS NOT NULL THEN 'application' ELSE 'none' END AS permission_source, CASE WHEN kind = 'provider' THEN coalesce(own_read, permission, app) END AS effective_read, CASE WHEN kind = 'provider' THEN coalesce(permission, app) END AS effective_write FROM {0})"

INDICATED = r"""list_filter([CASE WHEN regexp_matches(content, '(?i)\b(?:Cipher|SecretKey|MessageDigest|Mac|encrypt|decrypt)\b') THEN 'cryptography' END, CASE WHEN regexp_matches(content, '(?i)\b(?:https?|Retrofit|OkHttp|Request|Response|socket)\b') THEN 'networking' END, CASE WHEN regexp_matches(content, '(?i)\b(?:auth|login|token|jwt|oauth|credential)\b') THEN 'authentication' END, CASE WHEN regexp_matches(content, '\b(?:native|System\.loadLibrary|JNI)\b') THEN 'native/JNI' END, CASE WHEN regexp_matches(content, '\b(?:Class\.forName|getDeclaredMethod|reflect)\b') THEN 'reflection' END], lambda x: x IS NOT NULL)"""

TWINS = {
    "chunk_line_windows": f"WITH {WINDOWS} SELECT path, symbol, start_line, end_line, length(content) AS chars FROM w",
    "chunk_identity_sha": f"WITH {WINDOWS}, {IDS} SELECT path, start_line, id, sha AS content_sha256 FROM i",
    "chunk_islands": f"WITH {ISLANDS} SELECT k, a AS start_line, b AS end_line FROM m",
    "chunk_gap_intervals": f"""WITH {ISLANDS.replace('l_partkey % 900 + l_quantity::BIGINT AS b', 'least(1000, l_partkey % 900 + l_quantity::BIGINT) AS b')}, e AS (SELECT * FROM m UNION ALL SELECT DISTINCT k, 0, 0 FROM v UNION ALL SELECT DISTINCT k, 1001, 1001 FROM v),
      p AS (SELECT k, lag(b) OVER (PARTITION BY k ORDER BY a, b) + 1 AS x, a - 1 AS y FROM e), q AS (SELECT k, y, unnest(generate_series(x, y, 200)) AS x FROM p WHERE x <= y) SELECT k, x AS start_line, least(x + 199, y) AS end_line FROM q""",
    "chunk_ordinals": f"WITH {FILES}, {LINES.format('f')}, x AS (SELECT path, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM l) SELECT path, line, CASE WHEN length(t) > 200 THEN (sum(CASE WHEN length(t) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line))::BIGINT END AS ordinal FROM x",
    "file_admissibility": f"WITH {STATES} SELECT path, state, 'text' AS inferred FROM t",
    "index_accounting": f"WITH {STATES} SELECT count(*) FILTER (state IN ('indexed', 'fallback')) AS indexed, count(*) FILTER (state NOT IN ('indexed', 'fallback')) AS skipped, count(*) FILTER (state = 'fallback') AS fallback, count(*) FILTER (state <> 'indexed') AS warnings FROM t",
    "source_fingerprint": f"WITH {WINDOWS}, {IDS} SELECT path, sha256('source-index' || chr(10) || '1' || chr(10) || string_agg(id, chr(10) ORDER BY id)) AS fingerprint, count(*) AS chunks FROM i GROUP BY path",
    "search_exact_topk": f"WITH {HITS} SELECT id, path, match_count, len(hit) AS distinct_match_line_count FROM h ORDER BY match_count DESC, lower(path), id LIMIT 10",
    "search_exact_case_sensitive": f"WITH {CHUNKS} SELECT id, (length(content) - length(replace(content, 'The', ''))) // 3 AS match_count FROM c WHERE contains(content, 'The')",
    "search_regex_topk": f"WITH {CHUNKS}, r AS (SELECT *, len(regexp_extract_all(content, '(?i)th[a-z]+tion')) AS match_count FROM c) SELECT id, path, match_count FROM r WHERE match_count > 0 ORDER BY match_count DESC, lower(path), id LIMIT 25",
    "search_match_lines": f"WITH {HITS} SELECT id, len(hit) AS distinct_match_line_count, array_to_string(hit[1:5], ',') AS match_lines, len(hit) > 5 AS match_lines_truncated FROM h",
    "search_excerpt": f"""WITH {HITS}, x AS (SELECT *, instr(lower(content), 'that the') AS pos FROM h), y AS (SELECT *, length(left(content, pos - 1)) - length(replace(left(content, pos - 1), chr(10), '')) + 1 AS ln FROM x),
      z AS (SELECT *, greatest(1, ln - 1) AS a, least(len(ls), ln + 1) AS b FROM y), r AS (SELECT *, array_to_string(ls[a:b], chr(10)) AS raw, pos - 1 - CASE WHEN a > 1 THEN length(array_to_string(ls[1:a - 1], chr(10))) + 1 ELSE 0 END AS rel FROM z),
      k AS (SELECT *, CASE WHEN length(raw) > 120 THEN least(greatest(0, rel - 40), length(raw) - 120) ELSE 0 END AS clip FROM r),
      m AS (SELECT *, CASE WHEN length(raw) > 120 THEN substr(raw, clip + 1, 120 - (clip > 0)::INT - (clip + 120 < length(raw))::INT) ELSE raw END AS kept, a + length(left(raw, clip)) - length(replace(left(raw, clip), chr(10), '')) AS s FROM k)
      SELECT id, CASE WHEN length(raw) > 120 THEN CASE WHEN clip > 0 THEN '…' ELSE '' END || kept || CASE WHEN clip + 120 < length(raw) THEN '…' ELSE '' END ELSE raw END AS excerpt, s AS excerpt_start_line, greatest(s, s + length(kept) - length(replace(kept, chr(10), '')) - (right(kept, 1) = chr(10))::INT) AS excerpt_end_line FROM m""",
    "path_prefix_candidates": f"WITH {CHUNKS} SELECT id, path FROM c WHERE starts_with(path, 'src1/en') OR starts_with(path, 'src2/fr/doc_1') OR starts_with(path, 'src3_')",
    "id_candidates_semi": f"WITH {CHUNKS} SELECT id, path FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "token_estimate": f"WITH {FILES} SELECT path, (strlen(content) + 3) // 4 AS tokens FROM f",
    "token_features": f"WITH {FILES}, t AS (SELECT path, list_transform(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$.-]*|[0-9]+'), lambda x: lower(x)) AS ts FROM f) SELECT path, len(ts) AS tokens, len(list_distinct(ts)) AS distinct_tokens, greatest(0, len(ts) - 1) AS bigrams FROM t",
    "lexical_score": f"WITH {CHUNKS} SELECT id, round({LEXICAL}, 6) AS score FROM c",
    "knn_exact": f"WITH {KNN} SELECT query_id, rank, id, cosine FROM knn",
    "knn_affine_vs_cosine": f"WITH {KNN} SELECT query_id, id, cosine, least(1, greatest(0, (cosine + 1) / 2)) AS affine FROM knn WHERE rank <= 5",
    "retrieval_metrics_by_case": f"WITH {CASES} SELECT case_id, first_rank, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS reciprocal_rank FROM b",
    "retrieval_metrics": f"WITH {METRICS} SELECT * FROM mm",
    "retrieval_regressions": f"WITH {METRICS} SELECT * FROM (SELECT 'hit_rate_at_1' AS metric, hit_rate_at_1 AS value, 0.99::DOUBLE AS floor FROM mm UNION ALL SELECT 'hit_rate_at_5', hit_rate_at_5, 0.0::DOUBLE FROM mm UNION ALL SELECT 'mrr', mrr, 0.999::DOUBLE FROM mm) WHERE value < floor",
    "benchmark_containment": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0",
    "hybrid_rank": f"WITH {HYBRID} SELECT query_id, rank, id, score, summary FROM hr",
    "hybrid_packed": f"""WITH RECURSIVE {HYBRID}, rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(path), id) AS pr, '[source id=' || id || ' path=' || path || ' lines=1-9 language=' || language || ' kind=' || kind || ' symbol=' || symbol || ']' || chr(10) || content || chr(10) || '[/source]' AS src,
        '[summary id=' || id || ' path=' || path || ' lines=1-9 symbol=' || symbol || ']' || chr(10) || summary || chr(10) || '[/summary]' AS brief FROM hr), z AS (SELECT query_id, pr, id, src, brief, strlen(src) AS s, strlen(brief) AS m FROM rr),
      p AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS bytes, 0::BIGINT AS used, 0::BIGINT AS n, NULL::VARCHAR AS id, NULL::VARCHAR AS how, NULL::BIGINT AS cost, NULL::VARCHAR AS text FROM (SELECT DISTINCT query_id FROM z)
        UNION ALL SELECT query_id, rank, CASE how WHEN 'source' THEN sb WHEN 'summary' THEN mb ELSE bytes END, CASE how WHEN 'source' THEN st WHEN 'summary' THEN mt ELSE used END, n + (how IS NOT NULL)::INT, id, how, CASE how WHEN 'source' THEN st - used WHEN 'summary' THEN mt - used END, CASE how WHEN 'source' THEN src WHEN 'summary' THEN brief END FROM (
          SELECT *, CASE WHEN st <= 3000 THEN 'source' WHEN mt <= 3000 THEN 'summary' END AS how FROM (SELECT p.query_id, z.pr AS rank, p.bytes, p.used, p.n, z.id, src, brief, p.bytes + z.s + 2 * (p.n > 0)::INT AS sb, (p.bytes + z.s + 2 * (p.n > 0)::INT + 3) // 4 + 8 * (p.n + 1) AS st, p.bytes + z.m + 2 * (p.n > 0)::INT AS mb, (p.bytes + z.m + 2 * (p.n > 0)::INT + 3) // 4 + 8 * (p.n + 1) AS mt FROM p JOIN z ON z.query_id = p.query_id AND z.pr = p.rank + 1)))
      SELECT query_id, rank, id, coalesce(how, 'omitted') AS representation, cost AS estimated_tokens, sha256(text) AS text_sha256 FROM p WHERE rank > 0""",
    "pack_budget": """WITH RECURSIVE r AS (SELECT source AS q, doc_id, doc_id::VARCHAR AS id, strlen(text) AS s, CASE WHEN doc_id % 3 = 0 THEN 80 END AS m, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
      p AS (SELECT q, 0::BIGINT AS rank, 0::BIGINT AS doc_id, 0::BIGINT AS bytes, 0::BIGINT AS used, 0::BIGINT AS n, NULL::VARCHAR AS id, NULL::VARCHAR AS how, 0::BIGINT AS cost FROM (SELECT DISTINCT q FROM r)
        UNION ALL SELECT q, rank, doc_id, CASE how WHEN 'source' THEN sb WHEN 'summary' THEN mb ELSE bytes END, CASE how WHEN 'source' THEN st WHEN 'summary' THEN mt ELSE used END, n + (how IS NOT NULL)::INT, id, how, CASE how WHEN 'source' THEN st ELSE mt END - used FROM (
          SELECT *, CASE WHEN st <= 6000 THEN 'source' WHEN mt <= 6000 THEN 'summary' END AS how FROM (SELECT p.q, r.rank, r.doc_id, p.bytes, p.used, p.n, r.id, p.bytes + r.s + 2 * (p.n > 0)::INT AS sb, (p.bytes + r.s + 2 * (p.n > 0)::INT + 3) // 4 + 8 * (p.n + 1) AS st, p.bytes + r.m + 2 * (p.n > 0)::INT AS mb, (p.bytes + r.m + 2 * (p.n > 0)::INT + 3) // 4 + 8 * (p.n + 1) AS mt FROM p JOIN r ON r.q = p.q AND r.rank = p.rank + 1)))
      SELECT q AS query_id, doc_id AS rank, id, how AS representation, cost AS estimated_tokens FROM p WHERE how IS NOT NULL""",
    "summary_file": rf"""WITH {WINDOWS} SELECT path, count(*) AS chunks, 0::BIGINT AS methods, array_to_string(list_filter([{', '.join(f"CASE WHEN bool_or(regexp_matches(content, '{p}')) THEN '{n}' END" for n, p in [('cryptography', r'(?i)\b(?:Cipher|SecretKey|MessageDigest|Mac|encrypt|decrypt)\b'), ('networking', r'(?i)\b(?:https?|Retrofit|OkHttp|Request|Response|socket)\b'), ('authentication', r'(?i)\b(?:auth|login|token|jwt|oauth|credential)\b'), ('native/JNI', r'\b(?:native|System\.loadLibrary|JNI)\b'), ('reflection', r'\b(?:Class\.forName|getDeclaredMethod|reflect)\b')])}], lambda x: x IS NOT NULL), ',') AS indicators, count(DISTINCT symbol) AS symbols FROM w GROUP BY path""",
    "summary_package": f"""WITH {CHUNKS}, g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, count(*) AS chunks, list_sort(list(DISTINCT path)) AS ps, list_sort(list(DISTINCT symbol)) AS ss FROM c GROUP BY 1)
      SELECT package, len(ps) AS files, chunks, 'Package ' || package || ': ' || len(ps) || ' files, ' || chunks || ' chunks. Files: ' || array_to_string(ps[1:15], ', ') || CASE WHEN len(ps) > 15 THEN ' (+' || (len(ps) - 15) || ' more)' ELSE '' END || '. Symbols: ' || array_to_string(ss[1:25], ', ') || '.' AS content FROM g""",
    "summary_project": f"WITH {CHUNKS} SELECT count(DISTINCT path) AS files, count(*) AS chunks, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM c",
    "summary_union_levels": f"WITH {CHUNKS}, g AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS package, count(*) AS n FROM c GROUP BY 1, 2) SELECT 'method' AS level, path || '#' || symbol AS scope, 1::BIGINT AS files, count(*) AS chunks FROM c WHERE kind = 'method' GROUP BY path, symbol UNION ALL SELECT 'class' AS level, path AS scope, 1::BIGINT AS files, n AS chunks FROM g UNION ALL SELECT 'package', package, count(*), sum(n)::BIGINT FROM g GROUP BY 2 UNION ALL SELECT 'project', 'project', count(*), sum(n)::BIGINT FROM g",
    "report_table": f"""WITH {CHUNKS}, g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, count(DISTINCT path) AS files, count(*) AS chunks FROM c GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY package) AS n FROM g)
      SELECT '| package | files | chunks |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || package || ' | ' || files || ' | ' || chunks || ' |', chr(10) ORDER BY package) FILTER (n <= 30) AS markdown, count(*) FILTER (n <= 30) AS shown, count(*) AS total FROM t""",
    "indicators": r"""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)\b(?:Cipher|SecretKey|MessageDigest|Mac|encrypt|decrypt)\b') THEN 'cryptography' END, CASE WHEN regexp_matches(html, '(?i)\b(?:https?|Retrofit|OkHttp|Request|Response|socket)\b') THEN 'networking' END, CASE WHEN regexp_matches(html, '(?i)\b(?:auth|login|token|jwt|oauth|credential)\b') THEN 'authentication' END, CASE WHEN regexp_matches(html, '\b(?:native|System\.loadLibrary|JNI)\b') THEN 'native/JNI' END, CASE WHEN regexp_matches(html, '\b(?:Class\.forName|getDeclaredMethod|reflect)\b') THEN 'reflection' END], lambda x: x IS NOT NULL), ',') AS indicators FROM pages""",
    "signal_scores": f"WITH {SCORES} SELECT k, files, names, short_names, reflection, encoded, control, lines, round(name_score, 6) AS name_score, round(reflection_score, 6) AS reflection_score, round(string_score, 6) AS string_score, round(control_score, 6) AS control_score FROM sc",
    "signal_classification": f"""WITH {SCORES}, x AS (SELECT *, greatest(name_score, string_score, control_score) AS best, (name_score >= 0.55)::INT + (string_score >= 0.55)::INT + (control_score >= 0.55)::INT AS strong FROM sc)
      SELECT k, CASE WHEN strong > 1 OR (reflection_score >= 0.65 AND strong > 0) THEN 'mixed-or-custom' WHEN strong = 0 THEN 'none-detected' WHEN name_score = best THEN 'name-obfuscation' WHEN string_score = best THEN 'string-obfuscation' ELSE 'control-flow-obfuscation' END AS kind, round(CASE WHEN strong > 0 THEN best ELSE least(0.95, 1 - best) END, 4) AS confidence FROM x""",
    "identifier_entropy": f"WITH {NAMES}, id AS (SELECT k, unnest(ids) AS x FROM sg), ch AS (SELECT k, unnest(string_split(x, '')) AS ch FROM id), n AS (SELECT k, ch, count(*) AS n FROM ch WHERE ch <> '' GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM n) SELECT k, round(-sum(n::DOUBLE / t * log2(n::DOUBLE / t)), 6) AS entropy FROM t GROUP BY k",
    "url_patterns": f"SELECT page_id, {PATTERN} AS pattern FROM pages",
    "url_host": f"SELECT page_id, {HOST} AS host FROM pages",
    "endpoint_groups": f"WITH {FLOWS} SELECT {PATTERN} AS pattern, method, {HOST} AS host, count(*) AS flow_count, least(50, count(DISTINCT url)) AS urls FROM fl GROUP BY 1, 2, 3",
    "header_redaction": f"SELECT page_id AS id, {HOST} AS host, 'sha256:' || sha256('session=' || page_id) AS cookie FROM pages",
    "flow_documents": f"""WITH {FLOWS}, d AS (SELECT id::VARCHAR AS flow_id, 'request_summary' AS chunk_type, '[NETWORK FLOW] ' || method || ' ' || url || chr(10) || 'Status: ' || status || chr(10) || 'Duration: ' || duration_ms || 'ms' || chr(10) || 'Request Headers:' || chr(10) || '  Cookie: sha256:' || sha256('session=' || id) || chr(10) || '  Host: ' || {HOST} || chr(10) AS text FROM fl
      UNION ALL SELECT id::VARCHAR, 'response_summary', '[NETWORK RESPONSE] ' || method || ' ' || url || chr(10) || 'Status: ' || status || chr(10) || 'Response Headers:' || chr(10) || '  Content-Type: text/html' || chr(10) FROM fl) SELECT sha256(flow_id || ':' || chunk_type) AS doc_id, flow_id, chunk_type, left(text, 4000) AS text FROM d""",
    "flow_traffic": f"WITH {FLOWS} SELECT count(*) AS flows, 0::BIGINT AS request_bytes, sum(response_size)::BIGINT AS response_bytes FROM fl",
    "flow_search": f"WITH {FLOWS} SELECT id, url FROM fl WHERE contains(lower(url), 'example.com') OR contains(lower({HOST}), 'example.com') ORDER BY id LIMIT 20",
    "flow_merge_live_history": f"WITH {FLOWS}, p AS (SELECT id, {PATTERN} AS url FROM fl) SELECT id, url, 'live' AS origin FROM p WHERE id % 4 = 0 UNION ALL SELECT id, url, 'indexed' FROM p WHERE url NOT IN (SELECT url FROM p WHERE id % 4 = 0)",
    "hook_event_parse": "SELECT event_type AS hook_type, 'c' || (user_id % 5) AS class_name, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1, 2",
    "hook_event_counts": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "latest_run_per_tool": f"WITH {RUNS} SELECT project_id, tool, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id, tool ORDER BY started_at DESC, run_id DESC) AS n FROM ru) WHERE n = 1",
    "lineage_chain": f"WITH {RUNS}, x AS (SELECT *, row_number() OVER (PARTITION BY project_id, tool ORDER BY started_at DESC, run_id DESC) AS n FROM ru WHERE status = 'completed') SELECT project_id, max(run_id) FILTER (n = 1 AND tool = 'click') AS click_run, max(run_id) FILTER (n = 1 AND tool = 'purchase') AS purchase_run, max(run_id) FILTER (n = 1 AND tool = 'view') AS view_run FROM x GROUP BY 1",
    "loop_detection": f"WITH {RUNS}, x AS (SELECT run_id, count(*) OVER (PARTITION BY project_id, tool ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS nth FROM ru) SELECT run_id, nth, nth > 3 AS looping FROM x",
    "dependency_ready": "WITH s AS (SELECT conv_id AS session_id, turn AS step_id, CASE WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM conversations) SELECT a.session_id, a.step_id, a.status, CASE WHEN a.step_id > 0 THEN coalesce(b.status = 'completed', false) ELSE true END AS ready FROM s a LEFT JOIN s b ON a.session_id = b.session_id AND b.step_id = a.step_id - 1",
    "finding_evidence_semi": f"WITH {FINDINGS} SELECT DISTINCT finding_id FROM fi JOIN documents ON doc_id = evidence_id WHERE lang = 'en'",
    "finding_evidence_missing": f"WITH {FINDINGS} SELECT finding_id, evidence_id, doc_id IS NULL AS missing FROM fi LEFT JOIN documents ON doc_id = evidence_id",
    "correlation_edges": "WITH e AS (SELECT event_id AS edge_id, event_id % 3000 AS source_id, user_id % 700 AS network_id, 0.8::DOUBLE AS confidence FROM events) SELECT e.*, source_id IN (SELECT doc_id FROM documents) AS source_found, network_id IN (SELECT page_id FROM pages) AS network_found FROM e",
    "orphan_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "usage_ledger": "SELECT l_returnflag AS model, l_linestatus AS provider, count(*) AS calls, sum(l_quantity)::BIGINT AS tokens, round(sum(CASE WHEN l_discount > 0.02::DOUBLE THEN l_discount ELSE 0 END), 2) AS cost FROM lineitem GROUP BY 1, 2",
    "store_upsert_latest": "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "store_insert_absent": "SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)",
    "store_update_by_key": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "exported_state_table": f"WITH {EXPORT} SELECT id, exported, exported_source, exported_source = 'missing-required-explicit' AS violation FROM ex",
    "permission_inheritance": f"WITH {KINDS}, {PERMISSIONS.format('co')} SELECT id, effective_permission, permission_source, effective_read, effective_write FROM pe",
    "attack_surface": f"""WITH {EXPORT}, {PERMISSIONS.format('ex')}, u AS (SELECT *, CASE WHEN kind = 'provider' THEN list_filter([CASE WHEN effective_read IS NULL THEN 'read' END, CASE WHEN effective_write IS NULL THEN 'write' END], lambda x: x IS NOT NULL) WHEN effective_permission IS NULL THEN ['invoke'] ELSE [] END AS un FROM pe WHERE coalesce(enabled, true) AND coalesce(exported, true) AND exported_source <> 'missing-required-explicit')
      SELECT id, CASE WHEN exported IS NULL AND enabled IS NULL THEN 'potential attack surface (export state is indeterminate; enabled state is indeterminate); ' WHEN exported IS NULL THEN 'potential attack surface (export state is indeterminate); ' WHEN enabled IS NULL THEN 'potential attack surface (enabled state is indeterminate); ' ELSE '' END || CASE WHEN kind = 'provider' THEN CASE len(un) WHEN 0 THEN 'exported provider declares read and write permission guards' WHEN 2 THEN 'exported provider has no read or write permission guard' ELSE 'exported provider has no ' || un[1] || ' permission guard' END WHEN len(un) = 0 THEN 'exported component declares a permission guard' ELSE 'exported component has no permission guard' END AS reason, array_to_string(un, ',') AS unguarded FROM u""",
    "flow_stream_docs": "SELECT 'https://h' || (user_id % 3) || '/u/{id}' AS pattern, event_type AS method, 'h' || (user_id % 3) AS host, count(DISTINCT event_id) AS flow_count FROM events GROUP BY 1, 2, 3",
}
TWINS[
    "retrieval_benchmark_json"
] = f"""WITH {METRICS} SELECT '{{"cases":' || cases || ',"hit_at_1":' || hit_at_1 || ',"hit_at_3":' || hit_at_3 || ',"hit_at_5":' || hit_at_5 || ',"hit_rate_at_1":' || hit_rate_at_1 || ',"hit_rate_at_3":' || hit_rate_at_3 || ',"hit_rate_at_5":' || hit_rate_at_5 || ',"mrr":' || mrr || '}}' || chr(10) AS json FROM mm"""
TWINS |= {name: sql for name, sql in RECORD_TWINS.items() if sql}
TWINS["method_summaries"] = f"""WITH {CHUNKS}, {LINES.format('c')}, t AS (SELECT *, coalesce(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> '')[1], '<empty>') AS first FROM l WHERE kind = 'method'),
  x AS (SELECT id, symbol || ' in ' || path || ':1-9; signature `' || CASE WHEN length(first) > 240 THEN left(first, 237) || '...' ELSE first END || '`; indicators: ' || coalesce(nullif(array_to_string({INDICATED}, ', '), ''), 'none') || '.' AS content FROM t) SELECT id, sha256(content) AS content_sha256, length(content) AS chars FROM x"""
TWINS["retrieval_by_id_or_path"] = f"""WITH {KNN}, r AS (SELECT query_id AS case_id, rank, id, e.label::VARCHAR AS path FROM knn JOIN embeddings e ON e.vec_id = id WHERE id <> query_id),
  b AS (SELECT q.vec_id AS case_id, min(rank) FILTER (r.id IN (q.vec_id + 1, q.vec_id + 2) OR r.path = ((q.label + 1) % 5)::VARCHAR) AS first_rank FROM embeddings q LEFT JOIN r ON r.case_id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1)
  SELECT case_id, first_rank, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS reciprocal_rank FROM b"""
TWINS["ivf_exact"] = TWINS["knn_exact"]
MARKS = f"""{CHUNKS}, mk AS (SELECT product, path, line FROM (SELECT path, unnest(string_split(lower(content), chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM c)
  JOIN (VALUES ('Mit', 'mit license'), ('Apache', 'apache license'), ('Gpl', 'general public')) v(product, m) ON contains(l, m))"""
TWINS["product_markers"] = f"WITH {MARKS} SELECT * FROM mk"
TWINS["marker_locators"] = f"WITH {MARKS}, p AS (SELECT DISTINCT product, path FROM mk) SELECT product, count(*) AS files, array_to_string(list_sort(list(path))[1:3], ',') AS locators FROM p GROUP BY 1"
DOCUMENT_SCORES = SCORES.replace(CODE, f"{CHUNKS}, co AS (SELECT language AS k, coalesce(content, '') AS html FROM c)")
TWINS["marked_classification"] = TWINS["signal_classification"].replace(SCORES, DOCUMENT_SCORES).replace(
    "SELECT k, CASE", "SELECT k, marked, CASE WHEN marked AND strong = 0 THEN 'mixed-or-custom'"
).replace(
    "round(CASE", "round(CASE WHEN marked THEN greatest(0.9, CASE WHEN strong > 0 THEN best ELSE least(0.95, 1 - best) END)"
).replace("FROM x", "FROM (SELECT x.*, EXISTS (SELECT 1 FROM c WHERE language IS NOT DISTINCT FROM k AND contains(lower(content), 'general public')) AS marked FROM x)")
TWINS["search_regex_bounded"] = f"""WITH {CHUNKS}, r AS (SELECT id, string_split(content, chr(10)) AS ls FROM c), m AS (SELECT id, unnest(list_transform(ls, lambda x: len(regexp_extract_all(x, '(?i)th[a-z]+tion')))) AS n, unnest(range(1, len(ls) + 1)) AS line FROM r)
  SELECT id, 'found' AS state, sum(n)::BIGINT AS match_count, count(*) AS distinct_match_line_count, array_to_string(list(line ORDER BY line)[1:3], ',') AS match_lines FROM m WHERE n > 0 GROUP BY id"""
TWINS["manifest_permissions"] = """SELECT s_suppkey::VARCHAR AS file, 'android.permission.INTERNET' AS name, false AS dangerous, NULL::INT AS max_sdk, '/manifest/uses-permission[1]' AS locator FROM supplier
  UNION ALL SELECT s_suppkey::VARCHAR, 'android.permission.SEND_SMS', true, 22, '/manifest/uses-permission[2]' FROM supplier WHERE s_suppkey % 3 = 0"""
TWINS["manifest_filters"] = "SELECT s_suppkey::VARCHAR AS file, '/manifest/application/activity[1]' AS component, '/manifest/application/activity[1]/intent-filter[1]' AS locator, 'view' AS actions, 'host=x;scheme=h' || s_suppkey % 2 AS data FROM supplier"
SDK = "su AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS file, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 40 >= 1 THEN s_suppkey % 40 END AS sdk FROM supplier)"
TWINS["manifest_warnings"] = f"""WITH {SDK} SELECT file, '/manifest/application/@android:debuggable' AS locator, 'value ''@bool/d'' is not a literal boolean; its effective value remains indeterminate without Android resource resolution.' AS warning FROM su WHERE k % 5 = 0
  UNION ALL SELECT file, '/manifest/application/@android:debuggable', 'treated conservatively as true in the boolean summary.' FROM su WHERE k % 5 = 0
  UNION ALL SELECT file, '/manifest/uses-sdk[1]/@android:targetSdkVersion', 'value is not a numeric API level; exported defaults that depend on target SDK remain indeterminate.' FROM su WHERE sdk IS NULL
  UNION ALL SELECT file, '/manifest/application/provider[1]', 'provider omits android:exported and its default cannot be inferred without a numeric effective target SDK.' FROM su WHERE sdk IS NULL
  UNION ALL SELECT file, '/manifest/application/activity[1]', 'activity has intent filters but omits android:exported; a nonnumeric target SDK prevents determining whether legacy inference or the Android 12 explicit requirement applies.' FROM su WHERE sdk IS NULL
  UNION ALL SELECT file, '/manifest/application/activity[1]', 'targetSdkVersion ' || sdk || ' requires activity components with intent filters to declare android:exported explicitly; this manifest is invalid as declared and the effective export state was not inferred.' FROM su WHERE sdk >= 31"""
TWINS["manifest_surface"] = f"""WITH {SDK} SELECT file, 'p' || k || '.A' || k % 7 AS name, CASE WHEN sdk IS NULL THEN 'potential attack surface (export state is indeterminate); ' ELSE '' END || 'exported component has no permission guard' AS reason, '/manifest/application/activity[1]' AS evidence FROM su WHERE sdk IS NULL OR sdk < 31
  UNION ALL SELECT file, 'q.P', CASE WHEN sdk IS NULL THEN 'potential attack surface (export state is indeterminate); ' ELSE '' END || 'exported provider declares read and write permission guards', '/manifest/application/provider[1],/manifest/application/provider[1]/@android:permission' FROM su WHERE sdk IS NULL OR sdk < 17"""
