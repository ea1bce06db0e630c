"""DuckDB oracle SQL: the same bindings as ``bindings.py`` and the expected
result of each registered query, computed directly (no JSON parsing, no
retrieval library) from the driver tables.
"""

from __future__ import annotations

from . import bindings as B


def _case(key: str, values: list, else_=None) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {key} = {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE {arms} ELSE {lit(else_)} END)"


SEV_RANK_SQL = ("(CASE {x} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 "
                "WHEN 'LOW' THEN 1 ELSE 0 END)")


def rank(x: str) -> str:
    return SEV_RANK_SQL.format(x=x)


def round2(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


# b_findings with the validated values the reply parser must produce.
FINDINGS_CTE = f"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
bf AS (
  SELECT ev.*,
         event_id // 8 AS fn_id,
         'app_' || CAST(event_id // 8 // 25 AS VARCHAR) || '.py' AS file,
         CAST((event_id // 8) % 25 AS INTEGER) AS fn_ord,
         CAST(event_id % 8 AS INTEGER) AS finding_pos,
         {_case('k % 13', [c for c, _ in B.CWE_BY_K13])} AS cwe_raw,
         {_case('k % 13', [n for _, n in B.CWE_BY_K13])} AS cwe_name,
         {_case('(k + event_id) % 7', B.SEVERITY_BY_7)} AS severity_raw,
         (k + event_id) % 7 = 6 AS severity_null,
         CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-4' AS conf_text,
         'line ' || CAST(event_id % 8 + 1 AS VARCHAR) AS line_hint,
         'unsafe ' || event_type || ' handling' AS description,
         'payload_' || CAST(k AS VARCHAR) AS evidence,
         'validate input ' || CAST(k AS VARCHAR) AS solution,
         list_slice(['CVE-2024-' || CAST(k AS VARCHAR), 'CVE-2023-' || CAST(k AS VARCHAR),
                     'CWE-' || CAST(k AS VARCHAR), 'REF-1', 'REF-2', 'REF-3', 'REF-4'],
                    1, k % 7 + 1) AS refs,
         k % 17 <> 16 AS is_object
  FROM ev
),
vf AS (
  SELECT file, fn_ord, fn_id, finding_pos, k, event_id, event_type,
         COALESCE(cwe_raw, 'CWE-Unknown') AS cwe_id, cwe_name,
         CASE WHEN severity_null THEN (CASE WHEN k % 2 = 0 THEN 'None' ELSE 'LOW' END)
              ELSE severity_raw END AS severity_text,
         CASE WHEN upper(severity_raw) IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO')
              THEN upper(severity_raw) ELSE 'LOW' END AS severity,
         {round2("least(1.0, greatest(0.0, CAST(conf_text AS DOUBLE)))")} AS confidence,
         line_hint, description, evidence, solution, refs,
         fn_id % 5 AS form, fn_id % 11 = 10 AS failed
  FROM bf WHERE is_object
),
good AS (SELECT * FROM vf WHERE form IN (0, 1, 2, 3) AND NOT failed),
fns AS (
  SELECT DISTINCT 'app_' || CAST(event_id // 8 // 25 AS VARCHAR) || '.py' AS file,
         CAST((event_id // 8) % 25 AS INTEGER) AS fn_ord, event_id // 8 AS fn_id
  FROM events
),
fnames AS (
  SELECT file, fn_ord, fn_id, 'fn_' || CAST(fn_ord % 20 AS VARCHAR) AS name,
         fn_ord * 10 + 1 AS lineno, fn_ord * 10 + 8 AS end_lineno,
         'def fn_' || CAST(fn_ord % 20 AS VARCHAR) || '(a, b):' || chr(10) || '    # ord '
           || CAST(fn_ord AS VARCHAR) || chr(10) || '    return a' || chr(10) AS source,
         fn_id % 11 = 10 AS failed
  FROM fns
),
ranked AS (
  SELECT *, {rank('severity')} AS sev_rank,
         CAST(row_number() OVER (PARTITION BY file, fn_ord
              ORDER BY {rank('severity')} DESC, finding_pos) - 1 AS INTEGER) AS rank_pos
  FROM good WHERE {rank('severity')} >= 1
)
"""


def with_findings(body: str) -> str:
    return "WITH " + FINDINGS_CTE.strip() + "\n" + body


def queries() -> dict[str, str]:
    q: dict[str, str] = {}

    q["reply_parse_status"] = with_findings("""
SELECT CASE WHEN fn_id % 11 = 10 THEN 'no_reply'
            WHEN fn_id % 5 IN (0, 1) THEN 'direct'
            WHEN fn_id % 5 IN (2, 3) THEN 'fallback' ELSE 'none' END AS parse_status,
       count(*) AS n_replies
FROM fns GROUP BY 1""")

    q["reply_array_parse"] = with_findings("""
SELECT f.file, f.fn_ord,
       CASE WHEN f.fn_id % 11 = 10 THEN 'no_reply'
            WHEN f.fn_id % 5 IN (0, 1) THEN 'direct'
            WHEN f.fn_id % 5 IN (2, 3) THEN 'fallback' ELSE 'none' END AS parse_status,
       CAST(CASE WHEN f.fn_id % 11 = 10 OR f.fn_id % 5 = 4 THEN 0 ELSE c.n END AS INTEGER) AS n_elements
FROM fns f JOIN (SELECT fn_id, count(*) AS n FROM bf GROUP BY fn_id) c USING (fn_id)""")

    q["reply_findings"] = with_findings("""
SELECT file, fn_ord, finding_pos FROM good""")

    q["finding_validate"] = with_findings("""
SELECT file, fn_ord, finding_pos, cwe_id, cwe_name, severity, confidence, line_hint,
       description, evidence, solution, array_to_string(refs, '|') AS references_text,
       CAST(NULL AS VARCHAR) AS quarantine_reason
FROM good""")

    q["severity_rank"] = with_findings(f"""
SELECT file, fn_ord, finding_pos, severity_text,
       {rank('severity_text')} AS raw_rank, severity, {rank('severity')} AS sev_rank
FROM good""")

    q["findings_min_severity"] = with_findings(f"""
SELECT file, fn_ord, finding_pos, severity FROM good WHERE {rank('severity')} >= 2""")

    q["findings_ranked"] = with_findings("""
SELECT file, fn_ord, finding_pos, severity, rank_pos FROM ranked""")

    q["findings_flatten"] = with_findings("""
SELECT r.file, r.fn_ord, n.name AS function, r.rank_pos, r.cwe_id, r.severity, r.confidence
FROM ranked r JOIN fnames n USING (file, fn_ord)""")

    q["severity_counts"] = with_findings("""
SELECT file, severity, count(*) AS n_findings FROM ranked GROUP BY file, severity""")

    q["severity_counts_full"] = with_findings("""
SELECT f.file,
       count(r.severity) FILTER (WHERE r.severity = 'CRITICAL') AS CRITICAL,
       count(r.severity) FILTER (WHERE r.severity = 'HIGH') AS HIGH,
       count(r.severity) FILTER (WHERE r.severity = 'MEDIUM') AS MEDIUM,
       count(r.severity) FILTER (WHERE r.severity = 'LOW') AS LOW,
       count(r.severity) FILTER (WHERE r.severity = 'INFO') AS INFO
FROM (SELECT DISTINCT file FROM fns) f LEFT JOIN ranked r USING (file)
GROUP BY f.file""")

    q["scan_summary"] = with_findings("""
SELECT n.file, count(*) AS total_functions,
       count(*) FILTER (WHERE coalesce(c.n, 0) > 0) AS functions_with_findings,
       CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total_findings,
       CAST(coalesce(sum(c.p), 0) AS BIGINT) AS priority_findings,
       count(*) FILTER (WHERE n.failed) AS failed_calls
FROM fnames n LEFT JOIN (
  SELECT file, fn_ord, count(*) AS n,
         count(*) FILTER (WHERE severity IN ('CRITICAL','HIGH')) AS p
  FROM ranked GROUP BY file, fn_ord) c USING (file, fn_ord)
GROUP BY n.file""")

    parts = " , ".join(
        f"CASE WHEN c{i} > 0 THEN CAST(c{i} AS VARCHAR) || '×{s}' END"
        for i, s in enumerate(["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]))
    q["function_severity_text"] = with_findings(f"""
SELECT n.file, n.fn_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n_findings,
       CASE WHEN coalesce(c.n, 0) > 0 THEN concat_ws(', ', {parts}) ELSE 'clean' END AS severity_text,
       c.top_severity
FROM fnames n LEFT JOIN (
  SELECT file, fn_ord, count(*) AS n,
         count(*) FILTER (WHERE severity = 'CRITICAL') AS c0,
         count(*) FILTER (WHERE severity = 'HIGH') AS c1,
         count(*) FILTER (WHERE severity = 'MEDIUM') AS c2,
         count(*) FILTER (WHERE severity = 'LOW') AS c3,
         count(*) FILTER (WHERE severity = 'INFO') AS c4,
         arg_max(severity, sev_rank) AS top_severity
  FROM ranked GROUP BY file, fn_ord) c USING (file, fn_ord)""")

    q["references_preview"] = with_findings("""
SELECT file, fn_ord, finding_pos, array_to_string(list_slice(refs, 1, 5), ', ') AS references_preview
FROM good""")

    q["confidence_bands"] = with_findings("""
SELECT file, fn_ord, finding_pos, confidence,
       CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band,
       printf('%.0f', confidence * 100) || '%' AS confidence_pct
FROM good""")

    q["scan_report"] = with_findings("""
SELECT n.file, n.fn_ord, n.name AS function, n.lineno AS line_start, n.end_lineno AS line_end,
       CAST(count(r.rank_pos) AS BIGINT) AS n_findings,
       coalesce(string_agg(r.cwe_id || ':' || r.severity, '|' ORDER BY r.rank_pos), '') AS findings_text,
       CASE WHEN n.failed THEN 'timeout after 120s' END AS error,
       'vuln_scanner' AS tool, '1.0.0' AS version
FROM fnames n LEFT JOIN ranked r USING (file, fn_ord)
GROUP BY n.file, n.fn_ord, n.name, n.lineno, n.end_lineno, n.failed""")

    q["analyze_result"] = with_findings("""
SELECT s.file, 'ok' AS status, coalesce(t.summary, '') AS summary,
       CAST(coalesce(t.total, 0) AS BIGINT) AS total_findings, s.functions_scanned
FROM (SELECT file, count(*) AS functions_scanned FROM fnames GROUP BY file) s
LEFT JOIN (
  SELECT file, string_agg(severity || '=' || CAST(n AS VARCHAR), ', ' ORDER BY fo, rp) AS summary,
         sum(n) AS total
  FROM (SELECT file, severity, count(*) AS n,
               arg_min(fn_ord, fn_ord * 1000 + rank_pos) AS fo,
               min(fn_ord * 1000 + rank_pos) AS rp
        FROM ranked GROUP BY file, severity) GROUP BY file) t USING (file)""")

    q["reply_join"] = with_findings("""
SELECT file || '#' || CAST(fn_ord AS VARCHAR) AS request_id, file, fn_ord,
       CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN failed THEN 'timeout after 120s' END AS error
FROM fnames""")

    # What Python's json and str give for the members in ``B.ODD_MEMBERS``.
    q["reply_odd_values"] = r"""
WITH ev AS (SELECT event_id, event_id % 12 AS m, json_extract_string(props, '$.k') AS k FROM events)
SELECT 'odd#' || CAST(event_id // 6 AS VARCHAR) AS request_id, CAST(event_id % 6 AS INTEGER) AS finding_pos,
       CASE WHEN m = 10 THEN 'None' ELSE 'CWE-Unknown' END AS cwe_id, 'event ' || CAST(event_id AS VARCHAR) AS cwe_name,
       CASE WHEN m = 1 THEN 'CRITICAL' ELSE 'LOW' END AS severity,
       CAST(CASE WHEN m IN (0, 1, 9) THEN 1.0 WHEN m = 2 THEN 0.0 WHEN m = 3 THEN 0.35 WHEN m IN (4, 5) THEN NULL
                 WHEN m = 11 THEN 0.1 ELSE 0.5 END AS DOUBLE) AS confidence,
       CASE WHEN m = 3 THEN '1e-07' ELSE '' END AS line_hint,
       CASE WHEN m = 10 THEN 'said "NaN, Infinity" \ in C:\tmpé [' || k || ']' ELSE '' END AS description,
       CASE WHEN m = 8 THEN '{''line'': ' || k || ', ''code'': ''x = "é" + \''q\'''', ''ok'': True, ''none'': None, ''f'': 0.5}'
            ELSE '' END AS evidence,
       CASE WHEN m = 9 THEN '[''a'', ' || k || ', 2.5, False, {''z'': "it''s", ''a'': [], ''n'': nan}]' ELSE '' END AS solution,
       CASE WHEN m = 6 THEN 'CVE-' || k WHEN m = 7 THEN NULL
            WHEN m = 11 THEN 'R-' || k || '|1.0|None|{''b'': 1, ''a'': ''\t''}' ELSE '' END AS references_text,
       CASE WHEN m IN (4, 5) THEN 'confidence is not a number' WHEN m = 7 THEN 'references is not a list' END AS quarantine_reason
FROM ev"""

    q["report_run"] = with_findings("""
SELECT 'vuln_scanner' AS tool, '1.0.0' AS version, 'llama3' AS model,
       (SELECT count(*) FROM fnames) AS total_functions,
       (SELECT count(*) FROM (SELECT DISTINCT file, fn_ord FROM ranked)) AS functions_with_findings,
       count(*) AS total_findings,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS CRITICAL, count(*) FILTER (WHERE severity = 'HIGH') AS HIGH,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS MEDIUM, count(*) FILTER (WHERE severity = 'LOW') AS LOW,
       count(*) FILTER (WHERE severity = 'INFO') AS INFO,
       (SELECT count(DISTINCT file) FROM fnames) AS n_reports
FROM ranked""")

    q["report_requests"] = with_findings("""
SELECT t.path, CASE WHEN good THEN t.path END AS target,
       CAST(CASE WHEN good THEN n_functions ELSE 0 END AS BIGINT) AS n_results,
       CAST(CASE WHEN good THEN coalesce(n_findings, 0) ELSE 0 END AS BIGINT) AS n_findings,
       CASE WHEN missing THEN 'Report not found at ' || t.path || '. Run analyze_code first.'
            WHEN NOT good THEN 'report is not one JSON object' END AS error
FROM (SELECT *, i % 7 = 3 AS missing, i % 7 <> 3 AND i % 5 NOT IN (1, 2) AS good
      FROM (SELECT file AS path, count(*) AS n_functions,
                   CAST(regexp_extract(file, 'app_([0-9]+)', 1) AS BIGINT) AS i FROM fnames GROUP BY file)) t
LEFT JOIN (SELECT file, count(*) AS n_findings FROM ranked GROUP BY file) r ON r.file = t.path""")

    _retrieval(q)
    _plan(q)
    _hits(q)
    from . import oracle_more
    oracle_more.corpus(q)
    oracle_more.mitigations(q)
    oracle_more.odd_inputs(q)
    oracle_more.replies_text(q)
    return q


KB_CTE = f"""
kb AS (
  SELECT CASE WHEN vec_id % 3 = 0 THEN 'CVE' ELSE 'CWE' END AS source,
         CASE WHEN vec_id % 3 = 0 THEN vec_id // 3 ELSE vec_id - vec_id // 3 - 1 END AS chunk_pos,
         CASE WHEN vec_id % 3 <> 0 THEN 'CWE-' || CAST(vec_id % 97 AS VARCHAR) || '-c'
              || CAST(vec_id AS VARCHAR) END AS chunk_id,
         CASE WHEN vec_id % 3 = 0 THEN 'CVE-2024-' || CAST(vec_id AS VARCHAR) END AS cve_id,
         CASE WHEN vec_id % 3 = 0 THEN 'CWE-' || CAST(label * 7 + 20 AS VARCHAR) END AS cwe_id,
         CASE WHEN vec_id % 3 = 0 THEN {_case('label % 6', B.CVSS_BY_LABEL6)} END AS cvss_severity,
         CASE WHEN vec_id % 3 = 0 THEN (vec_id % 100) / 10.0 END AS cvss_score,
         'chunk ' || CAST(vec_id AS VARCHAR) || ' label ' || CAST(label AS VARCHAR) AS chunk_text,
         CAST(embedding AS DOUBLE[]) AS emb
  FROM embeddings
),
qv AS (
  SELECT CAST(vec_id AS VARCHAR) AS query_id,
         list_transform(CAST(embedding AS DOUBLE[]),
           lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS q
  FROM embeddings
)
"""


def _scores(min_rank: int | None) -> str:
    filt = "" if min_rank is None else f"WHERE source = 'CWE' OR {rank('cvss_severity')} >= {min_rank}"
    return f"""
elig AS (SELECT * FROM kb {filt}),
sc AS (SELECT qv.query_id, elig.*, list_dot_product(qv.q, elig.emb) AS score FROM qv, elig),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, source
                                    ORDER BY score DESC, chunk_pos DESC) AS rn FROM sc)
"""


RETRIEVE_CTE = _scores(1).rstrip() + """,
top AS (SELECT * FROM rk WHERE rn <= 4),
lens AS (SELECT query_id, least(count(*) FILTER (WHERE source = 'CWE'),
                                count(*) FILTER (WHERE source = 'CVE')) AS m
         FROM top GROUP BY query_id),
hits AS (
  SELECT t.*, CAST(2 * (rn - 1) + CASE WHEN source = 'CVE' THEN 1 ELSE 0 END AS INTEGER) AS pos
  FROM top t JOIN lens USING (query_id) WHERE rn <= m
),
hits6 AS (SELECT * FROM hits WHERE pos < 6)
"""


def _retrieval(q: dict[str, str]) -> None:
    w = "WITH " + KB_CTE.strip()
    q["kb_scan"] = w + """
SELECT source, chunk_pos, chunk_id, cve_id, cwe_id, cvss_severity, cvss_score, chunk_text,
       CAST(len(emb) AS INTEGER) AS dim FROM kb"""
    q["kb_from_files"] = q["kb_scan"]
    q["kb_attach_embeddings"] = w + """
SELECT source, chunk_pos, CAST(len(emb) AS INTEGER) AS dim, round(list_sum(emb), 4) AS component_sum
FROM kb"""
    q["kb_from_rows"] = w + """
SELECT source, chunk_pos, chunk_id, cve_id, chunk_text, round(list_sum(emb), 4) AS component_sum FROM kb"""
    q["kb_profile"] = w + """
SELECT source, count(*) AS n_chunks, CAST(max(len(emb)) AS INTEGER) AS embed_dim,
       'nomic-ai/nomic-embed-text-v2-moe' AS embed_model
FROM kb GROUP BY source"""
    q["query_normalize"] = w + """
SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(len(embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6) AS norm_in,
       round(sqrt(list_sum(list_transform(q, lambda y: y * y))), 6) AS norm_out
FROM embeddings JOIN qv ON CAST(vec_id AS VARCHAR) = qv.query_id"""
    for key, lvl in (("kb_similarity", None), ("kb_similarity_filtered", 2)):
        q[key] = w + "," + _scores(lvl).rstrip() + """
SELECT query_id, source, CAST((SELECT count(*) FROM elig e WHERE e.source = rk.source) AS BIGINT)
       AS n_scored, round(score, 4) AS max_score, chunk_pos AS best_chunk_pos
FROM rk WHERE rn = 1"""
    q["kb_topn_per_source"] = w + "," + _scores(1).rstrip() + """
SELECT query_id, source, CAST(rn AS INTEGER) AS rn, chunk_pos, round(score, 4) AS score
FROM rk WHERE rn <= 4"""
    q["kb_retrieve"] = w + "," + RETRIEVE_CTE.rstrip() + """
SELECT query_id, pos, source, chunk_pos, round(score, 4) AS score, chunk_id, cve_id, cvss_severity
FROM hits6"""
    q["rag_context"] = w + "," + RETRIEVE_CTE.rstrip() + """,
blocks AS (
  SELECT query_id, pos,
         CASE WHEN source = 'CWE'
              THEN '[Ref ' || CAST(pos + 1 AS VARCHAR) || ' | ' || coalesce(chunk_id, '')
                   || ' | relevance ' || printf('%.2f', score) || ']'
              ELSE '[Ref ' || CAST(pos + 1 AS VARCHAR) || ' | ' || coalesce(cve_id, '') || ' | CVSS '
                   || coalesce(CAST(cvss_score AS VARCHAR), '?') || ' ' || coalesce(cvss_severity, '?')
                   || ' | ' || coalesce(cwe_id, '') || ' | relevance ' || printf('%.2f', score) || ']'
         END || chr(10) || chunk_text AS b
  FROM hits6
)
SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY pos) AS context FROM blocks GROUP BY query_id"""


def _wordlist_values() -> str:
    from .sources.wordlists import DEFAULT_WORDLIST_MAP
    rows = []
    for cwe, lists in DEFAULT_WORDLIST_MAP.items():
        for i, w in enumerate(lists):
            rows.append(f"('{cwe}', {i}, '{w}')")
    return "wl(cwe_id, wl_pos, wordlist) AS (VALUES " + ", ".join(rows) + ")"


PLAN_CTE = f"""
dd AS (
  SELECT file, cwe_id, cwe_name, severity, sev_rank, fn_ord, rank_pos,
         row_number() OVER (PARTITION BY file, cwe_id ORDER BY sev_rank DESC, fn_ord, rank_pos) AS r
  FROM ranked WHERE cwe_id <> ''
),
cw AS (
  SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY sev_rank DESC, fn_ord, rank_pos) - 1
                    AS INTEGER) AS plan_pos, cwe_id, cwe_name, severity
  FROM dd WHERE r = 1
),
{_wordlist_values()},
tg AS (
  SELECT DISTINCT file,
         CASE WHEN CAST(regexp_extract(file, 'app_(\\d+)\\.py', 1) AS BIGINT) % 7 = 3
              THEN 'http://t.example/' || file || '/user'
              ELSE 'http://t.example/' || file || '/user/FUZZ' END AS target_url
  FROM fnames
),
tv AS (SELECT file, target_url, contains(target_url, 'FUZZ') AS valid FROM tg)
"""


def _jobs_sql(cap: int) -> str:
    return f"""
SELECT c.file, c.plan_pos, CAST(w.wl_pos AS INTEGER) AS job_pos, c.cwe_id, c.cwe_name, w.wordlist,
       '/results/ffuf_' || replace(c.cwe_id, '-', '_') || '_'
         || regexp_replace(regexp_extract(w.wordlist, '[^/]*$', 0), '\\.[^.]+$', '') || '.json' AS out_path,
       '/SecLists/' || w.wordlist AS wordlist_path, t.target_url, '200' AS match_codes,
       20 AS workers, 10 AS timeout_s, true AS url_encode
FROM cw c JOIN tv t ON t.file = c.file AND t.valid
JOIN wl w ON w.cwe_id = CASE WHEN c.cwe_id IN (SELECT cwe_id FROM wl) THEN c.cwe_id ELSE '_default' END
WHERE w.wl_pos < {cap}"""


def _plan(q: dict[str, str]) -> None:
    w = "WITH " + FINDINGS_CTE.strip() + "," + PLAN_CTE.rstrip()
    q["plan_cwe_dedupe"] = w + "\nSELECT * FROM cw"
    q["report_plan"] = q["plan_cwe_dedupe"]
    q["report_files"] = q["findings_flatten"]
    q["plan_wordlists"] = w + """
SELECT c.file, c.cwe_id, CAST(w.wl_pos AS INTEGER) AS job_pos, w.wordlist
FROM cw c JOIN wl w ON w.cwe_id = CASE WHEN c.cwe_id IN (SELECT cwe_id FROM wl)
                                      THEN c.cwe_id ELSE '_default' END
WHERE w.wl_pos < 2"""
    q["fuzz_plan_jobs"] = w + _jobs_sql(1)
    q["plan_target_check"] = w + "\nSELECT file, target_url, valid FROM tv"
    q["plan_summary"] = w + f""",
jobs AS ({_jobs_sql(1)})
SELECT t.file, CAST((SELECT count(*) FROM jobs j WHERE j.file = t.file) AS BIGINT) AS n_jobs,
       CAST((SELECT count(*) FROM cw c WHERE c.file = t.file) AS BIGINT) AS n_cwes,
       coalesce((SELECT string_agg(cwe_id, ', ' ORDER BY plan_pos) FROM cw c WHERE c.file = t.file),
                'none') AS cwe_list
FROM tv t WHERE t.valid"""
    q["plan_collisions"] = w + f""",
jobs AS ({_jobs_sql(4)})
SELECT file, out_path, count(*) AS n_jobs FROM jobs GROUP BY file, out_path HAVING count(*) > 1"""


HITS_CTE = f"""
ev AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
fz AS (
  SELECT *, '/results/ffuf_' || replace(cwe, '-', '_') || '_' || event_type || '-'
              || CAST(event_id // 1000 AS VARCHAR) || '.json' AS file
  FROM (SELECT ev.*, k % 13 AS k13,
               coalesce({_case('k % 13', [c for c, _ in B.CWE_BY_K13])}, 'CWE-Unknown') AS cwe,
               CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 403
                                 WHEN 3 THEN 404 ELSE 500 END AS status,
               (k % 13 = 5 AND event_type = 'error') AS corrupt
        FROM ev)
),
jobs AS (
  SELECT file, k13, corrupt,
         count(*) FILTER (WHERE status IN (200, 403)) AS n_hits,
         string_split(regexp_replace(regexp_extract(file, '[^/]*$', 0), '\\.[^.]+$', ''), '_') AS parts
  FROM fz GROUP BY file, k13, corrupt
),
jr AS (
  SELECT file,
         CASE WHEN corrupt THEN NULL WHEN len(parts) >= 3 AND parts[1] = 'ffuf'
              THEN parts[2] || '-' || parts[3] END AS cwe_id,
         CASE WHEN corrupt THEN NULL WHEN k13 = 7 THEN 'unknown'
              ELSE '/SecLists/list-' || CAST(k13 AS VARCHAR) || '.txt' END AS wordlist,
         CASE WHEN corrupt THEN NULL WHEN k13 = 7 THEN 'unknown' ELSE 'http://t.example/FUZZ' END AS target,
         CAST(CASE WHEN corrupt THEN 0 ELSE n_hits END AS BIGINT) AS hit_count,
         CASE WHEN corrupt THEN 'not a JSON object' END AS error
  FROM jobs
)
"""


def _hits(q: dict[str, str]) -> None:
    w = "WITH " + HITS_CTE.strip()
    q["fuzz_job_parse"] = w + "\nSELECT * FROM jr"
    q["fuzz_hits"] = w + """
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS INTEGER) AS hit_pos,
       'http://t.example/u/' || CAST(user_id AS VARCHAR) AS url, CAST(status AS INTEGER) AS status,
       CAST(k * 10 AS BIGINT) AS length, CAST(k AS BIGINT) AS words,
       CASE WHEN event_id % 9 = 0 THEN '' ELSE 'p' || CAST(event_id AS VARCHAR) END AS input
FROM fz WHERE status IN (200, 403) AND NOT corrupt"""
    q["fuzz_job_errors"] = w + "\nSELECT file, error FROM jr WHERE error IS NOT NULL"
    q["fuzz_report"] = w + """
SELECT 'ok' AS status, count(*) AS n_jobs, count(error) AS n_errors,
       CAST(sum(hit_count) AS BIGINT) AS total_hits FROM jr"""
    q["hits_by_cwe"] = w + """
SELECT cwe_id, count(*) AS n_jobs, CAST(sum(hit_count) AS BIGINT) AS total_hits
FROM jr WHERE error IS NULL GROUP BY cwe_id"""
