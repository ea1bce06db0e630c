"""DuckDB oracle SQL for the corpus, prompt and mitigation queries."""

from __future__ import annotations

from .oracle_sql import FINDINGS_CTE, KB_CTE, RETRIEVE_CTE
from .operators.prompts import (MITIGATION_SYSTEM_PROMPT, MITIGATION_TEMPLATE, SCAN_TEMPLATE,
                                SYSTEM_PROMPT, render_sql)

NL = "chr(10)"

CONTEXT_BLOCKS = """
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
),
ctx AS (
  SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY pos) AS context
  FROM blocks GROUP BY query_id
)
"""

CORPUS_CTE = f"""
pt AS (SELECT p_partkey, p_name, p_partkey // 40 AS mod FROM part),
fc AS (
  SELECT 'm_' || CAST(mod AS VARCHAR) || '.py' AS file,
         CAST(row_number() OVER (PARTITION BY mod ORDER BY p_partkey) - 1 AS INTEGER) AS fn_ord,
         p_partkey, p_name, mod
  FROM pt
),
fcat AS (
  SELECT file, fn_ord, p_partkey, 'f_' || CAST(p_partkey AS VARCHAR) AS name,
         4 * fn_ord + 1 AS lineno, 4 * fn_ord + 3 AS end_lineno, 'a, b' AS args_text,
         p_name AS docstring,
         'def f_' || CAST(p_partkey AS VARCHAR) || '(a, b, *c, d=1):' || {NL} || '    ' || '\"\"\"'
           || p_name || '\"\"\"' || {NL} || '    return a' || {NL} AS source
  FROM fc WHERE mod % 50 <> 13
)
"""


def corpus(q: dict[str, str]) -> None:
    w = "WITH " + CORPUS_CTE.strip()
    q["function_catalog"] = w + """
SELECT file, fn_ord, name, CAST(lineno AS INTEGER) AS lineno,
       CAST(end_lineno AS INTEGER) AS end_lineno, args_text, docstring, source FROM fcat"""
    q["function_parse_errors"] = w + """
SELECT 'm_' || CAST(mod AS VARCHAR) || '.py' AS file, mod % 50 <> 13 AS parse_ok,
       CAST(CASE WHEN mod % 50 = 13 THEN 0 ELSE count(*) END AS INTEGER) AS n_functions
FROM pt GROUP BY mod"""
    q["rag_query_scan"] = w + """
SELECT file, fn_ord, 'Python function ''' || name || ''' vulnerability analysis. Arguments: '
       || args_text || '. ' || substring(docstring, 1, 200) || ' ' || substring(source, 1, 400)
       AS query_text FROM fcat"""
    q["rag_query_tool"] = w + """
SELECT file, fn_ord, 'Python function ''' || name || ''' vulnerability. Args: '
       || args_text || '. ' || substring(source, 1, 400) AS query_text FROM fcat"""
    prompt = render_sql(SCAN_TEMPLATE, SYSTEM_PROMPT, {
        "name": "f.name", "lineno": "f.lineno", "source": "f.source", "context": "c.context"})
    q["scan_prompts"] = (w + "," + KB_CTE.strip() + "," + RETRIEVE_CTE.strip() + ","
                         + CONTEXT_BLOCKS.strip() + f"""
SELECT f.file, f.fn_ord, f.file || '#' || CAST(f.fn_ord AS VARCHAR) AS request_id, {prompt} AS prompt
FROM fcat f JOIN ctx c
  ON c.query_id = CAST(f.p_partkey % (SELECT count(*) FROM embeddings) AS VARCHAR)""")


MITIGATION_CTE = """
cand AS (
  SELECT r.*, n.name AS function, 'MEDIUM' AS min_severity_filter
  FROM ranked r JOIN fnames n USING (file, fn_ord)
  WHERE r.sev_rank >= 2
),
byname AS (
  SELECT file, name, arg_min(source, fn_ord) AS fn_source, count(*) > 1 AS name_ambiguous
  FROM fnames GROUP BY file, name
),
cs AS (
  SELECT c.*, b.fn_source, b.name_ambiguous,
         c.cwe_id || ' ' || c.cwe_name || ' mitigation fix secure code. ' || c.evidence AS query_text,
         CAST(c.k % (SELECT count(*) FROM embeddings) AS VARCHAR) AS vec_key,
         '{"cwe_id": "' || c.cwe_id || '", "explanation": "unsafe ' || c.event_type
           || ' handling reaches a sink", "fixed_code": ' AS obj_head,
         ', "hardening": ["Validate input ' || CAST(c.k AS VARCHAR)
           || '", "Use least privilege"], "references": ["CVE-2024-' || CAST(c.k AS VARCHAR) || '"]}'
           AS obj_tail,
         c.event_id % 4 AS mform
  FROM cand c JOIN byname b ON b.file = c.file AND b.name = c.function
),
cr AS (
  SELECT *, obj_head || '"x = ' || CAST(k AS VARCHAR) || '"' || obj_tail AS plain FROM cs
)
"""


def mitigations(q: dict[str, str]) -> None:
    w = "WITH " + FINDINGS_CTE.strip() + "," + MITIGATION_CTE.strip()
    wk = w + "," + KB_CTE.strip() + "," + RETRIEVE_CTE.strip() + "," + CONTEXT_BLOCKS.strip()
    q["mitigation_candidates"] = w + """
SELECT file, fn_ord, finding_pos, severity, min_severity_filter FROM cand"""
    q["mitigation_source"] = w + """
SELECT file, fn_ord, finding_pos, function, fn_source, name_ambiguous FROM cs"""
    q["rag_query_mitigation"] = w + """
SELECT file, fn_ord, finding_pos, query_text FROM cs"""
    q["mitigation_context"] = wk + """
SELECT DISTINCT cs.query_text, ctx.context FROM cs JOIN ctx ON ctx.query_id = cs.vec_key"""
    prompt = render_sql(MITIGATION_TEMPLATE, MITIGATION_SYSTEM_PROMPT, {
        "cwe_id": "cs.cwe_id", "cwe_name": "cs.cwe_name", "severity": "cs.severity",
        "description": "cs.description", "evidence": "cs.evidence",
        "fn_source": "cs.fn_source", "context": "ctx.context"})
    q["mitigation_prompts"] = wk + f"""
SELECT cs.file, cs.fn_ord, cs.finding_pos,
       cs.file || '#' || CAST(cs.fn_ord AS VARCHAR) || '#' || CAST(cs.finding_pos AS VARCHAR) AS request_id,
       {prompt} AS prompt
FROM cs JOIN ctx ON ctx.query_id = cs.vec_key"""
    q["mitigation_repair"] = w + """
SELECT file, fn_ord, finding_pos,
       CASE WHEN mform IN (0, 1) THEN plain
            WHEN mform = 2 THEN obj_head || '"x = \\"' || CAST(k AS VARCHAR) || '\\"\\nreturn x"' || obj_tail
            ELSE rtrim(substring(plain, 1, length(plain) // 2)) END AS repaired,
       mform <> 3 AS parse_ok
FROM cr"""
    parsed = """
SELECT file, fn_ord, finding_pos, function, cwe_id, severity, mform, min_severity_filter,
       CASE WHEN mform <> 3 THEN 'unsafe ' || event_type || ' handling reaches a sink' END AS explanation,
       CASE WHEN mform IN (0, 1) THEN 'x = ' || CAST(k AS VARCHAR)
            WHEN mform = 2 THEN 'x = "' || CAST(k AS VARCHAR) || '"' || chr(10) || 'return x' END AS fixed_code,
       CASE WHEN mform <> 3 THEN 'Validate input ' || CAST(k AS VARCHAR) || ' | Use least privilege' END
         AS hardening_text,
       CASE WHEN mform <> 3 THEN 'CVE-2024-' || CAST(k AS VARCHAR) END AS references_text,
       CASE WHEN mform = 3 THEN substring(plain, 1, length(plain) // 2) END AS raw_response,
       CASE WHEN mform = 3 THEN 'Could not parse LLM response as JSON' END AS error
FROM cr"""
    q["mitigation_parse"] = w + f"""
SELECT file, fn_ord, finding_pos, function, cwe_id, severity, explanation, fixed_code,
       hardening_text, references_text, raw_response, error FROM ({parsed})"""
    q["mitigation_report"] = w + f"""
SELECT file, 'ok' AS status, count(*) AS total, count(error) AS n_errors,
       any_value(min_severity_filter) AS min_severity_filter
FROM ({parsed}) GROUP BY file"""
    q["mitigation_preview"] = w + f"""
SELECT file, fn_ord, finding_pos, function, cwe_id, severity, substring(explanation, 1, 200) AS why,
       hardening_text AS hardening_preview, fixed_code AS code_preview,
       references_text AS references_preview
FROM ({parsed}) WHERE error IS NULL"""
    q["combined_report"] = w + f"""
SELECT s.file AS target, 'ok' AS analysis_status, s.functions_scanned,
       CAST(coalesce(t.total, 0) AS BIGINT) AS total_findings, CAST(NULL AS VARCHAR) AS fuzzing,
       CAST(coalesce(m.total, 0) AS BIGINT) AS mitigations_total,
       CAST(coalesce(m.n_errors, 0) AS BIGINT) AS mitigation_errors
FROM (SELECT file, count(*) AS functions_scanned FROM fnames GROUP BY file) s
LEFT JOIN (SELECT file, count(*) AS total FROM ranked GROUP BY file) t USING (file)
LEFT JOIN (SELECT file, count(*) AS total, count(error) AS n_errors FROM ({parsed}) GROUP BY file) m
  USING (file)"""


# What Python gives for ``B.ODD_MITIGATIONS`` and ``B.odd_sources``, spelled out.
ODD_MITIGATION_CTE = r"""
WITH m AS (SELECT CAST(event_id AS INTEGER) AS finding_pos, event_id % 6 AS m, json_extract_string(props, '$.k') AS k FROM events),
p AS (
  SELECT finding_pos, m,
         CASE m WHEN 0 THEN 'lifted' WHEN 1 THEN repeat('e', 250) WHEN 2 THEN 'k' || k WHEN 3 THEN 'None' END AS explanation,
         CASE m WHEN 0 THEN 'x = "' || k || '"' || chr(10) || 'return' || chr(9) || 'x' || chr(10)
                WHEN 1 THEN array_to_string(list_transform(range(25), lambda i: 'line ' || CAST(i AS VARCHAR)), chr(10))
                WHEN 2 THEN '' WHEN 3 THEN '' END AS fixed_code,
         CASE m WHEN 0 THEN ['h'] WHEN 1 THEN ['h1', 'h2', 'h3', 'h4'] WHEN 2 THEN ['only ' || k] WHEN 3 THEN [] END AS hardening,
         CASE m WHEN 0 THEN ['r'] WHEN 1 THEN ['r1', 'r2', 'r3', 'r4', 'r' || k] WHEN 2 THEN [] WHEN 3 THEN ['1.0', 'True'] END AS refs,
         CASE WHEN m = 4 THEN repeat('z', 1000) END AS raw_response,
         CASE m WHEN 4 THEN 'Could not parse LLM response as JSON' WHEN 5 THEN 'references is not a list' END AS error
  FROM m)
"""


def odd_inputs(q: dict[str, str]) -> None:
    q["mitigation_odd_parse"] = ODD_MITIGATION_CTE + r"""
SELECT finding_pos, CASE WHEN m = 5 THEN '{''why'': True}' ELSE explanation END AS explanation,
       CASE WHEN m = 5 THEN '' ELSE fixed_code END AS fixed_code,
       CASE WHEN m = 5 THEN '' ELSE array_to_string(hardening, ' | ') END AS hardening_text, array_to_string(refs, ', ') AS references_text,
       raw_response, error FROM p"""
    q["mitigation_odd_preview"] = ODD_MITIGATION_CTE + r"""
SELECT 'odd.py' AS file, 0 AS fn_ord, finding_pos, 'f' AS function, 'CWE-1' AS cwe_id, 'HIGH' AS severity, substring(explanation, 1, 200) AS why,
       array_to_string(list_slice(hardening, 1, 3), ' | ') AS hardening_preview,
       array_to_string(list_slice(string_split(fixed_code, chr(10)), 1, 20), chr(10)) AS code_preview,
       array_to_string(list_slice(refs, 1, 4), ', ') AS references_preview
FROM p WHERE error IS NULL"""
    q["function_odd_files"] = """
WITH f(fn_ord, name, lineno, end_lineno, args_text) AS (VALUES (0, 'g', 2, 6, 'b'), (1, 'm', 4, 5, 'self'))
SELECT 'o_' || CAST(p_partkey AS VARCHAR) || '.py' AS file, true AS parse_ok,
       CAST(CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 0 END AS INTEGER) AS n_functions,
       f.fn_ord, f.name, f.lineno, f.end_lineno, f.args_text
FROM part LEFT JOIN f ON p_partkey % 4 = 3"""


REPLY_TEXT_CTE = """
el AS (
  SELECT fn_id, finding_pos,
         CASE WHEN is_object THEN
           '{' || (CASE WHEN cwe_raw IS NULL THEN '' ELSE '"cwe_id": "' || cwe_raw || '", ' END)
           || '"cwe_name": "' || cwe_name || '", '
           || (CASE WHEN NOT severity_null THEN '"severity": "' || severity_raw || '", '
                    WHEN k % 2 = 0 THEN '"severity": null, ' ELSE '' END)
           || '"confidence": ' || conf_text || ', "line_hint": "' || line_hint
           || '", "description": "' || description || '", "evidence": "' || evidence
           || '", "solution": "' || solution || '", "references": ['
           || array_to_string(list_transform(refs, lambda r: '"' || r || '"'), ', ') || ']}'
         ELSE '"see above"' END AS elem
  FROM bf
),
arrs AS (
  SELECT fn_id, '[' || string_agg(elem, ', ' ORDER BY finding_pos) || ']' AS arr
  FROM el GROUP BY fn_id
)
"""


def replies_text(q: dict[str, str]) -> None:
    w = "WITH " + FINDINGS_CTE.strip() + "," + REPLY_TEXT_CTE.strip()
    q["reply_fence_strip"] = w + """
SELECT f.file, f.fn_ord,
       CASE WHEN f.fn_id % 11 = 10 THEN NULL
            WHEN f.fn_id % 5 IN (0, 1) THEN a.arr
            WHEN f.fn_id % 5 = 2 THEN 'Here are the findings:' || chr(10) || a.arr || chr(10)
                                      || 'Let me know if you need more.'
            WHEN f.fn_id % 5 = 3 THEN '{"findings": ' || a.arr || '}'
            ELSE trim(substring(a.arr, 1, length(a.arr) // 2)) END AS text
FROM fns f JOIN arrs a USING (fn_id)"""
