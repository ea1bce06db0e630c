"""Prompt datasets.

The prompt texts are fixed values: the model was prompted with exactly these
strings, so a prompt table is only useful if it reproduces them. A template
is kept as one Python format string and rendered into a Spark ``concat``
(``render``); the oracle renders the same template into SQL.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The scan system prompt.
SYSTEM_PROMPT = """\
You are a professional application security analyst specializing in Python code review.
You identify software vulnerabilities by mapping code patterns to the MITRE CWE taxonomy
and real-world CVE examples provided in the context.

For each vulnerability you find, you respond ONLY with a valid JSON array.
Each element must have exactly these fields:
  - "cwe_id":      string, e.g. "CWE-89"
  - "cwe_name":    string, short name of the weakness
  - "severity":    string, one of CRITICAL / HIGH / MEDIUM / LOW / INFO
  - "confidence":  number between 0.0 and 1.0
  - "line_hint":   string, rough location in the function e.g. "line 3" or "argument handling"
  - "description": string, explain what the vulnerability is and why this code is vulnerable
  - "evidence":    string, the specific code snippet or pattern that is vulnerable
  - "solution":    string, concrete fix with corrected code example if possible
  - "references":  array of strings, relevant CVE IDs from the context if any

If the function has NO vulnerabilities, return an empty array: []
Do not include any text outside the JSON array."""

# The mitigation system prompt (its typo is part of the text).
MITIGATION_SYSTEM_PROMPT = """\
You are am expert application security engineer specialising in Python secure code review.
You are given a vulnerability finding and the relevant CWE/CVE reference context.
Your task is to provide:
  1. A clear explanation of why the code is vulnerable
  2. A concrete, minimal code fix — show the corrected function in full
  3. Any additional hardening recommendations beyond the immediate fix
  4. The CWE and any relevant CVE IDs from the context

Respond ONLY with a valid JSON object with these fields:
  - "cwe_id":        string
  - "explanation":   string — why the code is vulnerable
  - "fixed_code":    string — the corrected function as a code string
  - "hardening":     array of strings — additional recommendations
  - "references":    array of strings — CVE IDs from context if relevant

Do not include any text outside the JSON object."""

# Chat framing tokens and the two prompt layouts. Fields in
# braces are filled per row; {system} is the matching system prompt.
SCAN_TEMPLATE = (
    "<|begin_of_text|>"
    "<|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>"
    "<|start_header_id|>user<|end_header_id|>\n\n"
    "Analyze the following Python function for security vulnerabilities.\n"
    "Use the CWE/CVE reference context below to ground your findings.\n\n"
    "--- FUNCTION: {name} (line {lineno}) ---\n"
    "```python\n{source}\n```\n\n"
    "--- CWE/CVE REFERENCE CONTEXT ---\n{context}\n\n"
    "Respond ONLY with a JSON array of findings (or [] if none)."
    "<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n"
)
MITIGATION_TEMPLATE = (
    "<|begin_of_text|>"
    "<|start_header_id|>system<|end_header_id|>\n\n"
    "{system}<|eot_id|>"
    "<|start_header_id|>user<|end_header_id|>\n\n"
    "Vulnerability finding:\n"
    "  CWE: {cwe_id} — {cwe_name}\n"
    "  Severity: {severity}\n"
    "  Description: {description}\n"
    "  Evidence: {evidence}\n\n"
    "Vulnerable function source:\n"
    "```python\n{fn_source}\n```\n\n"
    "CWE/CVE reference context:\n{context}\n\n"
    "Respond ONLY with a JSON object containing: "
    "explanation, fixed_code, hardening (array), references (array)."
    "<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n"
)


def template_parts(template: str, system: str) -> list[tuple[str, str]]:
    """[(kind, value)] with kind 'lit' or 'field', {system} inlined."""
    out: list[tuple[str, str]] = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            out.append(("lit", lit))
        if field == "system":
            out.append(("lit", system))
        elif field:
            out.append(("field", field))
    merged: list[tuple[str, str]] = []
    for kind, v in out:
        if merged and kind == "lit" and merged[-1][0] == "lit":
            merged[-1] = ("lit", merged[-1][1] + v)
        else:
            merged.append((kind, v))
    return merged


def render(template: str, system: str, fields: dict[str, Column]) -> Column:
    """The template as a Spark ``concat`` over field columns."""
    cols = [F.lit(v) if k == "lit" else fields[v].cast("string")
            for k, v in template_parts(template, system)]
    return F.concat(*cols)


def render_sql(template: str, system: str, fields: dict[str, str]) -> str:
    """The template as a SQL ``||`` chain (newlines as chr(10))."""
    def lit(v: str) -> str:
        pieces = v.split("\n")
        q = [("'" + p.replace("'", "''") + "'") for p in pieces]
        return " || chr(10) || ".join(q)
    parts = [lit(v) if k == "lit" else f"CAST({fields[v]} AS VARCHAR)"
             for k, v in template_parts(template, system)]
    return "(" + " || ".join(parts) + ")"


def scan_prompts(functions: DataFrame, contexts: DataFrame) -> DataFrame:
    """One prompt per function; ``contexts`` is ``(file, fn_ord,
    context)``. Request id = file and position (stable, unique)."""
    j = functions.join(contexts, ["file", "fn_ord"], "left")
    prompt = render(SCAN_TEMPLATE, SYSTEM_PROMPT, {
        "name": F.col("name"), "lineno": F.col("lineno"), "source": F.col("source"),
        "context": F.coalesce("context", F.lit(""))})
    return j.select("file", "fn_ord",
                    F.concat("file", F.lit("#"), F.col("fn_ord").cast("string")).alias("request_id"),
                    prompt.alias("prompt"))


def mitigation_prompts(candidates: DataFrame) -> DataFrame:
    """One prompt per candidate finding (``cwe_name``/``evidence``
    default to ``''``); needs ``fn_source`` and ``context`` columns."""
    prompt = render(MITIGATION_TEMPLATE, MITIGATION_SYSTEM_PROMPT, {
        "cwe_id": F.col("cwe_id"), "cwe_name": F.coalesce("cwe_name", F.lit("")),
        "severity": F.col("severity"), "description": F.col("description"),
        "evidence": F.coalesce("evidence", F.lit("")),
        "fn_source": F.coalesce("fn_source", F.lit("")),
        "context": F.coalesce("context", F.lit(""))})
    return candidates.withColumn("prompt", prompt)
