"""Mitigation stage.

Per finding at or above a severity: back-fill the function source, retrieve
context for a mitigation query, build a prompt, pair it with the model's
reply and parse that reply into a mitigation row.

Joins are on bounded keys: candidates x function sources on ``(file,
name)``; contexts on the query text, which is deduplicated before retrieval
(equal findings ask the knowledge base once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from . import retrieve as R
from .replies import one_reply
from .skew import salted_join

# Placeholder used while lifting fixed_code, and the error
# text of an unparseable reply.
FIXED_CODE_PLACEHOLDER = "__FIXED_CODE__"
PARSE_ERROR = "Could not parse LLM response as JSON"
RAW_RESPONSE_CHARS = 1000
# Fixed value: the lazy fixed_code lift (first match, dot matches newline).
FIXED_CODE_LIFT = ("(?s)^(.*?\"fixed_code\"" + text.PY_WS + "*:" + text.PY_WS + "*\")(.*?)(\"(?="
                   + text.PY_WS + "*," + text.PY_WS + "*\"|" + text.PY_WS + "*\\}).*)$")


def candidates(findings: DataFrame, min_severity: str = sev.DEFAULT_MITIGATION_SEVERITY,
               apply_floor: bool = True) -> DataFrame:
    """V4 (+ V5): report findings with rank >= rank(threshold). With
    ``apply_floor`` the threshold is first floored to MEDIUM (HIGH and
    CRITICAL pass), as the orchestrating client does."""
    level = sev.mitigation_floor(min_severity) if apply_floor else min_severity
    out = findings.where(sev.at_least("severity", level)).withColumn(
        "min_severity_filter", F.lit(level))
    return out.drop("request_id")  # a scan reply id is not a mitigation request id


UNAVAILABLE_SOURCE = "# source unavailable for "


def attach_source(cands: DataFrame, functions: DataFrame,
                  file_status: DataFrame | None = None) -> DataFrame:
    """M1: source of the first function (pre-order) with the finding's
    function name in the same file; ``name_ambiguous`` marks names that
    occur more than once (the reference silently takes the first). A finding
    that brings its own non-empty ``source`` keeps it. With a
    ``file_status`` table (``file, parse_ok``), a target that no longer
    parses gets the ``# source unavailable for <name>`` comment."""
    # The least position by fixed-width buffers; the text follows in one join on the
    # same keys (nothing lies below the least position, so "<=" picks exactly it).
    named = functions.select("file", F.col("name").alias("function"), "fn_ord", F.col("source").alias("fn_source"))
    first = named.groupBy("file", "function").agg(F.min("fn_ord").alias("_first"), (F.count(F.lit(1)) > 1).alias("name_ambiguous"))
    texts = named.withColumnsRenamed({"file": "_file", "function": "_function", "fn_ord": "_ord"})
    by_name = first.join(texts, (F.col("file") == F.col("_file")) & (F.col("function") == F.col("_function"))
                         & (F.col("_ord") <= F.col("_first"))).drop("_file", "_function", "_ord", "_first")
    out = cands.join(by_name, ["file", "function"], "left")
    if "source" in cands.columns:
        out = out.withColumn("fn_source", F.coalesce(F.when(F.col("source") != "", F.col("source")), "fn_source"))
    missing = F.lit("")
    if file_status is not None:
        out = out.join(file_status.select("file", F.col("parse_ok").alias("_ok")), "file", "left")
        missing = F.when(F.col("_ok") == F.lit(False),
                         F.concat(F.lit(UNAVAILABLE_SOURCE), F.col("function"))).otherwise(missing)
        out = out.withColumn("fn_source", F.coalesce("fn_source", missing)).drop("_ok")
    return (out.withColumn("fn_source", F.coalesce("fn_source", F.lit("")))
            .withColumn("name_ambiguous", F.coalesce("name_ambiguous", F.lit(False))))


# Fixed value: the wording of the query text.
def query_text(cands: DataFrame) -> DataFrame:
    """``<cwe_id> <cwe_name> mitigation fix secure code. <evidence>``."""
    return cands.withColumn("query_text", F.concat(
        F.col("cwe_id"), F.lit(" "), F.coalesce("cwe_name", F.lit("")),
        F.lit(" mitigation fix secure code. "), F.coalesce("evidence", F.lit(""))))


def content_id(c) -> "F.Column":
    """128 bits of a text's content as 32 hex digits: the key that stands for
    a text in joins and groups."""
    half = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    return F.concat(half(F.col(c)), half(F.lit("second half"), F.col(c)))


def contexts(query_texts: DataFrame, query_vectors: DataFrame, kb: DataFrame,
             top_k: int = R.DEFAULT_TOP_K) -> DataFrame:
    """``query_id, context`` per distinct query text (``query_id`` is its
    ``content_id``; texts themselves are neither grouped nor joined). The
    retrieval severity floor is always the default LOW (not the mitigation
    threshold)."""
    asked = query_texts.select(content_id("query_text").alias("query_id")).distinct()
    vectors = query_vectors.select(content_id("query_text").alias("query_id"), "embedding")
    qs = asked.join(vectors, "query_id")
    return R.retrieve_context(R.normalise_vectors(qs), kb, top_k=top_k,
                              min_severity=sev.DEFAULT_MIN_SEVERITY)


def with_contexts(cands: DataFrame, ctx: DataFrame) -> DataFrame:
    """Candidates with the ``context`` of their query text (null if none), by
    content id; a text that many findings share is spread over several copies
    of its dictionary row."""
    keyed = cands.withColumn("query_id", content_id("query_text"))
    return salted_join(keyed, ctx, "query_id", ["file", "fn_ord", "finding_pos"]).drop("query_id")


def request_id() -> "F.Column":
    return F.concat_ws("#", F.col("file"), F.col("fn_ord").cast("string"),
                       F.col("finding_pos").cast("string"))


def repair(replies: DataFrame) -> DataFrame:
    """J10 + J11: un-fence, then turn triple-quoted blocks into JSON
    strings (``repaired``)."""
    return replies.withColumn("repaired", text.repair_triple_quotes(text.strip_fences("raw")))


def parse(repaired: DataFrame) -> DataFrame:
    """The reply object's fields, or an error row.

    Valid JSON is read as is; only when the repaired text is still invalid
    is ``fixed_code`` lifted out by the lazy pattern (with the reference's
    three unescapes) and the rest parsed with a placeholder.
    """
    whole = F.col("repaired")
    pre, code, post = (F.regexp_extract(whole, FIXED_CODE_LIFT, i) for i in (1, 2, 3))
    # The rest's object only where the pattern matches (``pre`` is never empty then).
    rest = text.let(F.struct(pre.alias("pre"), code.alias("c"), post.alias("post")), lambda m: F.when(
        F.length(m["pre"]) > 0, F.struct(
            text.parse_json_object(F.concat(m["pre"], F.lit(FIXED_CODE_PLACEHOLDER), m["post"])).alias("o"), m["c"].alias("c"))))
    opened = text.let(text.parse_json_object(whole), lambda o: F.when(o.isNotNull(), F.struct(
        o.alias("o"), F.lit(None).cast("string").alias("c"))).when(whole.contains('"fixed_code"'), rest))

    def field_str(obj, name, default):
        return text.py_str(F.variant_get(obj, f"$.{name}", "variant"), default)

    def field_list(obj, name):
        """A list's texts; a text alone is a list of one; other values are NULL (an error row)."""
        return text.let(F.variant_get(obj, f"$.{name}", "variant"), lambda v: (
            F.when(v.isNull(), F.array().cast("array<string>"))
            .when(text.json_kind(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
            .otherwise(F.transform(v.try_cast("array<variant>"), lambda x: text.py_str(x, None)))))

    lists = ("hardening", "references")
    failed_call = F.col("raw").isNull() | F.col("call_error").isNotNull()
    # The parse ends in a generated column: a filter on ``error`` stays above it. It would
    # otherwise be pushed below the parse and hold copies of it, one for each use.
    read = text.let(F.when(~failed_call, opened), lambda x: F.struct(
        x["o"].alias("o"), x["c"].alias("c"), *[F.when(x["o"].isNotNull(), field_list(x["o"], name)).alias(name) for name in lists]))
    df = repaired.select("*", F.explode_outer(F.array(read)).alias("_p"))
    obj = F.col("_p.o")
    # The three unescapes and their order.
    lifted = F.replace(F.replace(F.replace(F.col("_p.c"), F.lit("\\n"), F.lit("\n")),
                                 F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    ok = obj.isNotNull()
    fixed = F.when(F.col("_p.c").isNull(), field_str(obj, "fixed_code", "")).otherwise(lifted)
    unlisted = [F.when(ok & F.col(f"_p.{name}").isNull(), F.lit(f"{name} is not a list")) for name in lists]
    return df.select(
        *[c for c in repaired.columns if c not in ("repaired",)],
        F.when(ok, field_str(obj, "explanation", "")).alias("explanation"),
        F.when(ok, fixed).alias("fixed_code"),
        *[F.col(f"_p.{name}").alias(name) for name in lists],
        F.when(~ok & ~failed_call, F.substring("raw", 1, RAW_RESPONSE_CHARS)).alias("raw_response"),
        F.when(failed_call, F.coalesce(F.col("call_error"), F.lit("no reply")))
        .when(~ok, F.lit(PARSE_ERROR)).otherwise(F.coalesce(*unlisted)).alias("error"))


def mitigation_rows(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """P3 for mitigations: the requested findings (candidates or their
    prompts, with ``request_id``) left-join the replies, then repair and
    parse. The prompt text itself is not needed to read a reply back."""
    keep = [c for c in ("file", "fn_ord", "finding_pos", "function", "cwe_id", "severity",
                        "min_severity_filter") if c in requests.columns]
    requests = requests.withColumn("request_id", request_id())  # one request per finding
    keep.append("request_id")
    r = one_reply(replies).select("request_id", "raw", F.col("error").alias("call_error"))
    return parse(repair(requests.select(*keep).join(r, "request_id", "left")))


def report(rows: DataFrame) -> DataFrame:
    """M2: per target file, number of mitigations, errors, threshold."""
    return rows.groupBy("file", "min_severity_filter").agg(
        F.lit("ok").alias("status"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def preview(rows: DataFrame) -> DataFrame:
    """M3: explanation (200 chars), 3 hardening tips, 20 code lines,
    4 references."""
    return rows.where(F.col("error").isNull()).select(
        "file", "fn_ord", "finding_pos", "function", "cwe_id", "severity",
        F.substring("explanation", 1, 200).alias("why"),
        F.array_join(F.slice("hardening", 1, 3), " | ").alias("hardening_preview"),
        F.array_join(text.first_lines("fixed_code", 20), "\n").alias("code_preview"),
        F.array_join(F.slice("references", 1, 4), ", ").alias("references_preview"))


def combined(analysis: DataFrame, mitig: DataFrame) -> DataFrame:
    """M4: one row per target: analysis part, fuzzing part (never filled:
    the fuzz stage runs outside), mitigation part."""
    m = mitig.select("file", "total", "n_errors")
    return (analysis.join(m, "file", "left")
            .select(F.col("file").alias("target"),
                    F.col("status").alias("analysis_status"),
                    "functions_scanned", "total_findings",
                    F.lit(None).cast("string").alias("fuzzing"),
                    F.coalesce("total", F.lit(0)).cast("long").alias("mitigations_total"),
                    F.coalesce("n_errors", F.lit(0)).cast("long").alias("mitigation_errors")))
