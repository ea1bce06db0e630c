"""Model replies -> validated findings.

Input ``replies``: ``request_id, file, fn_ord, raw, error`` (one row per
model call). Parsing, exploding and validating are narrow (per reply row):
they never shuffle, so this stage scales with the number of replies and
keeps each reply's elements together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounding, severity, text

# Field defaults of a validated finding.
DEFAULT_CWE_ID = "CWE-Unknown"
DEFAULT_CONFIDENCE = 0.5
TEXT_FIELDS = ["cwe_name", "line_hint", "description", "evidence", "solution"]



def strip_reply(replies: DataFrame) -> DataFrame:
    """``text`` = reply with surrounding whitespace and fences removed."""
    return replies.withColumn("text", text.strip_fences("raw"))


def parse_reply_arrays(replies: DataFrame) -> DataFrame:
    """Add ``elements array<variant>``, ``parse_status`` and
    ``array_text``, the text that was read.

    direct   - the whole text is one JSON list
    fallback - the greedy ``[...]`` span is one JSON list
    none     - nothing parseable (elements = [], no error, as in the reference)
    no_reply - the model call failed (``error`` set)
    """
    df = strip_reply(replies).withColumn("_t", text.number_words(F.col("text")))
    df = df.withColumn("_direct", text.parse_json_array("_t"))
    df = df.withColumn("_t2", F.when(F.col("_direct").isNull(), text.number_words(text.fallback_array_text("text"))))
    df = df.withColumn("_fb", text.parse_json_array("_t2"))
    status = (F.when(F.col("raw").isNull() | F.col("error").isNotNull(), F.lit("no_reply"))
              .when(F.col("_direct").isNotNull(), F.lit("direct"))
              .when(F.col("_fb").isNotNull(), F.lit("fallback"))
              .otherwise(F.lit("none")))
    elements = F.coalesce(F.col("_direct"), F.col("_fb"),
                          F.array().cast("array<variant>"))
    return (df.withColumn("parse_status", status)
            .withColumn("elements", F.when(F.col("parse_status") == "no_reply",
                                           F.array().cast("array<variant>")).otherwise(elements))
            .withColumn("array_text", F.coalesce("_t2", "_t"))
            .drop("_t", "_t2", "_direct", "_fb"))


def object_elements(parsed: DataFrame) -> DataFrame:
    """One row per element that is a JSON object; ``finding_pos`` is the
    element's position in the reply (stable sort key)."""
    keep = [c for c in parsed.columns if c not in ("elements", "raw", "text", "array_text")]
    # The outer form keeps Spark from inferring a ``size(elements) > 0``
    # filter, which would be pushed below the projection and evaluate the
    # whole parse twice; empty replies drop out on the kind test below.
    return (parsed.select(*keep, F.posexplode_outer("elements").alias("finding_pos", "e"))
            .where(text.is_object(F.col("e")))
            .withColumn("finding_pos", F.col("finding_pos").cast("int")))


def checked_elements(elements: Column, array_text: Column) -> Column:
    """J5-J9 in the row: the objects of ``elements`` as normalised findings,
    an array in reply order (``finding_pos`` is the place in the reply).

    Findings the reference would crash on (``confidence`` not a number, JSON
    null, ``references`` null or not a list/string) get a
    ``quarantine_reason``. Every step of the chain names its values, so the
    next one reads fields instead of computing them again.
    """
    # Text fields in one list, so that one expression (small to plan) renders them all.
    texts = {"cwe_id": DEFAULT_CWE_ID, **dict.fromkeys(TEXT_FIELDS, ""), "severity": "LOW"}
    opened = F.filter(F.transform(elements, lambda e, i: F.struct(
        i.cast("string").alias("i"), e.try_cast("map<string,variant>").alias("m"))), lambda x: x["m"].isNotNull())
    picked = F.transform(opened, lambda x: F.struct(
        x["i"].alias("i"),
        F.array(*[F.struct(F.try_element_at(x["m"], F.lit(f)).alias("v"), F.lit(d).alias("d"), F.lit(f).alias("f")) for f, d in texts.items()]).alias("t"),
        F.try_element_at(x["m"], F.lit("confidence")).alias("c"), F.try_element_at(x["m"], F.lit("references")).alias("r")))

    def written(*path):
        """A nested value as the reply wrote it (keys in order); read only where a value is nested."""
        return F.call_function("get_json_object", array_text, F.concat(F.lit("$["), *path))

    def references(x):
        kind = text.json_kind(x["r"])
        listed = F.transform(x["r"].try_cast("array<variant>"), lambda r, j: text.py_str(
            r, None, written(x["i"], F.lit("].references["), j.cast("string"), F.lit("]"))))
        alone = F.try_variant_get(x["r"], "$", "string")
        return (F.when(x["r"].isNull(), F.array().cast("array<string>")).when(kind == "ARRAY", listed)
                .when(kind == "STRING", F.array(F.when(alone.startswith(text.WORD_MARK), text.special_text(alone)).otherwise(alone))))

    rendered = F.transform(picked, lambda x: F.struct(
        x["i"].alias("i"),
        F.transform(x["t"], lambda t: text.py_str(t["v"], t["d"], written(x["i"], F.lit("]."), t["f"]))).alias("t"),
        F.when(x["c"].isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(text.py_float(x["c"])).alias("c"),
        references(x).alias("references")))
    names = {f: k for k, f in enumerate(texts)}
    named = F.transform(rendered, lambda x: F.struct(
        x["i"].alias("i"), *[F.get(x["t"], names[f]).alias(f) for f in ("cwe_id", *TEXT_FIELDS)],
        F.get(x["t"], names["severity"]).alias("severity_text"), x["c"].alias("c"), x["references"].alias("references")))
    clamped = F.transform(named, lambda x: F.struct(
        x["i"].alias("i"), x["cwe_id"].alias("cwe_id"), *[x[f].alias(f) for f in TEXT_FIELDS], x["severity_text"].alias("severity_text"),
        x["c"].isNull().alias("bad"), F.when(x["c"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["c"]))).alias("c"), x["references"].alias("references")))
    return F.transform(clamped, lambda x: F.struct(
        x["i"].cast("int").alias("finding_pos"), x["cwe_id"].alias("cwe_id"), *[x[f].alias(f) for f in TEXT_FIELDS],
        x["severity_text"].alias("severity_text"), severity.normalise(x["severity_text"]).alias("severity"),
        rounding.round2(x["c"]).alias("confidence"), x["references"].alias("references"),
        F.when(x["bad"], F.lit("confidence is not a number"))
        .when(x["references"].isNull(), F.lit("references is not a list")).alias("quarantine_reason")))


def checked_replies(replies: DataFrame) -> DataFrame:
    """One row per reply with ``checked``, its findings in reply order
    (quarantined ones included): parsed, normalised and kept in the row."""
    parsed = parse_reply_arrays(replies)
    keep = [c for c in parsed.columns if c not in ("elements", "raw", "text", "array_text")]
    return parsed.select(*keep, checked_elements(F.col("elements"), F.col("array_text")).alias("checked"))


def findings_of(checked: DataFrame, keep_quarantine: bool = False) -> DataFrame:
    """``checked_replies`` rows -> findings, one row each (quarantined ones dropped unless asked)."""
    keep = [c for c in checked.columns if c != "checked"]
    # outer, as in ``object_elements``
    rows = checked.select(*keep, F.explode_outer("checked").alias("f")).where("f is not null").select(*keep, "f.*")
    return rows if keep_quarantine else rows.where(F.col("quarantine_reason").isNull())


def findings_from_replies(replies: DataFrame, keep_quarantine: bool = False) -> DataFrame:
    """replies -> validated findings, one row each."""
    return findings_of(checked_replies(replies), keep_quarantine)


def one_reply(replies: DataFrame) -> DataFrame:
    """One reply per request: of several, one without an error, then the one
    of the least content hash (a failed call has an error, whatever its text).

    Rows are ordered by a packed fixed-width key, never by their texts; the
    limit is applied before the shuffle by request, which the join with the
    requests uses again."""
    content = F.shiftrightunsigned(F.xxhash64("raw", "error"), 2)
    key = content + F.when(F.col("error").isNotNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    w = Window.partitionBy("request_id").orderBy("_key")
    return replies.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def pair_replies(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Every prompt gets its reply; a missing reply or a failed call is an
    error row (empty findings) and the scan goes on."""
    r = one_reply(replies).select("request_id", "raw", F.col("error").alias("_err"))
    j = prompts.join(r, "request_id", "left")
    return (j.withColumn("error", F.coalesce("_err", F.when(F.col("raw").isNull(), F.lit("no reply"))))
            .withColumn("status", F.when(F.col("error").isNull(), F.lit("ok"))
                        .otherwise(F.lit("error")))
            .drop("_err"))
