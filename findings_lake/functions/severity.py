"""Severity algebra (V1-V6) as Catalyst expressions.

All functions return ``Column`` expressions so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the ordered severity scale and
# its ranks (highest first), and the confidence band thresholds.
SEVERITY_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
CONFIDENCE_HIGH = 0.8
CONFIDENCE_MEDIUM = 0.5
DEFAULT_MIN_SEVERITY = "LOW"
DEFAULT_MITIGATION_SEVERITY = "MEDIUM"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank(sev) -> Column:
    """V1: CRITICAL 4 ... INFO 0; unknown, null and wrong case -> 0."""
    sev = _col(sev)
    expr = F.lit(0)
    for name, r in SEVERITY_RANK.items():
        expr = F.when(sev == F.lit(name), F.lit(r)).otherwise(expr)
    return F.coalesce(expr, F.lit(0))


def level_of(rank_col) -> Column:
    """Inverse of ``rank`` for validated levels (rank -> level name)."""
    r = _col(rank_col)
    expr = F.lit(None).cast("string")
    for name, v in SEVERITY_RANK.items():
        expr = F.when(r == F.lit(v), F.lit(name)).otherwise(expr)
    return expr


def rank_of(level: str | None) -> int:
    """Driver-side rank of a parameter (unknown -> 0, as in the reference)."""
    return SEVERITY_RANK.get(level, 0)


def at_least(sev, min_severity: str) -> Column:
    """V2/V4: keep rank(sev) >= rank(min); an unknown minimum keeps all."""
    return rank(sev) >= F.lit(rank_of(min_severity))


def normalise(raw_text) -> Column:
    """Upper-case (no trim); anything outside the scale -> LOW."""
    up = F.upper(_col(raw_text))
    return F.when(up.isin(*SEVERITY_LEVELS), up).otherwise(F.lit("LOW"))


def mitigation_floor(min_severity: str) -> str:
    """V5: HIGH and CRITICAL pass through, anything else becomes MEDIUM."""
    return min_severity if min_severity in ("HIGH", "CRITICAL") else DEFAULT_MITIGATION_SEVERITY


def confidence_band(conf) -> Column:
    """V6: >=0.8 high, >=0.5 medium, else low."""
    c = _col(conf)
    return (F.when(c >= F.lit(CONFIDENCE_HIGH), F.lit("high"))
            .when(c >= F.lit(CONFIDENCE_MEDIUM), F.lit("medium"))
            .otherwise(F.lit("low")))


def percent_text(conf) -> Column:
    """``f"{conf*100:.0f}%"`` for two-decimal confidences (no .5 ties occur)."""
    return F.concat(F.format_string("%.0f", F.round(_col(conf) * 100, 0)), F.lit("%"))


def severity_map_text(counts: dict[str, Column]) -> Column:
    """``2×HIGH, 1×LOW`` in rank order from per-level count columns."""
    parts = [F.when(counts[s] > 0, F.concat(counts[s].cast("string"), F.lit("×" + s)))
             for s in SEVERITY_LEVELS]
    return F.concat_ws(", ", *parts)
