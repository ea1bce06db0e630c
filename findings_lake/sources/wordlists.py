"""Wordlist map source (S7): CWE id -> ordered wordlist paths.

The map file is a JSON object whose values are lists of paths, plus a
``_default`` list and a ``_comment`` string that must be skipped (a typed
``from_json`` as ``map<string,array<string>>`` would give NULL for the whole
object because of it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_KEY = "_default"

# The CWE -> wordlist map shipped with the reference, in file
# order (paths relative to the wordlist root).
DEFAULT_WORDLIST_MAP = {
    "CWE-89": [
        "Fuzzing/Databases/SQLi/MySQL-SQLi-Login-Bypass.fuzzdb.txt",
        "Fuzzing/Databases/SQLi/Generic-SQLi.txt",
    ],
    "CWE-79": [
        "Fuzzing/XSS/human-friendly/XSS-Jhaddix.txt",
        "Fuzzing/XSS/robot-friendly/XSS-Jhaddix.txt",
        "Fuzzing/XSS/human-friendly/XSS-BruteLogic.txt",
        "Fuzzing/XSS/robot-friendly/XSS-BruteLogic.txt",
    ],
    "CWE-78": ["Fuzzing/command-injection-commix.txt"],
    "CWE-22": [
        "Fuzzing/LFI/Linux/LFI-gracefulsecurity-linux.txt",
        "Fuzzing/LFI/LFI-LFISuite-pathtotest-huge.txt",
    ],
    "CWE-287": ["Fuzzing/Authentication/Authentication.txt"],
    "CWE-352": ["Fuzzing/CSRF/CSRF-token-wordlist.txt"],
    "CWE-434": ["Fuzzing/Extensions.fuzz.txt"],
    "CWE-502": ["Fuzzing/XSS/Polyglots/XSS-Polyglots.txt"],
    "CWE-918": ["Fuzzing/SSRF/SSRF-targets.txt"],
    "CWE-20": [
        "Fuzzing/XSS/Polyglots/XSS-Polyglots.txt",
        "Fuzzing/special-chars.txt",
    ],
    "_default": ["Discovery/Web-Content/common.txt"],
}


def map_from_text(text_df: DataFrame, col: str = "value") -> DataFrame:
    """Parse map JSON text rows into ``(cwe_id, wordlists)``.

    Only keys whose value is a JSON array are kept (``_comment`` is a
    string). Lists keep their order; keys are looked up, never ordered.
    """
    v = F.try_parse_json(F.col(col))
    return (text_df.select(F.explode(v.try_cast("map<string, variant>")).alias("cwe_id", "_w"))
            .where(F.schema_of_variant("_w").startswith("ARRAY"))
            .select("cwe_id", F.col("_w").try_cast("array<string>").alias("wordlists")))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Read a map file (whole text) into the map table."""
    return map_from_text(spark.read.text(path, wholetext=True))  # one row per file


def map_table(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """The map as a table from a Python dict (default: the shipped map)."""
    mapping = DEFAULT_WORDLIST_MAP if mapping is None else mapping
    rows = [(k, list(v)) for k, v in mapping.items() if isinstance(v, list)]
    return spark.createDataFrame(rows, "cwe_id string, wordlists array<string>")
