"""Python corpus -> function catalogue.

A file is parsed once, in the task that holds it (``mapInPandas``, stdlib
``ast``); Spark spreads the files over executors. Each file also yields one
status row (``fn_ord`` NULL) so that unparseable and empty files are visible
without a join back to the file list.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("fn_ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("end_lineno", T.IntegerType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("docstring", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_functions", T.IntegerType()),
    T.StructField("parse_error", T.StringType()),
])

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _defs_preorder(node):
    """Function definitions, outer before nested, in source field order (no
    recursion: expressions may nest deeper than Python's stack)."""
    waiting = [node]
    while waiting:
        child = waiting.pop()
        if isinstance(child, _DEFS):
            yield child
        waiting.extend(reversed(list(ast.iter_child_nodes(child))))


def _file_rows(file: str, content: str) -> list[dict]:
    try:
        tree = ast.parse(content, filename=file)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [dict(file=file, fn_ord=None, name=None, lineno=None, end_lineno=None, args=None,
                     docstring=None, source=None, n_functions=0,
                     parse_error=f"{type(e).__name__}: {e}")]
    # Line slicing on "\n" only, matching ast's own line numbers.
    lines = content.split("\n")
    ends = [ln + "\n" for ln in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    rows = []
    for i, node in enumerate(_defs_preorder(tree)):
        rows.append(dict(
            file=file, fn_ord=i, name=node.name, lineno=node.lineno, end_lineno=node.end_lineno,
            args=[a.arg for a in node.args.args],
            docstring=ast.get_docstring(node) or "",
            source="".join(ends[node.lineno - 1:node.end_lineno]),
            n_functions=None, parse_error=None))
    rows.append(dict(file=file, fn_ord=None, name=None, lineno=None, end_lineno=None, args=None,
                     docstring=None, source=None, n_functions=len(rows), parse_error=None))
    return rows


def _extract(batches):
    cols = CATALOG_SCHEMA.fieldNames()
    for pdf in batches:
        out = []
        for file, content in zip(pdf["file"], pdf["content"]):
            out.extend(_file_rows(file, content if content is not None else ""))
        yield pd.DataFrame(out, columns=cols).astype({"fn_ord": "Int32", "lineno": "Int32",
                                                     "end_lineno": "Int32", "n_functions": "Int32"})


def catalog(files: DataFrame) -> DataFrame:
    """C1-C4 in one pass: function rows plus one status row per file."""
    return files.select("file", "content").mapInPandas(_extract, CATALOG_SCHEMA)


def functions(cat: DataFrame) -> DataFrame:
    """C1 + C2: ``file, fn_ord, name, lineno, end_lineno, args, docstring,
    source`` in pre-order."""
    return cat.where(F.col("fn_ord").isNotNull()).drop("n_functions", "parse_error")


def file_status(cat: DataFrame) -> DataFrame:
    """C3 + C4: per file, parsed or not, and how many functions (an empty
    file is ok with 0)."""
    return cat.where(F.col("fn_ord").isNull()).select(
        "file", F.col("parse_error").isNull().alias("parse_ok"), "n_functions", "parse_error")


# The wording and the cuts of both query texts.
def scan_query_text(fns: DataFrame) -> DataFrame:
    """``Python function '<name>' vulnerability analysis. Arguments:
    a, b. <docstring[:200]> <source[:400]>`` (an empty docstring leaves two
    spaces)."""
    return fns.withColumn("query_text", F.concat(
        F.lit("Python function '"), F.col("name"), F.lit("' vulnerability analysis. "),
        F.lit("Arguments: "), F.array_join("args", ", "), F.lit(". "),
        F.substring(F.coalesce("docstring", F.lit("")), 1, 200), F.lit(" "),
        F.substring("source", 1, 400)))


def tool_query_text(fns: DataFrame) -> DataFrame:
    """R2: ``Python function '<name>' vulnerability. Args: a, b.
    <source[:400]>``."""
    return fns.withColumn("query_text", F.concat(
        F.lit("Python function '"), F.col("name"), F.lit("' vulnerability. "),
        F.lit("Args: "), F.array_join("args", ", "), F.lit(". "),
        F.substring("source", 1, 400)))
