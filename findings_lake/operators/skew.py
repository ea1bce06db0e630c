"""Joins with a dictionary whose hot keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in ``SHARE`` rows; there are fewer
#: than ``SHARE`` of them whatever the data, so their list may be broadcast.
SHARE = 64


def salted_join(rows: DataFrame, dictionary: DataFrame, key: str, row_key: list[str],
                share: int = SHARE) -> DataFrame:
    """``rows`` left-joined with ``dictionary`` (one row per ``key``).

    Keys are counted first (combined before the shuffle). A hot key gets as
    many copies of its dictionary row as it holds ``1/share`` of all rows, and
    its rows are dealt to the copies by the hash of ``row_key``; every other
    key keeps its single row.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    hot = counts.where((F.col("_n") * share > total) & F.col(key).isNotNull()).select(
        key, F.ceil(F.col("_n") * share / total).cast("int").alias("_copies"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*row_key), F.col("_copies")).cast("int")))
    copies = dictionary.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
    return salted.drop("_copies").join(copies.drop("_copies"), [key, "_salt"], "left").drop("_salt")
