"""The corpus pipeline: quality classifier, SimHash near-dedup, suffix-array
dedup, mixing and packing, each on all that the stage before kept.

A stage is a function of ``(spark, docs, sf_dir)``; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``. Where a decision meets its document again, documents
are told apart by two hashes of id and text, so repeated ids stay apart; equal
rows are copies of one document. Extra columns pass through whatever their
names. Texts are shuffled, not written, between an operator and its document:
shuffle files go with their stage, tables in the shared folder stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findings_lake.llm.common import stash, table
from findings_lake.llm.mixing import mix
from findings_lake.llm.packing import pack
from findings_lake.llm.quality import quality
from findings_lake.llm.queries import tokenizer_file
from findings_lake.llm.simhash import simhash_groups
from findings_lake.llm.suffix_dedup import suffix_dedup


def _free(name: str, columns: list[str]) -> str:
    """``name``, or the first longer form of it that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def _named(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two hashes of id and text, 128 bits that tell documents
    apart, under names that are free. Equal rows share them."""
    names = [_free(f"name{k}", docs.columns) for k in range(2)]
    return docs.withColumns({n: F.xxhash64(F.lit(k), "doc_id", "text") for k, n in enumerate(names)}), names


def _once(named: DataFrame, names: list[str]) -> DataFrame:
    """One row of each set of equal rows (those of one name)."""
    same, copy = Window.partitionBy(*names).orderBy(*names), _free("copy", named.columns)
    return named.withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1).drop(copy)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go."""
    scored = quality(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.where("kept").select("document.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest id (null last)."""
    named, names = _named(docs)
    groups = simhash_groups(named, keep=tuple(names))
    first = groups.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *names)).alias("least")).select("least.*").select(*names)
    return _once(named.join(first, names, "left_semi"), names).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat elsewhere (a character that is cut
    through goes whole); every document stays, a null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    null = _free("null", docs.columns)
    whole = docs.select(F.struct(*others, F.col("text").isNull().alias(null)).alias("id"), "text")
    cut = suffix_dedup(whole, id_col="id", with_text=True)

    @F.pandas_udf("string")
    def decoded(data):
        return data.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    cut = cut.select("id", F.when(~F.col("id")[null], decoded("kept")).alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return cut.select(*[F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("id")[c].alias(c)
                        for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes once for each pass that takes it, cut behind
    the words that the pass takes; documents that the mix leaves out go."""
    named, names = _named(docs)
    documents, pieces = mix(named, keep=tuple(names))
    words, size = _free("words", docs.columns), _free("size", docs.columns)
    passes = pieces.groupBy("row", "epoch").agg(F.sum("length").alias("w"))
    passes = passes.join(documents.select("row", F.col("size").alias("s"), *names), "row").select(
        *names, F.col("w").alias(words), F.col("s").alias(size))

    @F.pandas_udf("string")
    def first_words(texts, counts):
        def cut(text, n):
            import re

            data, end = text.encode(), 0
            for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0d]+", data)):
                if k == n:
                    break
                end = m.end()
            return data[:end].decode()

        return texts.combine(counts, cut)

    joined = _once(named, names).join(passes, names)  # every pass of a set of equal rows takes one copy
    text = F.when(F.col(words) < F.col(size), first_words("text", words)).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed models, BPE and graph-like stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
