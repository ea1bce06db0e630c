"""License scan with ordered signature rules, native expressions only.

One narrow pass normalises every text to lower-case words, counts the base
phrases and, where a rule's keyword stands, keeps the following words as a
window (keyword prefilter). The windows (not the texts) meet the rules of
their keyword in an equi-join with the fixed rule table; a rule's second
keyword is tested before its regex runs. A detection is an interval of
words. Detections that lie inside another one of the same or better priority
are suppressed by running maxima of interval ends, one per priority, so a
document's detections are sorted, never paired.

Null and empty texts give no words and no labels; repeated rows stay apart;
an empty table gives an empty result; extra columns are ignored; whole texts
are scanned, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stash
from .license_rules import CONFIDENCE, rules

#: Words behind a keyword that a rule may look at.
REACH = 32
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = 0.75
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """``" w1 w2 ... wn "``, or one space if there is no word.

    ``lower`` folds letters beyond A-Z too. That moves no word boundary (a
    folded letter is a word character like the letter itself) and completes no
    base phrase (only the Kelvin sign folds to an ASCII letter, k, and no phrase holds one).
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(s: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of ``phrase``: how many, the first and the last word number (null: none)."""
    padded, n = f" {phrase} ", len(phrase.split())
    there = F.contains(s, F.lit(padded))
    wide = f" {phrase.replace(' ', '  ')} "  # every word with spaces of its own, so that neighbours share none
    double = F.replace(s, F.lit(" "), F.lit("  "))
    count = (F.length(double) - F.length(F.replace(double, F.lit(wide), F.lit("")))) / len(wide)
    first = spaces(F.substring(s, F.lit(1), F.instr(s, padded))) - 1
    last = spaces(s) - 1 - spaces(F.substring_index(s, padded, -1)) - n
    return F.when(there, count.cast("long")).otherwise(0), F.when(there, first), F.when(there, last)


def keyword_gate(keywords: list[str]) -> str:
    """Pattern of a keyword between spaces, grouped by first letter: one
    character decides most words."""
    groups = [f"{a}(?:{'|'.join(k[1:] for k in keywords if k[0] == a)})" for a in sorted({k[0] for k in keywords})]
    return f" (?:{'|'.join(groups)}) "


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base columns and ``hits``, the windows behind keywords
    (null where the prefilter finds none)."""
    keywords = sorted({r.keyword for r in rules()})
    s = F.col("s")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col).cast("string")).alias("s"))
    gate = s.rlike(keyword_gate(keywords))
    words = F.split(F.trim(s), " ")
    marked = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("keyword"), i.alias("start"))),
                      lambda x: x.keyword.isin(*keywords))
    hits = F.transform(marked, lambda x: F.struct(
        x.keyword.alias("keyword"), x.start.cast("long").alias("start"),
        F.concat(F.array_join(F.slice(words, x.start + 1, F.lit(REACH)), " "), F.lit(" ")).alias("window")))
    base = {label: _base(s, phrase) for phrase, label in BASE.items()}
    counts, firsts, lasts = zip(*base.values())
    return rows.select(
        "id", F.greatest(spaces(s) - 1, F.lit(0)).cast("long").alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for label, (c, _, _) in sorted(base.items())])).alias("base"),
        F.when(gate, hits).alias("hits"))


def detections(scan: DataFrame) -> DataFrame:
    """``row, start, stop, priority, label`` of every kept detection of a
    table with ``row`` and ``hits``."""
    spark = scan.sparkSession
    table = F.broadcast(spark.createDataFrame(rules(), "rule int, priority int, label string, keyword string, "
                                              "must string, regex string, confidence double"))  # fixed size
    hits = scan.where("hits is not null").select("row", F.explode("hits").alias("h")).select("row", "h.*")
    found = (hits.join(table, "keyword")
             .where("contains(concat(' ', window), concat(' ', must, ' '))")
             .withColumn("stop", F.col("start") + F.expr("length(regexp_extract(window, regex, 0)) - "
                                                         "length(replace(regexp_extract(window, regex, 0), ' ', ''))"))
             .where("stop > start").select("row", "start", "stop", "priority", "rule", "label"))
    before = (Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "rule")
              .rowsBetween(Window.unboundedPreceding, -1))
    around = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(
        F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(before), F.lit(-1))) for p in sorted(CONFIDENCE)])
    return found.withColumn("around", around).where("around < stop").drop("around", "rule")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_words, n_base, first_word,
    last_word, base_labels, labels, score``. ``score`` is the confidence of the
    strongest detection or base phrase, 0 without any."""
    prepare(docs.sparkSession)
    scan = stash(scanned(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "licenses")
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    kept = detections(scan).withColumn("sure", sure[F.col("priority")]).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("sure").alias("sure"))
    none = F.array().cast("array<string>")
    return scan.drop("hits").join(kept, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none)))), ",").alias("labels"),
        F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"))
