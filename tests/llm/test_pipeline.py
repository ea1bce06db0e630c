import random

from pyspark.sql import functions as F

import corpus_pipeline as C


def test_stages_catch_planted_cases(spark, tmp_path):
    """Copies, passages that repeat and foul documents go; clean ones stay; extra columns pass through."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrs") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = " ".join(prose(70))
    texts, kinds = [], []
    for k in range(600):
        own = prose(rng.randint(60, 160))
        kind = "clean"
        if k % 8 == 0:
            kind = "foul"
            for _ in range(6):
                own[rng.randrange(len(own))] = rng.choice(["zqfoul", "zqvile", "zqnasty"])
        texts.append(" ".join(own))
        kinds.append(kind)
    for k in range(20):
        texts[8 * k + 3] += " " + passage
    base = len(texts)
    texts += [texts[1]] * 3 + [texts[2].upper()] + [None, "", "tiny"]
    rows = [(k, t, "en", f"s{k % 4}", len(t or ""), "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, key long")
    labels = [(k, 1, int(kinds[k] == "foul")) for k in range(0, 600) if k % 2 == 0 or k % 5 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = {}
    for name, f in C.STAGES:
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert new.columns == docs.columns
        stage[name], docs = new, new
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in stage.items()}
    clean = [k for k in range(base) if kinds[k] == "clean"]
    assert sum(k in set(ids["quality"]) for k in clean) > 0.95 * len(clean)
    assert sum(kinds[k] == "foul" for k in ids["quality"] if k < base) <= 2
    kept = set(ids["simhash"])
    assert len(ids["simhash"]) == len(kept) and not kept & set(range(base, base + 4))
    assert kept >= set(ids["quality"]) - set(range(base, len(texts)))
    assert sorted(ids["suffix"]) == sorted(ids["simhash"])
    cut = {r.doc_id: r for r in stage["suffix"].collect()}
    assert all(passage not in (r.text or "") for r in cut.values())
    for r in cut.values():
        assert r.n_chars == len(r.text or "") and r.row == "x"
        if r.doc_id < base and passage not in texts[r.doc_id]:
            assert r.text == texts[r.doc_id]
    mixed = stage["mixing"].collect()
    assert all((cut[r.doc_id].text or "").startswith(r.text) for r in mixed)
    assert max(ids["mixing"].count(k) for k in set(ids["mixing"])) == 2
    packed = stage["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert packed and max(r.n for r in packed) <= 2048


def test_repeated_rows_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "same text here", "en", "a", 14)] * 3 + [(None, "same text here", None, None, None), (2, None, None, None, None)]
    for name, data in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for _, f in C.STAGES:
            docs = f(spark, docs, str(tmp_path))
        out = docs.collect()
        assert bool(out) == (name == "rows")


def test_extra_columns_of_any_name(spark, tmp_path):
    """Names that the stages use themselves come through with their values."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(40)) for _ in range(12)] + [None, ""]
    names = ["null", "_null", "copy", "_copy", "words", "_words", "size", "_size", "s", "w", "name0", "_name0", "name1", "row", "epoch", "kept",
             "document", "Copy2", "least", "group", "length"]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or ""), *[f"{n} {k}" for n in names]) for k, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, f in C.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        rows = docs.collect()
        assert rows and docs.columns[5:] == names, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
