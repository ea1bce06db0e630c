"""Scalar functions: exact rounding, severity algebra, text helpers."""
import json
import random

from pyspark.sql import functions as F

from findings_lake.functions import rounding, severity as sev, text
from findings_lake.functions import text as text_fn


def test_round2_matches_python(spark):
    rng = random.Random(3)
    vals = [k / 10000 for k in range(0, 10001, 7)] + [rng.uniform(-2, 2) for _ in range(3000)]
    vals += [0.125, 0.285, 0.675, 0.015, 0.005, 0.375, 1.005, -0.125, 2.675]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(rounding.round2("x")).collect()]
    assert got == [round(v, 2) for v in vals]


def test_rank_and_floor(spark):
    df = spark.createDataFrame([("CRITICAL",), ("INFO",), ("high",), (None,)], "s string")
    assert [r[0] for r in df.select(sev.rank("s")).collect()] == [4, 0, 0, 0]
    assert [sev.mitigation_floor(x) for x in ["LOW", "INFO", "MEDIUM", "HIGH", "CRITICAL"]] == [
        "MEDIUM", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]


def test_confidence_band(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (0.5,), (0.49,)], "c double")
    got = [tuple(r) for r in df.select(sev.confidence_band("c"), sev.percent_text("c")).collect()]
    assert got == [("high", "80%"), ("medium", "79%"), ("medium", "50%"), ("low", "49%")]


def test_py_strip_unicode(spark):
    df = spark.createDataFrame([("　\x1c a b \n",)], "t string")
    assert df.select(text.py_strip("t")).first()[0] == "　\x1c a b \n".strip()


def test_path_stem(spark):
    names = ["Fuzzing/Databases/SQLi/MySQL-SQLi-Login-Bypass.fuzzdb.txt", ".bashrc", "a/b", "x.tar."]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    from pathlib import PurePosixPath
    assert [r[0] for r in df.select(text.path_stem("p")).collect()] == [
        PurePosixPath(n).stem for n in names]


def test_triple_quote_repair(spark):
    rows = ['{"fixed_code": """a "b"\nc""", "h": []}', '{"a": """open', 'x """1""" y """2""" z']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(text.repair_triple_quotes("t")).collect()]
    assert got[0] == '{"fixed_code": "a \\"b\\"\\nc", "h": []}'
    assert got[1] == rows[1]
    assert got[2] == 'x "1" y "2" z'
    assert df.select(F.lit(1)).count() == 3


def test_triple_quote_repair_of_built_texts(spark):
    """Blocks built from known bodies must become those bodies' JSON strings."""
    rng = random.Random(11)
    body_parts = ['"', "a", "b", "\n", "\\", "\t", "\r", " ", "x"]
    rows, want = [], []
    for _ in range(600):
        text = expected = rng.choice(["", "pre ", '{"k": '])
        for _ in range(rng.randint(0, 3)):
            body = "<" + "".join(rng.choice(body_parts) + "." for _ in range(rng.randint(0, 12))) + ">"
            between = rng.choice([", ", "\n", " y "])
            text += '"""' + body + '"""' + between
            expected += json.dumps(body) + between
        if rng.random() < 0.3:  # an opening mark without an end stays as it is
            text += '"""open'
            expected += '"""open'
        rows.append(text)
        want.append(expected)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: r.o for r in df.select("i", text_fn.repair_triple_quotes("t").alias("o")).collect()}
    for i, expected in enumerate(want):
        assert got[i] == expected, repr(rows[i])


def test_fixed_code_lift_of_built_objects(spark):
    """Code put between the key and the next member or the end must be lifted as it is."""
    from findings_lake.operators.mitigations import FIXED_CODE_LIFT
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        code = "".join(rng.choice(["x = 1", "\n", 'print("hi")', "'q'", ", y", "{", " ", "\\n", ";"]) for _ in range(rng.randint(0, 8)))
        head = rng.choice(["{", '{"a": 1, ']) + '"fixed_code"' + rng.choice([":", ": ", " : "]) + '"'
        rows.append((head, code, head + code + rng.choice(['", "h": []}', '"}', '"\n}', '" , "z": 2}'])))
    df = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: (r.pre, r.code) for r in df.select(
        "i", F.regexp_extract("t", FIXED_CODE_LIFT, 1).alias("pre"), F.regexp_extract("t", FIXED_CODE_LIFT, 2).alias("code")).collect()}
    for i, (head, code, text) in enumerate(rows):
        assert got[i] == (head, code), repr(text)
    none = spark.createDataFrame([('{"fixed": "x"}',), ('"fixed_code": x',), ("",)], "t string")
    assert [r[0] for r in none.select(F.regexp_extract("t", FIXED_CODE_LIFT, 2)).collect()] == ["", "", ""]
