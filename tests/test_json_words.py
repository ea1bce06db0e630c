"""One-parse JSON guard, number words, and Python's text of nested values."""
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import replies_df
from findings_lake.functions import text
from findings_lake.operators import replies as J


@pytest.mark.parametrize("t,ok", [
    ("[1]", True), (" [1] \n", True), ("[]", True), ("[1],[2]", False), ("[1]], [[2]", False), ("[1] x", False), ('[1],"x":[2]', False),
    ("1", False), ('"[1]"', False), ("{}", False), ("null", False), ("", False), ("[1]]", False), ("[", False), ('[1],"0"], [2', False)])
def test_one_json_list(spark, t, ok):
    df = spark.createDataFrame([(t,)], "t string")
    assert (df.select(text.parse_json_array("t").isNotNull()).first()[0]) is ok


def test_one_json_object(spark):
    cases = {"{}": True, '{"a": 1} ': True, '{"a": 1} {': False, '{"a":1},"b":{}': False, "[{}]": False, "null": False, '{"a":1}}': False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", text.parse_json_object("t").isNotNull()).collect()}
    assert got == cases
    got = {r[0]: r[1] for r in df.select("t", text.one_typed_object(F.col("t"), "a:int").isNotNull()).collect()}
    assert got == cases


def value(rng, depth=0):
    kinds = ["text", "int", "float", "bool", "none", "word"] + (["list", "dict"] * 2 if depth < 3 else [])
    kind = rng.choice(kinds)
    letters = "ab'\"\\/é\n\t\r\x7f​\U0001f600 NaN,:{}[]x\x01­"
    return {"text": lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))),
            "int": lambda: rng.choice([0, -7, 12345678901234567890, 42]), "float": lambda: rng.choice([0.5, -2.0, 1e-7, 1.5e22, 123456789.25]),
            "bool": lambda: rng.random() < 0.5, "none": lambda: None, "word": lambda: rng.choice([math.nan, math.inf, -math.inf]),
            "list": lambda: [value(rng, depth + 1) for _ in range(rng.randint(0, 3))],
            "dict": lambda: {rng.choice("zyxab'\"") + str(k): value(rng, depth + 1) for k in range(rng.randint(0, 3))}}[kind]()


def test_nested_values_read_as_pythons_own_text(spark):
    rng = random.Random(11)
    values = [value(rng) for _ in range(300)]
    raws = [json.dumps([{"evidence": v, "references": [v, "x"]}], ensure_ascii=rng.random() < 0.5) for v in values]
    wrapped = [rng.choice(["{}", "```json\n{}\n```", "See:\n{}\nok"]).replace("{}", r, 1) for r in raws]
    got = {r.fn_ord: r for r in J.findings_from_replies(replies_df(spark, wrapped)).collect()}
    for k, raw in enumerate(raws):
        want = json.loads(raw)[0]["evidence"]  # as Python's reader gives it back
        assert got[k].evidence == str(want), raw
        assert got[k].references == [str(want), "x"], raw


@pytest.mark.parametrize("written,want", [
    ("NaN", 1.0), ("Infinity", 1.0), ("-Infinity", 0.0), ('"NaN"', 1.0), ('"-inf"', 0.0), ('" Infinity "', 1.0), ('"nano"', None),
    ("-NaN", "unread"), ("NaNs", "unread"), ('"1_0x"', None), ("[NaN]", None), ("1e400", 1.0)])
def test_confidence_words(spark, written, want):
    got = J.findings_from_replies(replies_df(spark, ['[{"confidence": %s, "evidence": "NaN, Infinity"}]' % written]), keep_quarantine=True).collect()
    if want == "unread":
        assert got == []
    else:
        assert [(r.confidence, r.evidence) for r in got] == [(want, "NaN, Infinity")]
        assert (got[0].quarantine_reason is None) == (want is not None)
