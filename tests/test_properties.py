"""Property tests (hypothesis): a generated list in a wrapper must come back
as it was put in, or not at all where the wrapper breaks it."""
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from test_replies import spark_elements

texts = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="`"), max_size=8)
scalars = st.one_of(st.none(), st.booleans(), st.integers(-10**6, 10**6),
                    st.floats(allow_nan=False, allow_infinity=False, width=32), texts)
values = st.lists(st.recursive(scalars, lambda inner: st.one_of(
    st.lists(inner, max_size=3), st.dictionaries(texts, inner, max_size=3)), max_leaves=8), max_size=4)
#: wrapper around a list's text, and what a reader gets of the list
WRAPPERS = [
    ("{}", lambda v: v), ("```json\n{}\n```", lambda v: v), ("```\n{}```", lambda v: v),
    ("Result:\n{}\nEnd", lambda v: v), ('{{"findings": {}}}', lambda v: v), ("  {}  ", lambda v: v),
    ("{} trailing", lambda v: v), ("\u3000{}\u3000", lambda v: v), ("[{}]", lambda v: [v]), ("{0}, {0}", lambda v: []),
]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(values, st.sampled_from(WRAPPERS), st.booleans()), min_size=50, max_size=80))
def test_generated_lists_come_back(spark, cases):
    raws = [wrapper.format(json.dumps(v, indent=2 if indent else None, ensure_ascii=False))
            for v, (wrapper, _), indent in cases]
    got = spark_elements(spark, raws)
    for i, (v, (_, want), _) in enumerate(cases):
        assert got[i] == want(v), raws[i]
