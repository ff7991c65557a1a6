"""Strict JSON well-formedness (webhook decoder) against Python's parser
with non-finite constants rejected: a body is well formed iff it is exactly
one JSON value, surrounded only by whitespace."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetline.functions.exprs import parse_json_body

scalars = (st.none() | st.booleans() | st.integers(-10**15, 10**15)
           | st.floats(allow_nan=False, allow_infinity=False, width=32)
           | st.text(st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=8))
docs = st.recursive(scalars, lambda c: st.lists(c, max_size=3)
                    | st.dictionaries(st.text("abcsn_", max_size=4), c, max_size=3), max_leaves=8)
tails = st.sampled_from(["", " ", "\n", " x", "}", "]", ",1", " {}", "\"", "/", "{"])
cuts = st.integers(0, 3)


def python_ok(s: str) -> bool:
    def reject(_):
        raise ValueError
    try:
        json.loads(s, parse_constant=reject)
        return True
    except ValueError:
        return False


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(docs, tails, cuts), min_size=20, max_size=20))
def test_strict_parse_matches_python(spark, cases):
    bodies = []
    for doc, tail, cut in cases:
        s = json.dumps(doc, separators=(",", ":")) + tail
        bodies.append(s[:-cut] if cut and len(s) > cut else s)
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    ok, _ = parse_json_body("b", strict_tail=True)
    got = [r[0] for r in df.select(ok).collect()]
    assert got == [python_ok(b) for b in bodies], list(zip(bodies, got))
