"""Property tests: Spark operators against brute-force Python models."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strata.operators import quality as Q
from strata.operators.upsert import replaced_rows, upsert

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.one_of(st.none(), st.integers(0, 5))
rows = st.lists(st.tuples(keys, st.integers(0, 3)), max_size=8)


def model_upsert(target, staged):
    staged_keys = {k for k, _ in staged if k is not None}
    return Counter([r for r in target if r[0] is None or r[0] not in staged_keys] + staged)


@SETTINGS
@given(target=rows, staged=rows)
def test_upsert_matches_delete_then_insert(spark, target, staged):
    schema = "k int, v int"
    t = spark.createDataFrame(target, schema)
    s = spark.createDataFrame(staged, schema)
    got = Counter(tuple(r) for r in upsert(t, s, "k").collect())
    assert got == model_upsert(target, staged)
    replaced = Counter(tuple(r) for r in replaced_rows(t, s, "k").collect())
    staged_keys = {k for k, _ in staged if k is not None}
    assert replaced == Counter(r for r in target if r[0] is not None and r[0] in staged_keys)


values = st.lists(st.one_of(st.none(), st.integers(-3, 12)), max_size=12)


@SETTINGS
@given(xs=values, lo=st.integers(-1, 4), hi=st.integers(5, 10), t=st.sampled_from([0.0, 0.25, 0.5]))
def test_rules_match_brute_force(spark, xs, lo, hi, t):
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    rs = Q.Ruleset("p", (Q.row_count(0), Q.is_complete("x"), Q.completeness("x", t),
                         Q.column_values("x", (lo, hi)), Q.column_values("x", (lo, hi), inclusive=False)))
    got = {r.rule_no: (r.metric, r.passed) for r in Q.evaluate(df, rs).collect()}
    n = len(xs)
    nn = [x for x in xs if x is not None]
    frac = len(nn) / n if n else None
    inc = [x for x in nn if lo <= x <= hi]
    exc = [x for x in nn if lo < x < hi]
    want = {
        1: (float(n), n > 0),
        2: (frac, len(nn) == n),
        3: (frac, frac is not None and frac > t),
        4: (len(inc) / len(nn) if nn else None, len(inc) == len(nn)),
        5: (len(exc) / len(nn) if nn else None, len(exc) == len(nn)),
    }
    assert got == want
    # failing_rows lists exactly the rows breaking a row-level rule
    bad = Q.failing_rows(df, rs).collect()
    assert len(bad) == sum(1 for x in xs if x is None or not (lo < x < hi))
