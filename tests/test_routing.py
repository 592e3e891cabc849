import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import routing

BINDINGS = [("a.b.c", 1), ("a.*.c", 2), ("a.b.*", 3), ("a.>", 4), (">", 5), ("a.b", 6), ("x.y.z", 7), ("*.b.c", 8)]
WANT = {"a.b.c": {1, 2, 3, 4, 5, 8}, "a.b.d": {3, 4, 5}, "a.b": {4, 5, 6}, "a.x.c": {2, 4, 5}, "a.b.c.d": {4, 5}, "x.y.z": {5, 7}, "q": {5}, "a": {5}, "p.b.c": {5, 8}}


def naive(pattern, subject):
    p, s = pattern.split("."), subject.split(".")
    for k, t in enumerate(p):
        if t == ">":
            return len(s) > k
        if k >= len(s) or t not in ("*", s[k]):
            return False
    return len(p) == len(s)


def found(spark, bindings, subjects):
    b = spark.createDataFrame(bindings, "pattern string, target int")
    r = spark.createDataFrame([(x,) for x in subjects], "subject string")
    out = {}
    for row in routing.matches(r, b).collect():
        out.setdefault(row["subject"], set()).add(row["target"])
    return out


def test_golden(spark):
    assert found(spark, BINDINGS, list(WANT)) == WANT


def test_like_a_token_walk(spark):
    words = ["a", "b", "c+", "d"]
    subjects = [".".join(x) for x in ([w] for w in words)] + [f"{x}.{y}" for x in words for y in words] + [f"{x}.{y}.{z}" for x in words for y in words for z in words]
    patterns = ["a", "*", ">", "a.*", "*.b", "a.>", "*.>", "a.*.c+", "*.b.>", "c+.*.*", "d.d.d"]
    got = found(spark, [(p, k) for k, p in enumerate(patterns)], subjects)
    want = {s: t for s in subjects if (t := {k for k, p in enumerate(patterns) if naive(p, s)})}
    assert got == want


@pytest.mark.parametrize(
    ("subject", "literal", "pattern"),
    [
        ("a", "ok", "ok"),
        ("a.b.c", "ok", "ok"),
        ("café.metric", "ok", "ok"),
        ("", "Empty", "Empty"),
        (".a", "EmptyToken", "EmptyToken"),
        ("a.", "EmptyToken", "EmptyToken"),
        ("a..b", "EmptyToken", "EmptyToken"),
        ("*", "WildcardNotAllowed", "ok"),
        ("a.*.c", "WildcardNotAllowed", "ok"),
        (">", "WildcardNotAllowed", "ok"),
        ("a.>", "WildcardNotAllowed", "ok"),
        ("a*", "IllegalChar", "IllegalChar"),
        ("a.b>c", "IllegalChar", "IllegalChar"),
        ("a\0b", "ControlChar", "ControlChar"),
        ("a.b\tc", "ControlChar", "ControlChar"),
        ("x\x7f", "ControlChar", "ControlChar"),
        ("a.>.b", "WildcardNotAllowed", "TailWildcardNotLast"),
        (">.a", "WildcardNotAllowed", "TailWildcardNotLast"),
        ("a.>.>", "WildcardNotAllowed", "TailWildcardNotLast"),
        (".".join("t" * 32), "ok", "ok"),
        (".".join("t" * 33), "TooDeep", "TooDeep"),
    ],
)
def test_grammar(spark, subject, literal, pattern):
    df = spark.createDataFrame([(subject,)], "s string").select(routing.verdict(F.col("s")), routing.verdict(F.col("s"), pattern=True))
    assert tuple(df.first()) == (literal, pattern)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=4).map(".".join), min_size=1, max_size=6))
def test_single_home_counts(spark, subjects):
    b = spark.createDataFrame(BINDINGS, "pattern string, target int")
    r = spark.createDataFrame([(s,) for s in subjects], "subject string")
    for row in routing.single_home(r, b).collect():
        n = sum(naive(p, row["subject"]) for p, _ in BINDINGS)
        assert (row["n"], row["resolution"]) == (n, "routed" if n == 1 else "ambiguous")
