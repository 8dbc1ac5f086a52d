import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hanmaru.operators.packed import explode_packed, split_packed

CASES = {
    'a, b (c, d) , "향료 ""레몬""", 1,000mg, x': ["a", "b (c, d)", '향료 "레몬"', "1,000mg", "x"],
    '["a, b","향료 \\"레몬\\"", , "c"]': ["a, b", '향료 "레몬"', "c"],
    "'a, b', 'c [d; e]'": ["a, b", "c [d; e]"],
    "it's, b": ["it's", "b"],
    "[a] x, [b]": ["[a] x", "[b]"],
    'a "b, c': ['a "b', "c"],
    "a (b, c": ["a (b", "c"],
    "a)b, c": ["a)b", "c"],
    "": [],
    "  ": [],
    ",;|": [],
    "[]": [],
    " · a · b·c +d + e": ["a", "b·c", "d", "e"],
    "유당혼합분말 [유당 98%, 유청]、나(라(마, 바), 사)，아": ["유당혼합분말 [유당 98%, 유청]", "나(라(마, 바), 사)", "아"],
    '"""레몬"" 향료", x': ['"레몬" 향료', "x"],
    '"" , x': ["x"],
    "타우린 １,５００ｍｇ\t　b　": ["타우린 １,５００ｍｇ", "b"],
    "a\\b, c": ["a\\b", "c"],
}


def test_cases(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(CASES)], "k int, f string")
    got = {r.f: r.packed_values for r in split_packed(df, "f").collect()}
    assert got == CASES


def test_nulls_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([("1", "a, b", 9), ("1", "a, b", 8), (None, "c", 7), ("2", None, 6), ("3", "", 5)], "k string, packed_values string, value_pos int")
    out = split_packed(df, "packed_values", "packed_values")
    assert out.columns == df.columns
    assert sorted(tuple(r.packed_values) for r in out.collect()) == [(), (), ("a", "b"), ("a", "b"), ("c",)]
    rows = explode_packed(df, "k", "packed_values").collect()
    assert sorted((r.k or "", r.value_pos, r.value_text) for r in rows) == [("", 1, "c"), ("1", 1, "a"), ("1", 2, "b")]


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], "k string, f string")
    assert explode_packed(df, "k", "f").count() == 0
    long = ", ".join(f"원료{i}(a, b)" for i in range(30_000)) + ", " + "x" * 500_000
    rows = explode_packed(spark.createDataFrame([("1", long)], "k string, f string"), "k", "f")
    assert rows.count() == 30_001
    assert rows.agg(F.max("value_pos")).first()[0] == 30_001


def brute(text: str) -> list[str]:
    """Character by character, for texts without unpaired quotes and brackets."""
    out, raw, depth, quote, i = [], "", 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            raw += c
            if c == quote:
                quote = ""
        elif c == '"':
            quote = c
            raw += c
        elif c in "([":
            depth += 1
            raw += c
        elif c in ")]":
            depth -= 1
            raw += c
        elif c in ",;/|" and depth == 0 and not (c == "," and i and text[i - 1].isdigit() and text[i + 1 : i + 2].isdigit()):
            out.append(raw)
            raw = ""
        else:
            raw += c
        i += 1
    out.append(raw)
    values = []
    for v in (v.strip() for v in out):
        if m := re.fullmatch(r'"([^"]*)"', v):
            v = m[1].strip()
        if v:
            values.append(v)
    return values


atom = st.text(alphabet="ab1 가2", min_size=0, max_size=5)
part = st.one_of(atom, atom.map(lambda x: f"x({x},{x})"), atom.map(lambda x: f'"{x};{x}"'), atom.map(lambda x: f"y[{x}/{x}]"))
field = st.lists(st.tuples(part, st.sampled_from([",", ";", "/", "|", ", "])), max_size=6).map(lambda xs: "".join(a + b for a, b in xs))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(field, min_size=1, max_size=30))
def test_against_brute_force(spark, fields):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "k int, f string")
    for r in split_packed(df, "f").collect():
        assert r.packed_values == brute(r.f), r.f


@pytest.mark.parametrize("value", ["a(b", 'a"b', "[a", "a]"])
def test_unpaired_signs_stay(spark, value):
    df = spark.createDataFrame([(1, value)], "k int, f string")
    assert split_packed(df, "f").first().packed_values == [value]
