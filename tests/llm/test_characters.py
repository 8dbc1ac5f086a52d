import unicodedata

from pyspark.sql import functions as F

from hanmaru.llm.characters import canonical_text, same_reading_pairs

SAME = [
    ("Ａ，Ｂ", "A,B"), ("가\u00a0나", "가 나"), ("가\u2009나", "가 나"), ("가　나", "가 나"), ("가\u200b나", "가나"), (unicodedata.normalize("NFD", "한글 é"), "한글 é"),
    ("НР123", "HP123"), ("Έ", "É"), ("e\u200b\u0301", "é"), ("a\r\nb", "a\nb"), ("㎎", "mg"), ("１,５００ｍｇ", "1,500mg"), ("ё", "ë"),
]
DIFFERENT = [("a b", "a  b"), ("A", "a"), ("a,b", "a、b"), ("α", "a"), ("a\nb", "a b"), ("a-b", "a–b"), ("\"a\"", "“a”")]


def test_forms(spark):
    texts = sorted({t for p in SAME + DIFFERENT for t in p})
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, canonical_text int")
    out = canonical_text(df, "t", "form")
    assert out.columns == ["t", "canonical_text", "form"]
    form = {r.t: r.form for r in out.collect()}
    for a, b in SAME:
        assert form[a] == form[b] == b, (a, b)
    for a, b in DIFFERENT:
        assert form[a] != form[b], (a, b)
    assert all(form[f] == f for f in form.values() if f in form)


def test_nulls_empty_long_and_same_column(spark):
    df = spark.createDataFrame([(None,), ("",), ("Ａ" * 300_000,)], "t string")
    got = [r.t for r in canonical_text(df, "t", "t").collect()]
    assert got == [None, "", "A" * 300_000]
    assert canonical_text(df.where("false"), "t").count() == 0


def test_pairs(spark):
    rows = [("1", "가 나"), ("2", "가\u00a0나"), ("3", "가 나"), ("3", "가 나"), ("4", ""), ("5", None), (None, "가　나"), ("6", "가 나"), ("7", "다")]
    df = spark.createDataFrame(rows, "k string, t string")
    assert sorted(tuple(r) for r in same_reading_pairs(df, "k", "t").collect()) == [("1", "2"), ("2", "3"), ("2", "6")]
    assert same_reading_pairs(df.where(F.lit(False)), "k", "t").count() == 0
