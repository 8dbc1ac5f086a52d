import pytest
from pyspark.sql import functions as F

from hanmaru.llm import naming

LIST = [
    ("쇠비름뿌리농축분말", "EN Soebireum root concentrate powder"), ("쇠비름줄기농축분말", None), ("솔나물씨앗추출물", "영문명 Solnamul seed extract"), ("은방울꽃잎추출분말", None),
    ("비타민B1", "EN Vitamin B1"), ("비타민B12", None), ("비타민D", None), ("칼슘", None), ("락토바실러스 미르나시스", "영문명 Lactobacillus mireunasiseu"), ("도담베타글루칸", "EN Dodam beta-glucan | 복수"),
]
CASES = {
    "쇠비름 뿌리 추출물": "쇠비름뿌리농축분말", "쇠비룸줄기 건조분말(칠레산, 12mg)": "쇠비름줄기농축분말", "쇠비름 추출물": "", "thlqlfmaQnflshdcnrqnsakf": "쇠비름뿌리농축분말",
    "THLQLFMAWNFRLSHDCNRQNSAKF": "쇠비름줄기농축분말", "12mg / 유기농 솔나물 뿌리엑스": "솔나물씨앗추출물", "Solnamul seed ext(제2004-7101호, 70mg)": "솔나물씨앗추출물", "솔나물나": "",
    "은방울울꽃잎추출분말": "은방울꽃잎추출분말", "은방울꽃 열수추출물": "은방울꽃잎추출분말", "vit b12": "비타민B12", "건조 비타민B1，447mg": "비타민B1", "비타민D3 혼합제제(비타민D3, 아라비아검)": "비타민D",
    "비타민B6": "", "구연산칼슘": "칼슘", "스테아린산칼슘": "", "L 미르나시스 사균": "락토바실러스 미르나시스", "유산균 비르나시스": "락토바실러스 미르나시스", "Dodam beta-glucan": "도담베타글루칸",
    "도담 베타글루칸 파우더": "도담베타글루칸", "다솔베타글루칸": "", "결정셀룰로스": "", "~": "", " ": "", "가" * 30_000: "",
}


def listed(spark, rows):
    return spark.createDataFrame(rows, "name string, notes string").withColumn("kind", F.lit("clash"))


def test_cases(spark):
    df = spark.createDataFrame([(v,) for v in CASES] + [(None,), ("비타민B1",), ("비타민B1",)], "value string")
    got = {r.value: r.entry for r in naming.map_names(df, listed(spark, LIST + [(None, "x"), ("", None), LIST[0]])).collect()}
    assert got.pop("비타민B1") == "비타민B1"
    assert got == CASES


def test_no_values_and_no_list(spark):
    df = spark.createDataFrame([("비타민B1",)], "value string")
    assert naming.map_names(df.where("false"), listed(spark, LIST)).count() == 0
    assert [r.entry for r in naming.map_names(df, listed(spark, [])).collect()] == [""]


@pytest.mark.parametrize("threshold", [0.34, 0.6, 0.9])
def test_similarity_join_against_brute_force(spark, threshold):
    words = ["추출물", "추출분말", "농축분말", "열수추출", "발효물", "발효문", "abcde", "abcdf", "bcd", "x"]
    sets = {w: naming.pairs_of_letters("h", w) for w in words}
    df = spark.createDataFrame(list(sets.items()), "id string, tokens array<string>")
    got = {(r.left_id, r.right_id): round(r.jaccard, 9) for r in naming.similarity_join(df, df, threshold).collect()}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            j = len(set(x) & set(y)) / len(set(x) | set(y))
            if j >= threshold:
                want[a, b] = round(j, 9)
    assert got == want


def test_letters_and_keyboard():
    assert naming.typed_hangul("rkskek") == "가나다" and naming.typed_hangul("zinc") is None
    assert naming.romanised("달맞이꽃") == "dalmatikkot"
    assert [naming.slips(a, b) for a, b in (("ab", "ba"), ("ab", "abc"), ("ab", "cd"))] == [1, 1, 2]
    assert naming.spelled_alike("비타민b1", "비타민b12") == 2 and naming.spelled_alike("산초나무", "산딸나무") == 2


def test_names_of(spark):
    df = spark.createDataFrame([("비타민C 1,000mg; 제2020-9529호",), ("총함량 83.0%, 2019년 수확 ｜ [*A b]",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(naming.names_of(F.col("v"), naming.SUPPLEMENTS)).collect()] == [["비타민C"], ["A b"], None, []]


def test_another_domain_without_a_lexicon(spark):
    cities = listed(spark, [("Rotterdam", None), ("Amsterdam", None), ("København", None), ("São Paulo", None), ("서울특별시", None), ("부산광역시", None), ("New York", None)])
    typed = {"Roterdam": "Rotterdam", "AMSTERDAM ": "Amsterdam", "new-york": "New York", "서울특벌시": "서울특별시", "부산광역시 (해운대)": "부산광역시", "tjdnfxmrquftl": "서울특별시", "Berlin": "", "Amsterburg": ""}
    df = spark.createDataFrame([(v,) for v in typed], "value string")
    assert {r.value: r.entry for r in naming.map_names(df, cities, naming.Lexicon()).collect()} == typed


def test_values_typed_often_are_looked_up_apart(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"v{i}") for i in range(60)] + [(99, None)], "id long, v string")
    mapped = spark.createDataFrame([("a", "A")] + [(f"v{i}", "") for i in range(60)], "value string, entry string")
    got = sorted((r.id, r.entry) for r in naming.with_entries(rows, mapped, "v", "id", hot_rows=10).collect())
    assert got == [(i, "A" if i % 3 else "") for i in range(60)]


def test_readings_and_values_do_not_go_through_the_driver(spark, monkeypatch):
    """Their files are small, the rows are many: the planner would broadcast both."""
    plans, cut = {}, naming.write_through
    monkeypatch.setattr(naming, "write_through", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or cut(df, name))
    typed = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "id long, v string")
    mapped = naming.map_names(typed.select(F.col("v").alias("value")), listed(spark, LIST))
    rest = naming.with_entries(typed, mapped, "v", "id")
    assert sum("SortMergeJoin" in line and "stem" in line for line in plans["mapped-names"].splitlines()) == 1
    assert "SortMergeJoin" in plans["list-readings"]
    assert "SortMergeJoin [v" in rest._jdf.queryExecution().executedPlan().toString()
    assert {r.v: r.entry for r in rest.collect()} == CASES
