from pyspark.sql import functions as F

from hanmaru.api import Engine
from hanmaru.sources.tables import table


def test_search_product_and_pages(spark, small):
    engine = Engine(spark, small)
    one = table(spark, small, "catalog_product_master", "report_no", "product_name").where("report_no <> ''").orderBy("report_no").first()
    assert engine.product(one.report_no).first().product_name == one.product_name
    first = engine.search_products(one.product_name.replace(" ", "  "), 5).first()
    assert (first.tier, first.product_name) == (0, one.product_name)
    assert engine.product("no such").count() == 0
    a, b = ([r.product_id for r in engine.catalog_page(n, 7).collect()] for n in (1, 2))
    assert len(a) == len(b) == 7 and not set(a) & set(b)
    assert engine.catalog_page(999, 7).count() > 0
    assert engine.ingredients(1, 10).count() == 10


def test_matching_and_recommendations(spark, small):
    engine = Engine(spark, small)
    assert engine.match_ingredients(["비타민 C", "??"], 1).collect()[0].entry == "비타민C"
    p = table(spark, small, "uploaded_product_master", "product_id", "raw_ingredients", "ocr_raw_text").where("raw_ingredients <> '' and contains(ocr_raw_text, '원재료명')").orderBy("product_id").first()
    best = engine.recommend_by_text(p.raw_ingredients, 3).collect()
    assert (best[0].product_id, best[0].score) == (p.product_id, 1.0)
    assert engine.recommend_by_text(p.ocr_raw_text, 3).first().score > 0.3
    assert engine.recommend_by_ingredients([], 3).count() == 0


def test_similar(spark, small):
    cache = table(spark, small, "product_similarity_explanation_cache")
    base = cache.groupBy("base_product_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "base_product_id").first().base_product_id
    engine = Engine(spark, small)
    got = [r.similarity_score for r in engine.similar(base, 5).collect()]
    assert got == sorted(got, reverse=True) and len(got) == 5
    fresh = engine.similar(base, 5, refresh=True).collect()
    assert fresh == engine.similar(base, 5, refresh=True).collect()
    vectors = {}
    for r in engine.vectors().collect():
        vectors.setdefault(r.product_id, {})[r.item] = r.weight
    mine = vectors[base]
    score = lambda v: sum(w for i, w in v.items() if i in mine) / sum({**v, **mine}.values())
    want = sorted(((round(score(v), 6), p) for p, v in vectors.items() if p != base and v.keys() & mine.keys()), key=lambda x: (-x[0], x[1]))[:5]
    assert [(round(r.similarity_score, 5), r.target_product_id) for r in fresh] == [(round(s, 5), p) for s, p in want]
