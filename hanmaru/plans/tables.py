"""Catalogue, cache, event and label queries: paging, unions, versions, coverage, histograms, text sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.functions import text
from hanmaru.operators import groups, learn, matching, rows, vectors
from hanmaru.sources.tables import table
from hanmaru.streaming.progress import windowed_counts

CACHE = "product_similarity_explanation_cache"
INGREDIENTS = "ingredient_match_cache_v2"


def _key(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^0-9a-z가-힣]', '', 'g')"


def mentions_unique(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of every standard name: mentions, ingredients, the representative, the eight most frequent and the first eight ingredients."""
    r = table(spark, d, INGREDIENTS, "ingredient_id", "matched_standard_name").where(F.col("matched_standard_name") != "")
    r = r.withColumn("name_key", text.key_of(F.col("matched_standard_name"))).where("name_key <> ''")
    out = groups.unique_mentions(r, "name_key", "matched_standard_name", "ingredient_id")
    return out.select("name_key", "mentions", "products", "representative", F.array_join("variants", "|").alias("variants"), F.array_join("first_products", "|").alias("first_products"))


def ingredient_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One row per standard name: highest confidence, then most mentions, then the smallest id."""
    r = table(spark, d, INGREDIENTS, "ingredient_id", "matched_standard_name", "confidence", "mention_count").where(F.col("matched_standard_name") != "")
    r = r.select(text.key_of(F.col("matched_standard_name")).alias("name_key"), "ingredient_id", F.round("confidence", 6).alias("confidence"), "mention_count")
    return rows.first_per_key(r, ["name_key"], F.desc_nulls_last("confidence"), F.desc_nulls_last("mention_count"), F.col("ingredient_id"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CACHE, "base_product_id", "target_product_id", "created_at", "algorithm_version")


def label_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    """Repeated pairs reduced to the latest."""
    kept, _ = rows.dedupe_with_dropped(_pairs(spark, d), ["base_product_id", "target_product_id"], [F.col("created_at"), F.col("algorithm_version")])
    return kept


def label_dropped(spark: SparkSession, d: str) -> DataFrame:
    """The repeated pairs that the latest one replaced."""
    _, dropped = rows.dedupe_with_dropped(_pairs(spark, d), ["base_product_id", "target_product_id"], [F.col("created_at"), F.col("algorithm_version")])
    return dropped


def latest_upload_by_signature(spark: SparkSession, d: str) -> DataFrame:
    """The latest upload of every upload signature, without a sort."""
    r = table(spark, d, "uploaded_product_master", "upload_signature", "product_id", "updated_at").where(F.col("upload_signature") != "")
    return rows.latest_by_key(r, ["upload_signature"], "updated_at")


CUT = "2025-01-01 00:00:00"


def retry_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a base that has rows from the cut on are replaced by those."""
    r = _pairs(spark, d)
    at = F.lit(CUT).cast("timestamp_ntz")
    return rows.replace_keys(r.where(F.col("created_at") < at), r.where(F.col("created_at") >= at), ["base_product_id"])


def coverage_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every base before and from the cut on, and how many are missing or extra."""
    r = _pairs(spark, d)
    at = F.lit(CUT).cast("timestamp_ntz")
    return rows.coverage(r.where(F.col("created_at") < at), r.where(F.col("created_at") >= at), ["base_product_id"])


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after later imports of the same report number, which do not name the company: it stays that of the first import."""
    r = table(spark, d, "catalog_product_master", "report_no", "product_name", "company_name", "imported_at")
    first = rows.first_per_key(r, ["report_no"], F.col("imported_at"), F.col("product_name"), F.col("company_name"))
    later = r.drop("company_name").join(first.select("report_no", F.col("imported_at").alias("t0")), "report_no").where("imported_at > t0").drop("t0")
    return rows.upsert(first, later, ["report_no"], F.struct(F.col("imported_at"), F.col("product_name")))


def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """Cached pairs left when uploads that need a review are invalidated on either side, counted by algorithm."""
    ids = table(spark, d, "uploaded_product_master", "product_id", "needs_user_review").where("needs_user_review")
    left = rows.invalidate(_pairs(spark, d), ids, "product_id", "base_product_id", "target_product_id")
    return left.groupBy("algorithm_version").agg(F.count(F.lit(1)).alias("n"))


def catalog_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The first import of every report number; empty keys dropped."""
    r = table(spark, d, "catalog_product_master", "report_no", "product_name", "company_name", "imported_at").where(F.col("report_no") != "")
    return rows.first_per_key(r, ["report_no"], F.col("imported_at"), F.col("product_name"), F.col("company_name")).select("report_no", "product_name", "company_name")


def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue and uploads in one relation with their origin, those without a name aside; the filter reaches both scans."""
    catalog = table(spark, d, "catalog_product_master", "report_no", "product_name", "company_name")
    uploads = table(spark, d, "uploaded_product_master", "report_no", "product_name", "quality_grade")
    return rows.union_padded(("catalog", catalog), ("upload", uploads)).where(F.col("product_name") != "")


def catalog_search_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25 products whose name contains a word: exact names first, then those that begin with it, then the others."""
    r = table(spark, d, "catalog_product_master", "report_no", "product_name").where(F.contains("product_name", F.lit("골드"))).distinct()
    tier = F.when(F.col("product_name") == "골드", 0).when(F.startswith("product_name", F.lit("골드")), 1).otherwise(2)
    return rows.page(r.withColumn("tier", tier), [F.col("tier"), F.col("product_name"), F.col("report_no")], 3, 25)


def category_judgment_rates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "uploaded_product_master", "product_main_category", "quality_grade")
    r = r.withColumn("product_main_category", F.coalesce(F.nullif(F.col("product_main_category"), F.lit("")), F.lit("-")))
    return groups.cross_table(r, "product_main_category", "quality_grade", ["A", "B", "C", "D"], ["C", "D"])


def _conditions() -> list[tuple[str, Column]]:
    s, f, c = F.col("similarity_score"), F.col("function_similarity_score"), F.col("core_match_score")
    return [
        ("high_score", s >= 0.65), ("low_function", f < 0.4), ("no_core", c <= 0), ("high_score_low_core", (s >= 0.65) & (c < 0.4)),
        ("cold", (s < 0.45) & (f < 0.4)), ("no_score", s.isNull()), ("aligned", (F.abs(s - f) < 0.1)),
    ]


def pattern_impact(spark: SparkSession, d: str) -> DataFrame:
    """Named conditions on pairs in one scan: how many fulfil each, and how many of those are of low or high substitutability."""
    r = table(spark, d, CACHE, "similarity_score", "function_similarity_score", "core_match_score", "substitutability")
    clean = r.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in r.columns[:3]], "substitutability")
    return groups.condition_impacts(clean, _conditions(), {k: F.col("substitutability") == k for k in ("low", "high")})


def score_bins(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by score in steps of 0.05 and what is shared on average."""
    r = table(spark, d, CACHE, "similarity_score", "shared_ingredients_json").where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    bin_ = F.floor(F.round(F.col("similarity_score") * 20, 6))
    n = F.size(text.json_names(F.col("shared_ingredients_json")))
    return r.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean_shared"))


def shared_name_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, CACHE, "shared_ingredients_json")
    names = r.select(F.explode(text.json_names(F.col("shared_ingredients_json"))).alias("name"))
    return groups.histogram(names, "name", "-")


def category_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Row-local set comparison of shared and different categories, summed up by algorithm."""
    r = table(spark, d, CACHE, "algorithm_version", "shared_categories_json", "different_categories_json")
    a, b = text.json_names(F.col("shared_categories_json")), text.json_names(F.col("different_categories_json"))
    sim = vectors.set_similarity(F.array_distinct(a), F.array_distinct(b))
    return r.groupBy("algorithm_version").agg(F.count_if(sim > 0).alias("overlapping"), F.sum(F.size(F.array_union(a, b))).alias("categories"))


def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects of category scores as rows."""
    r = table(spark, d, "uploaded_product_master", "product_id", "category_scores_json")
    scores = F.from_json("category_scores_json", "map<string,double>")
    return r.select("product_id", F.explode(scores).alias("category", "score"))


def sectionize(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a scanned label under the last heading met; the first lines belong to the product name."""
    r = table(spark, d, "uploaded_product_master", "report_no", "ocr_raw_text").where(F.col("ocr_raw_text") != "")
    lines = r.select("report_no", F.posexplode(F.split("ocr_raw_text", "\n", -1)).alias("line_no", "line"))
    head = F.when(F.contains("line", F.lit("원재료")) | F.contains("line", F.lit("원료 및")), "ingredients").when(F.contains("line", F.lit("섭취")), "intake").when(F.contains("line", F.lit("LOT")), "lot")
    w = Window.partitionBy("report_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("product"))
    return lines.withColumn("section", section).groupBy("report_no", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))


def mention_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with packed fields: empty, brackets that do not pair up, very long."""
    r = table(spark, d, "catalog_product_master", "report_no", "raw_ingredients")
    f = F.coalesce("raw_ingredients", F.lit(""))
    opened, closed = F.length(F.regexp_replace(f, r"[^(\[]", "")), F.length(F.regexp_replace(f, r"[^)\]]", ""))
    warn = F.array_compact(F.array(F.when(F.trim(f) == "", "empty"), F.when(opened != closed, "brackets"), F.when(F.length(f) >= 600, "long")))
    return r.select("report_no", F.explode(warn).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("report_no").alias("products"))


def entry_names(spark: SparkSession, d: str) -> DataFrame:
    """Entries of every category in order, joined."""
    return groups.ordered_text(table(spark, d, "functional_category_map", "category_main", "functional_ingredient_name"), "category_main", "functional_ingredient_name", "functional_ingredient_name")


def stripped_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the standard names without preparation endings, counted."""
    r = table(spark, d, INGREDIENTS, "matched_standard_name").where(F.col("matched_standard_name") != "")
    key = text.strip_suffixes(text.key_of(F.col("matched_standard_name")), ["추출분말", "추출물", "농축분말", "분말", "제제"])
    return r.groupBy(key.alias("stem")).agg(F.count(F.lit(1)).alias("n"))


def family_counts(spark: SparkSession, d: str) -> DataFrame:
    """Names by the first family whose pattern they match."""
    rules = [("비타민|vitamin", "vitamin"), ("락토바실|lactobac|유산균", "probiotic"), ("콜라겐|collagen", "collagen"), ("올리고당|oligo", "oligosaccharide"), ("펩타이드|peptide", "peptide")]
    r = table(spark, d, INGREDIENTS, "raw_ingredient", "mention_count")
    fam = text.first_rule(text.fold(F.col("raw_ingredient")), rules, F.lit("other"))
    return r.groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.sum("mention_count").alias("mentions"))


def table_health(spark: SparkSession, d: str) -> DataFrame:
    """Missing signatures and doubtful rows of the uploads in one scan."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    r = table(spark, d, "uploaded_product_master", "upload_signature", "profile_signature", "parsed_signature", "ocr_confidence", "confidence")
    return r.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(blank(c)).alias(f"no_{c}") for c in ("upload_signature", "profile_signature", "parsed_signature")],
        F.count_if(F.col("ocr_confidence") < 0.6).alias("doubtful_scan"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def user_activity(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the last order, the number of orders and of finished ones; customers without orders too."""
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    sums = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    c = table(spark, d, "customer", "c_custkey", "c_name")
    return c.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.date_format("last_order", "yyyy-MM-dd").alias("last_order"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("finished", F.lit(0)).alias("finished"))


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events and orders of every user in one relation, one per user and moment (the highest value, then the origin and id), and of those the
    latest three of each user."""
    e = table(spark, d, "events", F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("string").alias("id"), F.col("value").cast("double").alias("value"))
    o = table(spark, d, "orders", F.col("o_custkey").cast("long").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("double").alias("value"))
    both = rows.union_padded(("event", e), ("order", o)).withColumn("value", F.round("value", 6))
    one = rows.first_per_key(both, ["user_id", "ts"], F.desc_nulls_last("value"), F.col("origin"), F.col("id"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"))
    return one.withColumn("place", F.row_number().over(w)).where("place <= 3").select("user_id", "origin", "id", "value", "place")


def monitoring_day(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 hours of the event table by type."""
    e = table(spark, d, "events", "ts", "event_type", "value")
    last = e.agg(F.max("ts").alias("last"))  # one row
    day = e.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 1 DAY"))
    return day.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def progress_latest_ttl(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of every user, of those with one in the last 15 minutes."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    latest = rows.latest_by_key(e, ["user_id"], "ts", "event_id")
    last = e.agg(F.max("ts").alias("last"))  # one row
    return latest.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("INTERVAL 15 MINUTES")).select("user_id", "event_id", "event_type")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """A JSON field of the events, summed up by type."""
    e = table(spark, d, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(k.isNull()).alias("no_k"))


def first_official_rank(spark: SparkSession, d: str) -> DataFrame:
    """The best rank of a catalogue product among the targets of every base."""
    r = table(spark, d, CACHE, "base_product_id", "target_product_id", "similarity_score").where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    best = r.groupBy("base_product_id", "target_product_id").agg(F.max("similarity_score").alias("score"))
    official = F.startswith("target_product_id", F.lit("catalog::"))
    # the rank of the best official target is one more than the targets before it: no sort of a whole base is needed
    top = best.where(official).groupBy("base_product_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("target_product_id").alias("t"))).alias("m"))
    ahead = F.struct((-F.col("score")).alias("s"), F.col("target_product_id").alias("t")) < F.col("m")
    return best.join(top, "base_product_id").groupBy("base_product_id").agg((F.count_if(ahead) + 1).alias("first_rank"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The threshold on 1 - score with the best F1 for low substitutability among those with a precision of at least 0.60 (of all, if none has it);
    of equal ones the highest."""
    r = table(spark, d, CACHE, "similarity_score", "substitutability").where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    return learn.best_threshold(r, 1 - F.col("similarity_score"), F.col("substitutability") == "low", 0.60)


def ingredient_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the reference list and, besides, names of the match cache with a category that are no entries."""
    listed = table(spark, d, "functional_category_map", "functional_ingredient_name", "category_main").select(F.col("functional_ingredient_name").alias("name"), F.col("category_main").alias("category"))
    typed = table(spark, d, INGREDIENTS, "matched_standard_name", "category_main").where((F.col("matched_standard_name") != "") & (F.col("category_main") != ""))
    custom = typed.groupBy(F.col("matched_standard_name").alias("name")).agg(F.min("category_main").alias("category"))
    return rows.union_padded(("list", listed), ("custom", custom.join(matching.small(listed.select("name")), "name", "left_anti")))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten products of every form and others up to 200."""
    r = table(spark, d, "catalog_product_master", "report_no", "form_factor").distinct()
    return rows.stratified_sample(r, "form_factor", "report_no", 10, 200, 11)


def ocr_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """The ingredient passage of a scanned label: the lines after its heading up to the next heading, put together again."""
    r = table(spark, d, "uploaded_product_master", "report_no", "ocr_raw_text").where(F.col("ocr_raw_text") != "")
    after = F.regexp_extract("ocr_raw_text", r"(?s)(?:원재료명 및 함량|원재료명|원료 및 함량)[^\n]*\n(.*?)\n(?:섭취|내용량|LOT)", 1)
    joined = F.regexp_replace(after, "\n", "")
    return r.select("report_no", joined.alias("passage")).where("passage <> ''")


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names in compatibility composition by their key, with a signature of each."""
    r = table(spark, d, INGREDIENTS, "raw_ingredient").where(F.col("raw_ingredient") != "")
    key = text.key_of(text.nfkc(F.col("raw_ingredient")))
    return r.select(key.alias("name_key")).groupBy("name_key").agg(F.count(F.lit(1)).alias("n")).select("name_key", "n", text.signature(F.col("name_key")).alias("signature"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type."""
    e = table(spark, d, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(e, "ts", "event_type", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events")


def quality_model(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored by boosted trees that learned low substitutability, counted by label."""
    r = table(spark, d, CACHE)
    features = learn.weighted_labels(learn.pair_features(r), F.col("substitutability") == "low")
    model = learn.train(features)
    return learn.predict(model, features, 0.5).groupBy("quality_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weak_probability"), 6).alias("mean_probability"))


QUERIES = {
    f.__name__: f
    for f in (
        mentions_unique, ingredient_dedupe, label_dedupe_last, label_dropped, latest_upload_by_signature, retry_replacement, coverage_mismatch, upsert_merge, cache_invalidate,
        catalog_refresh, catalog_union, catalog_search_page, category_judgment_rates, pattern_impact, score_bins, shared_name_counts, category_overlap, profile_scores, sectionize,
        mention_warnings, entry_names, stripped_keys, family_counts, table_health, user_activity, recent_activity, monitoring_day, progress_latest_ttl, event_props,
        first_official_rank, threshold_sweep, ingredient_catalog, stratified_sample, ocr_ingredients, text_keys, windowed_events, quality_model,
    )
}

_DEDUPE = f"""SELECT base_product_id, target_product_id, created_at, algorithm_version FROM {CACHE}
QUALIFY row_number() OVER (PARTITION BY base_product_id, target_product_id ORDER BY created_at DESC, algorithm_version DESC)"""
_COND = {
    "high_score": "s >= 0.65", "low_function": "f < 0.4", "no_core": "c <= 0", "high_score_low_core": "s >= 0.65 AND c < 0.4", "cold": "s < 0.45 AND f < 0.4", "no_score": "s IS NULL",
    "aligned": "abs(s - f) < 0.1",
}
_NAN = "CASE WHEN NOT isnan({0}) THEN {0} END"
_LIST = "coalesce(CAST(CASE WHEN json_valid({0}) THEN {0} END AS VARCHAR[]), [])"

SQL = {
    "mentions_unique": f"""WITH m AS (SELECT {_key('matched_standard_name')} AS name_key, matched_standard_name AS v, ingredient_id FROM {INGREDIENTS} WHERE matched_standard_name <> ''),
p AS (SELECT name_key, v, count(*) AS n, row_number() OVER (PARTITION BY name_key ORDER BY count(*) DESC, len(v), v) AS r FROM m WHERE name_key <> '' GROUP BY 1, 2),
d AS (SELECT name_key, ingredient_id, row_number() OVER (PARTITION BY name_key ORDER BY ingredient_id) AS j FROM (SELECT DISTINCT name_key, ingredient_id FROM m)),
i AS (SELECT name_key, count(*) AS products, string_agg(ingredient_id, '|' ORDER BY j) FILTER (j <= 8) AS first_products FROM d GROUP BY 1)
SELECT p.name_key, CAST(sum(n) AS BIGINT) AS mentions, any_value(i.products) AS products, any_value(i.first_products) AS first_products, min(v) FILTER (r = 1) AS representative, string_agg(v, '|' ORDER BY r) FILTER (r <= 8) AS variants
FROM p JOIN i ON p.name_key = i.name_key GROUP BY 1""",
    "ingredient_dedupe": f"""SELECT {_key('matched_standard_name')} AS name_key, ingredient_id, round(confidence, 6) AS confidence, mention_count FROM {INGREDIENTS} WHERE matched_standard_name <> ''
QUALIFY row_number() OVER (PARTITION BY {_key('matched_standard_name')} ORDER BY round(confidence, 6) DESC NULLS LAST, mention_count DESC NULLS LAST, ingredient_id) = 1""",
    "label_dedupe_last": _DEDUPE + " = 1",
    "label_dropped": _DEDUPE + " > 1",
    "latest_upload_by_signature": """SELECT upload_signature, product_id, updated_at FROM uploaded_product_master WHERE upload_signature <> ''
QUALIFY row_number() OVER (PARTITION BY upload_signature ORDER BY updated_at DESC NULLS LAST, product_id DESC) = 1""",
    "retry_replacement": f"""SELECT base_product_id, target_product_id, created_at, algorithm_version FROM {CACHE} a WHERE created_at >= TIMESTAMP '{CUT}'
OR (created_at < TIMESTAMP '{CUT}' AND NOT EXISTS (SELECT 1 FROM {CACHE} b WHERE b.created_at >= TIMESTAMP '{CUT}' AND b.base_product_id = a.base_product_id))""",
    "coverage_mismatch": f"""SELECT base_product_id, count_if(created_at < TIMESTAMP '{CUT}') AS expected, count_if(created_at >= TIMESTAMP '{CUT}') AS actual,
  greatest(0, count_if(created_at < TIMESTAMP '{CUT}') - count_if(created_at >= TIMESTAMP '{CUT}')) AS missing,
  greatest(0, count_if(created_at >= TIMESTAMP '{CUT}') - count_if(created_at < TIMESTAMP '{CUT}')) AS extra FROM {CACHE} WHERE created_at IS NOT NULL GROUP BY 1""",
    "upsert_merge": """WITH f AS (SELECT report_no, company_name, imported_at FROM catalog_product_master
  QUALIFY row_number() OVER (PARTITION BY report_no ORDER BY imported_at, product_name NULLS FIRST, company_name NULLS FIRST) = 1),
l AS (SELECT c.report_no, c.product_name, c.imported_at FROM catalog_product_master c JOIN f ON f.report_no = c.report_no WHERE c.imported_at >= f.imported_at
  QUALIFY row_number() OVER (PARTITION BY c.report_no ORDER BY c.imported_at DESC, CASE WHEN c.imported_at > f.imported_at THEN c.product_name END DESC NULLS LAST, c.product_name NULLS FIRST, c.company_name NULLS FIRST) = 1)
SELECT l.report_no, l.product_name, f.company_name, l.imported_at FROM l JOIN f ON l.report_no = f.report_no""",
    "cache_invalidate": f"""SELECT algorithm_version, count(*) AS n FROM {CACHE} WHERE base_product_id NOT IN (SELECT product_id FROM uploaded_product_master WHERE needs_user_review)
AND target_product_id NOT IN (SELECT product_id FROM uploaded_product_master WHERE needs_user_review) GROUP BY 1""",
    "catalog_refresh": """SELECT report_no, product_name, company_name FROM catalog_product_master WHERE report_no <> ''
QUALIFY row_number() OVER (PARTITION BY report_no ORDER BY imported_at, product_name, company_name NULLS FIRST) = 1""",
    "catalog_union": """SELECT report_no, product_name, company_name, 'catalog' AS origin, NULL AS quality_grade FROM catalog_product_master WHERE product_name <> ''
UNION ALL SELECT report_no, product_name, NULL, 'upload', quality_grade FROM uploaded_product_master WHERE product_name <> ''""",
    "catalog_search_page": """WITH r AS (SELECT DISTINCT report_no, product_name, CASE WHEN product_name = '골드' THEN 0 WHEN starts_with(product_name, '골드') THEN 1 ELSE 2 END AS tier
  FROM catalog_product_master WHERE contains(product_name, '골드')),
n AS (SELECT count(*) AS total_rows, least(3, greatest(1, CAST(ceil(count(*) / 25.0) AS INTEGER))) AS page_no FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY tier, product_name, report_no) AS i FROM r)
SELECT report_no, product_name, tier, page_no, total_rows FROM o, n WHERE i > (page_no - 1) * 25 AND i <= page_no * 25""",
    "category_judgment_rates": """SELECT coalesce(nullif(product_main_category, ''), '-') AS product_main_category, count(*) AS total, count_if(quality_grade = 'A') AS n_A, count_if(quality_grade = 'B') AS n_B,
  count_if(quality_grade = 'C') AS n_C, count_if(quality_grade = 'D') AS n_D, round(count_if(quality_grade IN ('C', 'D')) / count(*), 4) AS bad_rate FROM uploaded_product_master GROUP BY 1""",
    "pattern_impact": f"WITH r AS (SELECT {_NAN.format('similarity_score')} AS s, {_NAN.format('function_similarity_score')} AS f, {_NAN.format('core_match_score')} AS c, substitutability AS u FROM {CACHE})\n"
    + "\nUNION ALL ".join(f"SELECT '{k}' AS condition, count_if({v}) AS hits, count_if(({v}) AND u = 'low') AS low, count_if(({v}) AND u = 'high') AS high FROM r" for k, v in _COND.items()),
    "score_bins": f"""SELECT CAST(floor(round(similarity_score * 20, 6)) AS BIGINT) AS bin, count(*) AS n, round(avg(len({_LIST.format('shared_ingredients_json')})), 6) AS mean_shared
FROM {CACHE} WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY 1""",
    "shared_name_counts": f"SELECT coalesce(nullif(name, ''), '-') AS name, count(*) AS n FROM (SELECT unnest({_LIST.format('shared_ingredients_json')}) AS name FROM {CACHE}) GROUP BY 1",
    "category_overlap": f"""WITH r AS (SELECT algorithm_version, list_distinct({_LIST.format('shared_categories_json')}) AS a, list_distinct({_LIST.format('different_categories_json')}) AS b FROM {CACHE})
SELECT algorithm_version, count_if(len(list_intersect(a, b)) > 0) AS overlapping, CAST(sum(len(list_distinct(list_concat(a, b)))) AS BIGINT) AS categories FROM r GROUP BY 1""",
    "profile_scores": """SELECT product_id, e.key AS category, CAST(e.value AS DOUBLE) AS score
FROM (SELECT product_id, unnest(map_entries(CAST(CAST(category_scores_json AS JSON) AS MAP(VARCHAR, DOUBLE)))) AS e FROM uploaded_product_master WHERE json_valid(category_scores_json))""",
    "sectionize": """WITH l AS (SELECT report_no, unnest(string_split(ocr_raw_text, chr(10))) AS line, generate_subscripts(string_split(ocr_raw_text, chr(10)), 1) AS i FROM uploaded_product_master WHERE ocr_raw_text <> ''),
h AS (SELECT *, CASE WHEN contains(line, '원재료') OR contains(line, '원료 및') THEN 'ingredients' WHEN contains(line, '섭취') THEN 'intake' WHEN contains(line, 'LOT') THEN 'lot' END AS head FROM l),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY report_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'product') AS section FROM h)
SELECT report_no, section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM s GROUP BY 1, 2""",
    "mention_warnings": r"""WITH r AS (SELECT report_no, coalesce(raw_ingredients, '') AS f FROM catalog_product_master),
w AS (SELECT report_no, 'empty' AS warning FROM r WHERE trim(f) = '' UNION ALL SELECT report_no, 'long' FROM r WHERE length(f) >= 600
  UNION ALL SELECT report_no, 'brackets' FROM r WHERE length(regexp_replace(f, '[^(\[]', '', 'g')) <> length(regexp_replace(f, '[^)\]]', '', 'g')))
SELECT warning, count(*) AS n, count(DISTINCT report_no) AS products FROM w GROUP BY 1""",
    "entry_names": """SELECT category_main, string_agg(DISTINCT functional_ingredient_name, ' | ' ORDER BY functional_ingredient_name) AS functional_ingredient_name
FROM functional_category_map WHERE functional_ingredient_name <> '' GROUP BY 1""",
    "stripped_keys": f"""WITH RECURSIVE k AS (SELECT ingredient_id, {_key('matched_standard_name')} AS k, 0 AS i FROM {INGREDIENTS} WHERE matched_standard_name <> ''
UNION ALL SELECT ingredient_id, regexp_replace(k, '^(.{{2,}}?)(추출분말|추출물|농축분말|분말|제제)$', '\\1'), i + 1 FROM k WHERE regexp_matches(k, '^.{{2,}}?(추출분말|추출물|농축분말|분말|제제)$')),
l AS (SELECT k FROM k QUALIFY row_number() OVER (PARTITION BY ingredient_id ORDER BY i DESC) = 1)
SELECT k AS stem, count(*) AS n FROM l GROUP BY 1""",
    "family_counts": f"""SELECT CASE WHEN regexp_matches(t, '비타민|vitamin') THEN 'vitamin' WHEN regexp_matches(t, '락토바실|lactobac|유산균') THEN 'probiotic' WHEN regexp_matches(t, '콜라겐|collagen') THEN 'collagen'
  WHEN regexp_matches(t, '올리고당|oligo') THEN 'oligosaccharide' WHEN regexp_matches(t, '펩타이드|peptide') THEN 'peptide' ELSE 'other' END AS family, count(*) AS n, CAST(sum(mention_count) AS BIGINT) AS mentions
FROM (SELECT lower(trim(regexp_replace(coalesce(raw_ingredient, ''), '\\s+', ' ', 'g'))) AS t, mention_count FROM {INGREDIENTS}) GROUP BY 1""",
    "table_health": """SELECT count(*) AS n, count_if(coalesce(upload_signature, '') = '') AS no_upload_signature, count_if(coalesce(profile_signature, '') = '') AS no_profile_signature,
  count_if(coalesce(parsed_signature, '') = '') AS no_parsed_signature, count_if(ocr_confidence < 0.6) AS doubtful_scan, round(avg(confidence), 6) AS mean_confidence FROM uploaded_product_master""",
    "user_activity": """SELECT c_custkey, c_name, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order, count(o_orderkey) AS orders, count_if(o_orderstatus = 'F') AS finished
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
    "recent_activity": """WITH b AS (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id AS VARCHAR) AS id, round(CAST(value AS DOUBLE), 6) AS value, 'event' AS origin FROM events
  UNION ALL SELECT CAST(o_custkey AS BIGINT), CAST(o_orderdate AS TIMESTAMP), CAST(o_orderkey AS VARCHAR), round(CAST(o_totalprice AS DOUBLE), 6), 'order' FROM orders),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY value DESC NULLS LAST, origin, id) = 1)
SELECT user_id, origin, id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS INTEGER) AS place FROM o QUALIFY place <= 3""",
    "monitoring_day": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1",
    "progress_latest_ttl": """SELECT user_id, event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "event_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count_if(json_extract_string(props, '$.k') IS NULL) AS no_k FROM events GROUP BY 1",
    "first_official_rank": f"""WITH best AS (SELECT base_product_id, target_product_id, max(similarity_score) AS score FROM {CACHE} WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY base_product_id ORDER BY score DESC, target_product_id) AS rk FROM best)
SELECT base_product_id, min(rk) AS first_rank FROM r WHERE starts_with(target_product_id, 'catalog::') GROUP BY 1""",
    "threshold_sweep": f"""WITH s AS (SELECT 1 - similarity_score AS threshold, count_if(substitutability = 'low') AS pos, count(*) AS n
  FROM {CACHE} WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY 1),
r AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS flagged, sum(pos) OVER () AS all_pos FROM s),
f AS (SELECT *, round(CAST(tp AS DOUBLE) / flagged, 9) AS p, round(2 * CAST(tp AS DOUBLE) / (flagged + all_pos), 9) AS f FROM r)
SELECT round(threshold, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(flagged AS BIGINT) AS flagged, CAST(all_pos AS BIGINT) AS all_pos, p AS precision, f AS f1 FROM f ORDER BY CAST(p >= 0.6 AS INTEGER) DESC, f DESC, threshold DESC LIMIT 1""",
    "ocr_ingredients": r"""SELECT report_no, replace(regexp_extract(ocr_raw_text, '(?s)(?:원재료명 및 함량|원재료명|원료 및 함량)[^\n]*\n(.*?)\n(?:섭취|내용량|LOT)', 1), chr(10), '') AS passage
FROM uploaded_product_master WHERE ocr_raw_text <> '' AND passage <> ''""",
    "stratified_sample": """WITH r AS (SELECT DISTINCT report_no, form_factor FROM catalog_product_master),
t AS (SELECT *, md5('11|' || report_no) AS h, CASE WHEN row_number() OVER (PARTITION BY form_factor ORDER BY md5('11|' || report_no), report_no) <= 10 THEN 1 ELSE 2 END AS tier FROM r)
SELECT report_no, form_factor FROM t ORDER BY tier, h, report_no LIMIT 200""",
    "text_keys": f"""WITH k AS (SELECT regexp_replace(lower(nfc_normalize(translate(raw_ingredient, '{''.join(map(chr, range(0xFF01, 0xFF5F)))}', '{''.join(map(chr, range(0x21, 0x7F))).replace("'", "''")}'))), '[^0-9a-z가-힣]', '', 'g') AS name_key
  FROM {INGREDIENTS} WHERE raw_ingredient <> '')
SELECT name_key, count(*) AS n, sha1('{{"p0":"[\\"' || name_key || '\\"]"}}') AS signature FROM k GROUP BY 1""",
    "windowed_events": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2""",
    "ingredient_catalog": f"""SELECT functional_ingredient_name AS name, category_main AS category, 'list' AS origin FROM functional_category_map
UNION ALL SELECT matched_standard_name, min(category_main), 'custom' FROM {INGREDIENTS} WHERE matched_standard_name <> '' AND category_main <> ''
  AND matched_standard_name NOT IN (SELECT functional_ingredient_name FROM functional_category_map) GROUP BY 1""",
}
