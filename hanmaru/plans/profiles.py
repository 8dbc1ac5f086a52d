"""Profiles, search, reasons and batches: what a similarity service asks of the tables besides the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.functions import text
from hanmaru.operators import matching, rows, vectors
from hanmaru.plans.matching import FOREIGN, ratio_sql
from hanmaru.plans.similarity import CAT, IMAP, MAIN, PAIRS, SEM, VEC, _with, imap, kept_semantic, main_category_of, top_of, vec
from hanmaru.plans.tables import CACHE, INGREDIENTS, _key
from hanmaru.sources.tables import table


def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The role of every ingredient of a product: support for excipients, primary for those of the main category with at least 0.72 of the top weight,
    secondary otherwise; a product without a primary one makes its heaviest ingredient primary."""
    v = vec(spark, d).withColumn("weight", F.round("weight", 9))
    stats = v.groupBy("owner").agg(F.max("weight").alias("top"))
    main = main_category_of(spark, d).select("owner", F.col("category").alias("main"))
    r = v.join(imap(spark, d).select("item", "category", "kind"), "item").join(stats, "owner").join(main, "owner")
    role = F.when(F.col("kind") == "excipient", "support").when((F.col("category") == F.col("main")) & (F.col("weight") >= 0.72 * F.col("top")), "primary").otherwise("secondary")
    r = r.withColumn("role", role)
    fix = r.groupBy("owner").agg(F.count_if(F.col("role") == "primary").alias("primaries"), F.min(F.struct((-F.col("weight")).alias("w"), "item"))["item"].alias("heaviest"))
    role = F.when((F.col("primaries") == 0) & (F.col("item") == F.col("heaviest")), "primary").otherwise(F.col("role"))
    return r.join(fix, "owner").select(F.col("owner").alias("product_id"), F.col("item").alias("ingredient"), role.alias("role"))


def profile_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How clear a product's main category is: 0.45 and a bonus by the ratio of its score to the second one."""
    m = main_category_of(spark, d)
    ratio = F.when(F.col("second_score") > 0, F.col("score") / F.col("second_score")).otherwise(9.99)
    bonus = F.when(ratio >= 1.8, 0.28).when(ratio >= 1.5, 0.20).when(ratio >= 1.2, 0.10).otherwise(-0.05)
    return m.select(F.col("owner").alias("product_id"), F.round(ratio, 6).alias("ratio"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.99), 0.45 + bonus)), 4).alias("confidence"))


def reason_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """The three shared ingredients that contribute most to each of the ten best pairs."""
    sem = kept_semantic(spark, d).select("owner", "item", "weight")
    top = top_of(spark, d).select("base_id", "target_id")
    a, b = sem.select(F.col("owner").alias("base_id"), "item", F.col("weight").alias("bw")), sem.select(F.col("owner").alias("target_id"), "item", F.col("weight").alias("tw"))
    met = top.join(a, "base_id").join(b, ["target_id", "item"])
    w = Window.partitionBy("base_id", "target_id").orderBy(F.desc("share"), "item")
    ranked = met.withColumn("share", F.least("bw", "tw")).withColumn("rk", F.row_number().over(w)).where("rk <= 3")
    return ranked.select("base_id", "target_id", F.col("item").alias("ingredient"), "share", "rk")


def measure_compare(spark: SparkSession, d: str) -> DataFrame:
    """Per main category how many of the ten best pairs by plain overlap are also among the ten best by weights."""
    sem = kept_semantic(spark, d)
    plain = vectors.weighted_jaccard(sem.select("owner", "item", F.lit(1.0).alias("weight"), "main"), "main").withColumn("score", F.round("score", 6))
    plain = vectors.top_pairs(plain, 10, F.desc("score"), F.col("target_id")).select("base_id", "target_id", F.lit(1).alias("plain"))
    both = top_of(spark, d).select("base_id", "target_id", F.lit(1).alias("weighted")).join(plain, ["base_id", "target_id"], "full_outer")
    main = sem.select(F.col("owner").alias("base_id"), "main").distinct()
    return both.join(main, "base_id").groupBy("main").agg(F.count("weighted").alias("weighted"), F.count("plain").alias("plain"), F.count_if(F.col("weighted").isNotNull() & F.col("plain").isNotNull()).alias("both"))


WORDS = ("인동덩굴", "골드", "캡슐")


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Products with any of some words in name, company or ingredients, and how many different words they have."""
    r = table(spark, d, "catalog_product_master", "report_no", "product_name", "company_name", "raw_ingredients").drop_duplicates(["report_no", "product_name"])
    hay = F.concat_ws(" ", "product_name", "company_name", "raw_ingredients")
    hits = sum((F.contains(hay, F.lit(w)).cast("int") for w in WORDS[1:]), F.contains(hay, F.lit(WORDS[0])).cast("int"))
    return r.select("report_no", "product_name", hits.alias("hits")).where("hits > 0")


ASKED = "소담원 까마중 밸런스"


def search_names(products: DataFrame, name: str, asked: str, limit: int) -> DataFrame:
    """The `limit` best rows for a name asked for: equal keys first, then keys that contain it (shorter first), then those whose matching ratio
    with it is 0.55 or more (the highest first); what only contains it is not rated again. The ratio is worked out only where the
    letters both have allow it."""
    sought = "".join(c for c in asked.lower() if c.isascii() and c.isalnum() or "가" <= c <= "힣")
    key = text.key_of(F.col(name))
    marked = products.withColumn("__k", key).withColumn("tier", F.when(F.col("__k") == sought, 0).when(F.contains("__k", F.lit(sought)), 1).otherwise(2))
    n, m = F.length("__k"), len(sought)
    common = F.least(n - F.length(F.translate("__k", sought, "")), F.lit(m) - F.length(F.expr(f"translate('{sought}', __k, '')")))
    possible = (F.col("tier") < 2) | ((2 * F.least(n, F.lit(m)) >= 0.5499995 * (n + m)) & (2 * common >= 0.5499995 * (n + m)))
    ratio = F.when(F.col("tier") < 2, 1.0).otherwise(F.round(text.matching_ratio(F.col("__k"), F.lit(sought)), 6))
    found = marked.where(possible & (F.lit(m) > 0)).withColumn("ratio", ratio).where(F.col("ratio") >= 0.55)
    return found.orderBy("tier", F.desc("ratio"), F.length("__k"), name, *[c for c in products.columns if c != name]).limit(limit).drop("__k")


def product_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best products for a name asked for."""
    r = table(spark, d, "catalog_product_master", "report_no", "product_name").where(F.col("report_no").isNotNull()).distinct()
    return search_names(r, "product_name", ASKED, 20)


def entry_batches(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the reference list in requests of 25, each labelled with the range it holds."""
    e = table(spark, d, "functional_category_map", F.col("functional_ingredient_name").alias("name"))
    numbered = e.withColumn("n", F.row_number().over(Window.orderBy("name")))  # the fixed list
    batch = F.floor((F.col("n") - 1) / 25)
    out = numbered.groupBy(batch.alias("batch_no")).agg(F.count(F.lit(1)).alias("items"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))
    return out.select("batch_no", "items", F.format_string("%03d-%03d", "lo", "hi").alias("label"), "names")


def upload_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Enabled uploads, one per profile signature: the latest; those without a signature stay."""
    r = table(spark, d, "uploaded_product_master", "product_id", "profile_signature", "is_candidate_enabled", "updated_at").where("is_candidate_enabled")
    r = r.withColumn("profile_signature", F.nullif("profile_signature", F.lit("")))
    kept, _ = rows.dedupe_with_dropped(r, ["profile_signature"], [F.col("updated_at"), F.col("product_id")])
    return kept.select("product_id", "profile_signature")


def standard_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per standard name the highest confidence, the methods that found it and the first eight raw spellings."""
    r = table(spark, d, INGREDIENTS, "matched_standard_name", "confidence", "match_method", "raw_ingredient").where(F.col("matched_standard_name") != "")
    r = r.withColumn("name_key", text.key_of(F.col("matched_standard_name")))
    # spellings are cut to eight per key before they meet: no key gathers all of its rows
    raws = r.where(F.col("raw_ingredient").isNotNull()).select("name_key", "raw_ingredient").distinct()
    w = Window.partitionBy("name_key").orderBy("raw_ingredient")
    first = raws.withColumn("i", F.row_number().over(w)).where("i <= 8").groupBy("name_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw_ingredient"))), lambda x: x["raw_ingredient"]), "\n").alias("raws"))
    sums = r.groupBy("name_key").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.array_join(F.sort_array(F.collect_set(F.nullif("match_method", F.lit("")))), ",").alias("methods"))
    return sums.join(first, "name_key", "left")


def upload_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of the uploads by grade."""
    r = table(spark, d, "uploaded_product_master", "quality_grade", "quality_warnings_json")
    w = r.select("quality_grade", F.explode(F.array_distinct(text.json_names(F.col("quality_warnings_json")))).alias("warning"))
    return w.groupBy("quality_grade", "warning").agg(F.count(F.lit(1)).alias("n"))


def explanation_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the explanation objects, summed up."""
    r = table(spark, d, CACHE, "explanation_json")
    o = F.from_json("explanation_json", "top string, n bigint")
    return r.select(o["top"].alias("top"), o["n"].alias("n")).groupBy("top").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"))


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval score of every standard name and list entry that share anything: 12 for equal keys, 7 if one key of four or more letters is
    within the other, 1.7 for every shared word of name and entry or its foreign name, 0.8 for the same four first letters. Words and
    beginnings meet in equi joins, containment by the index of keys."""
    names = table(spark, d, INGREDIENTS, "matched_standard_name").where(F.col("matched_standard_name") != "").select(F.lower("matched_standard_name").alias("name")).distinct().withColumn("name_key", text.key_of(F.col("name")))
    e = table(spark, d, "functional_category_map", "functional_ingredient_name", "notes").select(F.col("functional_ingredient_name").alias("entry"), F.lower("functional_ingredient_name").alias("low"), F.lower(F.regexp_extract(F.coalesce("notes", F.lit("")), FOREIGN, 1)).alias("english"))
    e = e.withColumn("entry_key", text.key_of(F.col("entry")))
    words = lambda *cs: F.array_distinct(F.filter(F.split(F.concat_ws(" ", *cs), r"[^0-9a-z가-힣]+"), lambda w: F.length(w) > 1))
    shared = names.select("name", F.explode(words("name")).alias("w")).join(matching.small(e.select("entry", F.explode(words("low", "english")).alias("w"))), "w").groupBy("name", "entry").agg((1.7 * F.count(F.lit(1))).alias("s"))
    near = matching.contained(names, "name_key", e.select("entry", "entry_key"), "entry_key").select("name", "entry", F.when(F.col("name_key") == F.col("entry_key"), 12.0).otherwise(7.0).alias("s"))
    first = names.where(F.length("name_key") >= 4).withColumn("h", F.substring("name_key", 1, 4)).join(matching.small(e.where(F.length("entry_key") >= 4).select("entry", F.substring("entry_key", 1, 4).alias("h"))), "h").select("name", "entry", F.lit(0.8).alias("s"))
    return shared.unionByName(near).unionByName(first).groupBy("name", "entry").agg(F.round(F.sum("s"), 6).alias("score"))


def pair_feature_sums(spark: SparkSession, d: str) -> DataFrame:
    """Features of the quality classifier, averaged by substitutability."""
    from hanmaru.operators.learn import pair_features

    f = pair_features(table(spark, d, CACHE))
    return f.groupBy(F.coalesce("substitutability", F.lit("-")).alias("substitutability")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 5).alias("similarity"), F.round(F.avg("shared"), 5).alias("shared"), F.round(F.avg("shared_share"), 5).alias("shared_share"), F.sum("weak_core").cast("long").alias("weak_core"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        role_assignment, profile_confidence, reason_ingredients, measure_compare, keyword_search, product_search, entry_batches, upload_dedupe, standard_summary, upload_warnings,
        explanation_fields, token_overlap, pair_feature_sums,
    )
}

_CORE = _with(VEC, IMAP, CAT, MAIN, SEM, PAIRS)
_JSON = "coalesce(CAST(CASE WHEN json_valid({0}) THEN {0} END AS VARCHAR[]), [])"
_SCORE = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0 ELSE {0} END"

SQL = {
    "role_assignment": _with(VEC, IMAP, CAT, MAIN)
    + """, w AS (SELECT v.owner, v.item, round(v.weight, 9) AS weight, max(round(v.weight, 9)) OVER (PARTITION BY v.owner) AS top FROM vec v),
r AS (SELECT w.owner, w.item, w.weight, CASE WHEN m.kind = 'excipient' THEN 'support' WHEN m.category = n.main AND w.weight >= 0.72 * w.top THEN 'primary' ELSE 'secondary' END AS role
  FROM w JOIN imap m ON w.item = m.item JOIN main n ON n.owner = w.owner)
SELECT owner AS product_id, item AS ingredient, CASE WHEN count_if(role = 'primary') OVER (PARTITION BY owner) = 0 AND row_number() OVER (PARTITION BY owner ORDER BY weight DESC, item) = 1
  THEN 'primary' ELSE role END AS role FROM r""",
    "profile_confidence": _with(VEC, IMAP, CAT, MAIN)
    + """, x AS (SELECT a.owner, CASE WHEN coalesce(round(b.score, 9), 0) > 0 THEN round(a.score, 9) / round(b.score, 9) ELSE 9.99 END AS ratio
  FROM ranked a LEFT JOIN ranked b ON a.owner = b.owner AND b.rn = 2 WHERE a.rn = 1)
SELECT owner AS product_id, round(ratio, 6) AS ratio, CAST(round(greatest(0.1, least(0.99, 0.45 + CASE WHEN ratio >= 1.8 THEN 0.28 WHEN ratio >= 1.5 THEN 0.2 WHEN ratio >= 1.2 THEN 0.1 ELSE -0.05 END)), 4) AS DOUBLE) AS confidence FROM x""",
    "reason_ingredients": _CORE
    + """, met AS (
  SELECT t.base_id, t.target_id, a.item AS ingredient, CAST(least(a.weight, b.weight) AS DOUBLE) AS share,
    row_number() OVER (PARTITION BY t.base_id, t.target_id ORDER BY least(a.weight, b.weight) DESC, a.item) AS i
  FROM topk t JOIN sem a ON a.owner = t.base_id JOIN sem b ON b.owner = t.target_id AND b.item = a.item)
SELECT base_id, target_id, ingredient, share, i AS rk FROM met WHERE i <= 3""",
    "measure_compare": _CORE
    + """, sizes AS (SELECT owner, count(*) AS n FROM sem GROUP BY 1),
plain AS (
  SELECT p.base_id, p.target_id, row_number() OVER (PARTITION BY p.base_id ORDER BY round(p.shared / (x.n + y.n - p.shared), 6) DESC, p.target_id) AS rk
  FROM pair p JOIN sizes x ON x.owner = p.base_id JOIN sizes y ON y.owner = p.target_id QUALIFY rk <= 10),
u AS (SELECT base_id, target_id, 1 AS w, 0 AS p FROM topk UNION ALL SELECT base_id, target_id, 0, 1 FROM plain),
g AS (SELECT base_id, target_id, max(w) AS w, max(p) AS p FROM u GROUP BY 1, 2)
SELECT n.main, CAST(sum(w) AS BIGINT) AS weighted, CAST(sum(p) AS BIGINT) AS plain, count_if(w = 1 AND p = 1) AS both FROM g JOIN main n ON n.owner = g.base_id GROUP BY 1""",
    "keyword_search": "WITH r AS (SELECT DISTINCT report_no, product_name, concat_ws(' ', product_name, company_name, raw_ingredients) AS h FROM catalog_product_master)\nSELECT DISTINCT report_no, product_name, hits FROM (SELECT *, "
    + " + ".join(f"CAST(contains(h, '{w}') AS INTEGER)" for w in WORDS)
    + " AS hits FROM r) WHERE hits > 0",
    "product_search": f"""WITH RECURSIVE r AS (SELECT DISTINCT report_no, coalesce(product_name, '') AS product_name, {_key('product_name')} AS a, '{"".join(ASKED.split())}' AS b FROM catalog_product_master WHERE report_no IS NOT NULL),
pairs AS (SELECT * FROM r WHERE a <> '' AND NOT contains(a, b)),
{ratio_sql("pairs", "report_no, product_name")},
f AS (SELECT report_no, product_name, a, 2 AS tier, ratio FROM ratios WHERE ratio >= 0.55 UNION ALL SELECT report_no, product_name, a, CASE WHEN a = b THEN 0 ELSE 1 END, 1.0 FROM r WHERE contains(a, b))
SELECT report_no, product_name, tier, CAST(ratio AS DOUBLE) AS ratio FROM f ORDER BY tier, ratio DESC, len(a), product_name, report_no LIMIT 20""",
    "entry_batches": """WITH n AS (SELECT functional_ingredient_name AS name, row_number() OVER (ORDER BY functional_ingredient_name) AS n FROM functional_category_map)
SELECT CAST((n - 1) // 25 AS BIGINT) AS batch_no, count(*) AS items, printf('%03d-%03d', min(n), max(n)) AS label, string_agg(name, '|' ORDER BY name) AS names FROM n GROUP BY 1""",
    "upload_dedupe": """SELECT product_id, nullif(profile_signature, '') AS profile_signature FROM uploaded_product_master WHERE is_candidate_enabled
QUALIFY coalesce(profile_signature, '') = '' OR row_number() OVER (PARTITION BY profile_signature ORDER BY updated_at DESC, product_id DESC) = 1""",
    "standard_summary": f"""WITH r AS (SELECT {_key('matched_standard_name')} AS name_key, confidence, nullif(match_method, '') AS m, raw_ingredient AS raw FROM {INGREDIENTS} WHERE matched_standard_name <> ''),
d AS (SELECT name_key, raw, row_number() OVER (PARTITION BY name_key ORDER BY raw) AS i FROM (SELECT DISTINCT name_key, raw FROM r WHERE raw IS NOT NULL)),
f AS (SELECT name_key, string_agg(raw, chr(10) ORDER BY i) AS raws FROM d WHERE i <= 8 GROUP BY 1),
s AS (SELECT name_key, round(max(confidence), 6) AS confidence, coalesce(string_agg(DISTINCT m, ',' ORDER BY m), '') AS methods FROM r GROUP BY 1)
SELECT s.name_key, confidence, methods, raws FROM s LEFT JOIN f ON s.name_key = f.name_key""",
    "upload_warnings": f"""SELECT quality_grade, warning, count(*) AS n FROM (SELECT quality_grade, unnest(list_distinct({_JSON.format('quality_warnings_json')})) AS warning FROM uploaded_product_master) GROUP BY 1, 2""",
    "explanation_fields": f"""SELECT json_extract_string(e, '$.top') AS top, count(*) AS pairs, CAST(sum(CAST(json_extract_string(e, '$.n') AS BIGINT)) AS BIGINT) AS n
FROM (SELECT CASE WHEN json_valid(explanation_json) THEN explanation_json END AS e FROM {CACHE}) GROUP BY 1""",
    "token_overlap": f"""WITH a AS (SELECT DISTINCT lower(matched_standard_name) AS name, {_key('lower(matched_standard_name)')} AS k FROM {INGREDIENTS} WHERE matched_standard_name <> ''),
b AS (SELECT functional_ingredient_name AS entry, {_key('functional_ingredient_name')} AS e, lower(functional_ingredient_name) || ' ' || lower(regexp_extract(coalesce(notes, ''), '{FOREIGN}', 1)) AS w FROM functional_category_map),
x AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(name, '[^0-9a-z가-힣]+')), lambda w: length(w) > 1) AS ws FROM a),
y AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(w, '[^0-9a-z가-힣]+')), lambda w: length(w) > 1) AS ws FROM b),
s AS (SELECT name, entry, 1.7 * len(list_intersect(x.ws, y.ws)) + CASE WHEN k = e THEN 12 WHEN length(k) >= 4 AND length(e) >= 4 AND (contains(k, e) OR contains(e, k)) THEN 7 ELSE 0 END
  + CASE WHEN length(k) >= 4 AND length(e) >= 4 AND left(k, 4) = left(e, 4) THEN 0.8 ELSE 0 END AS score FROM x, y)
SELECT name, entry, CAST(round(score, 6) AS DOUBLE) AS score FROM s WHERE score > 0""",
    "pair_feature_sums": f"""WITH f AS (SELECT coalesce(substitutability, '-') AS u, {_SCORE.format('similarity_score')} AS s, {_SCORE.format('core_match_score')} AS c, len({_JSON.format('shared_ingredients_json')}) AS a,
  len({_JSON.format('base_only_ingredients_json')}) AS b, len({_JSON.format('target_only_ingredients_json')}) AS t FROM {CACHE})
SELECT u AS substitutability, count(*) AS n, round(avg(s), 5) AS similarity, round(avg(a), 5) AS shared, round(avg(CASE WHEN a + b + t = 0 THEN 0 ELSE a / (a + b + t) END), 5) AS shared_share, count_if(c < 0.4) AS weak_core FROM f GROUP BY 1""",
}
