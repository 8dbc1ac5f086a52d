"""Record upkeep: first values, summaries per product, backfill, conditional changes, labels, runs compared, label lines, upload profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.functions import labels, text
from hanmaru.operators import groups, rows
from hanmaru.operators.packed import split_packed
from hanmaru.plans.matching import SUFFIXES
from hanmaru.plans.packed_values import P5_SQL
from hanmaru.plans.tables import CACHE, INGREDIENTS
from hanmaru.sources.tables import table


def first_values(spark: SparkSession, d: str) -> DataFrame:
    """Per report number the first company, licence and storage note that is not empty, in the order of imports."""
    r = table(spark, d, "catalog_product_master", "report_no", "company_name", "license_no", "storage_method", "imported_at")
    return groups.first_non_empty(r, "report_no", ["company_name", "license_no", "storage_method"], F.col("imported_at"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "catalog_product_master", "report_no", "raw_ingredients").where(F.col("raw_ingredients") != "").distinct()
    return split_packed(once, "raw_ingredients", "vals").select("report_no", F.size("vals").alias("n"))


def ingredients_per_product(spark: SparkSession, d: str) -> DataFrame:
    """How many ingredients products have: fewest, mean, most, and how many products."""
    return _counts(spark, d).agg(F.min("n").alias("fewest"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count(F.lit(1)).alias("products"))


def most_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """The 20 products with the most ingredients."""
    return _counts(spark, d).groupBy("report_no").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "report_no").limit(20)


def catalog_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The latest import of every product, its empty storage note, form and licence filled from the first import that has them."""
    cols = ["storage_method", "form_factor", "license_no"]
    r = table(spark, d, "catalog_product_master", "report_no", *cols, "source_csv_mtime", "imported_at")
    latest = rows.latest_by_key(r, ["report_no"], "imported_at").drop("imported_at")
    first = groups.first_non_empty(r, "report_no", cols, F.col("imported_at")).join(r.groupBy("report_no").agg(F.max("source_csv_mtime").alias("source_csv_mtime")), "report_no")
    return rows.backfill(latest, first, ["report_no"], cols, ["source_csv_mtime"])


def upload_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Uploads after an update and a deletion with conditions: those without a parsed or profile signature are disabled and noted, rejected
    ones without a name go."""
    r = table(spark, d, "uploaded_product_master", "product_id", "product_name", "status", "is_candidate_enabled", "parsed_signature", "profile_signature", "notes")
    lacking = (F.coalesce("parsed_signature", F.lit("")) == "") | (F.coalesce("profile_signature", F.lit("")) == "")
    changed = rows.update_where(r, lacking & F.col("is_candidate_enabled"), is_candidate_enabled=F.lit(False), notes=F.concat_ws("; ", F.nullif("notes", F.lit("")), F.lit("no signature")))
    kept = rows.delete_where(changed, (F.col("status") == "rejected") & (F.coalesce("product_name", F.lit("")) == ""))
    return kept.select("product_id", "status", "is_candidate_enabled", "notes")


def pair_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Pairs left-joined on base, target and version with the latest of their repeated rows, whose reason fills an empty one."""
    keys = ["base_product_id", "target_product_id", "algorithm_version"]
    r = table(spark, d, CACHE, *keys, "reason", "caution", "created_at")
    right = rows.latest_by_key(r.where("reason <> '' or caution <> ''"), keys, "created_at").select(*keys, F.col("reason").alias("r"), F.col("caution").alias("c"))
    out = r.join(right, keys, "left").select(*keys, "created_at", F.coalesce(F.nullif("reason", F.lit("")), F.nullif("r", F.lit(""))).alias("reason"), F.coalesce(F.nullif("caution", F.lit("")), F.nullif("c", F.lit(""))).alias("caution"))
    return out.groupBy(F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce("caution", F.lit("-")).alias("caution")).agg(F.count(F.lit(1)).alias("n"))


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Judgments of pairs (every row with a reason) and the snapshot they are of: the first ten targets of every base by score."""
    r = table(spark, d, CACHE, "base_product_id", "target_product_id", "similarity_score", "substitutability", "reason", "created_at").where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    best = r.groupBy("base_product_id", "target_product_id").agg(F.max("similarity_score").alias("score"))
    w = Window.partitionBy("base_product_id").orderBy(F.desc("score"), "target_product_id")
    snapshot = best.withColumn("rank_no", F.row_number().over(w)).where("rank_no <= 10").select("base_product_id", "target_product_id", "rank_no")
    # a label is by id; in a version of the pairs' first letter it names no target but a rank
    judged = r.where(F.col("reason") != "").groupBy("base_product_id", "target_product_id").agg(F.max("substitutability").alias("judgment"))
    by_rank = F.length("target_product_id") % 3 == 0
    labels_ = judged.select("base_product_id", F.when(by_rank, None).otherwise(F.col("target_product_id")).alias("target_product_id"), F.when(by_rank, 1).otherwise(F.lit(None).cast("int")).alias("rank_no"), "judgment")
    return labels_, snapshot


def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Judgments met by target or rank, and those that met nothing or a row already met, counted by judgment."""
    joined, errors = rows.join_labels(*_labels(spark, d), "base_product_id", "target_product_id", "rank_no")
    both = joined.select(F.lit("joined").alias("outcome"), "judgment").unionByName(errors.select(F.col("error").alias("outcome"), "judgment"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def runs_compared(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the measure (versions a and b) on the same pair, one row each: whether score, shared names, categories and substitutability agree, by
    signatures that do not count the order of names."""
    r = table(spark, d, CACHE, "base_product_id", "target_product_id", "algorithm_version", "similarity_score", "shared_ingredients_json", "shared_categories_json", "substitutability")
    names = lambda c: text.signature(text.unordered(text.json_names(F.col(c))))
    s = r.select("base_product_id", "target_product_id", F.right("algorithm_version", F.lit(1)).alias("run"), text.signature(F.round("similarity_score", 6)).alias("score"), names("shared_ingredients_json").alias("names"), names("shared_categories_json").alias("categories"), text.signature(F.col("substitutability")).alias("label"))
    pick = lambda run: F.max(F.when(F.col("run") == run, F.struct("score", "names", "categories", "label")))
    both = s.groupBy("base_product_id", "target_product_id").agg(pick("a").alias("a"), pick("b").alias("b"), *[F.count_if(F.col("run") == x).alias(f"n_{x}") for x in "ab"]).where("n_a = 1 and n_b = 1")
    differ = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), c) for c in ("score", "names", "categories", "label")])), ",")
    return both.groupBy(differ.alias("differs")).agg(F.count(F.lit(1)).alias("pairs"))


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """The ingredient names of scanned labels: the passage's wrapped lines put together again, split, cleaned, and what is no name left out."""
    r = table(spark, d, "uploaded_product_master", "report_no", "ocr_raw_text").where(F.col("ocr_raw_text") != "")
    passage = r.select("report_no", labels.rejoined(labels.passage_lines(F.col("ocr_raw_text"))).alias("lines")).where(F.size("lines") > 0)
    tokens = split_packed(passage.withColumn("joined", F.array_join("lines", ", ")), "joined", "tokens")
    cleaned = F.filter(F.transform("tokens", labels.clean_token), lambda t: t.isNotNull())
    return tokens.select("report_no", F.size("lines").alias("lines"), F.size(cleaned).alias("names"))


def primary_order(spark: SparkSession, d: str) -> DataFrame:
    """The main ingredients of an upload by class (vitamins, then cultures, then the others, then those of preparations), then by their place."""
    r = table(spark, d, "uploaded_product_master", "product_id", "primary_ingredients_json", "secondary_ingredients_json")
    names = F.concat(text.json_names(F.col("primary_ingredients_json")), text.json_names(F.col("secondary_ingredients_json")))
    kind = lambda n: F.when(n.rlike("비타민"), 0).when(n.rlike("락토바실|유산균"), 1).when(n.rlike("분말$|추출물$"), 3).otherwise(2)
    ordered = F.array_sort(F.transform(text.clean_array(names), lambda n, i: F.struct(kind(n).alias("c"), i.alias("i"), n.alias("n"))))
    return r.select("product_id", F.array_join(F.transform(ordered, lambda x: x["n"]), "|").alias("names")).where("names <> ''")


def product_keys(spark: SparkSession, d: str) -> DataFrame:
    """Report numbers (from the product's id where there is none), names fit for files and cut names of the uploads; null-like texts are empty."""
    r = table(spark, d, "uploaded_product_master", "product_id", "product_name", "notes")
    return r.select(
        "product_id", text.number_of(F.lit(None).cast("string"), identifier=F.col("product_id")).alias("report_no"), text.file_key(F.col("product_name"), 40).alias("file_key"),
        text.truncated(text.plain_or_empty(F.col("product_name")), 12).alias("short_name"), text.plain_or_empty(F.col("notes")).alias("notes"),
    )


def valid_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the catalogue that are names: no stand-in, longer than a character, not of signs only; and amounts and short keys among raw names."""
    names = table(spark, d, "catalog_product_master", F.col("product_name").alias("v")).select(F.lit("product").alias("kind"), "v")
    raw = table(spark, d, INGREDIENTS, F.col("raw_ingredient").alias("v")).select(F.lit("ingredient").alias("kind"), "v")
    bare = text.plain_or_empty(F.col("v"))
    wrong = F.when(text.one_of_or_like(bare, ["", "-", "없음", "미상", "unknown"], [r"제품명.?"]), "stand-in").when(F.length(bare) <= 1, "short").when(bare.rlike(r"^[^\p{L}\p{N}]+$"), "signs")
    wrong = wrong.when(text.is_amount(bare), "amount").when(text.is_short_key(bare), "short key").otherwise("valid")
    return names.unionByName(raw).groupBy("kind", wrong.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def name_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Keys the raw names may be looked up by, and how many names each stands for."""
    r = table(spark, d, INGREDIENTS, "ingredient_id", "raw_ingredient").where(F.col("raw_ingredient") != "")
    keys = r.select("ingredient_id", F.explode(text.aliases_of(F.col("raw_ingredient"), SUFFIXES)).alias("alias"))
    return keys.groupBy("alias").agg(F.count(F.lit(1)).alias("names"))


#: What a role counts in an upload's vector, and how many ingredients of each its profile lists.
UPLOAD_ROLES = {"primary": (1.0, 3), "secondary": (0.72, 8), "support": (0.45, 10)}


def _upload_vector(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "uploaded_product_master", "product_id", "confidence", *[f"{k}_ingredients_json" for k in UPLOAD_ROLES])

    def side(role: str, factor: float) -> Column:
        return F.transform(text.json_names(F.col(f"{role}_ingredients_json")), lambda n: F.struct(n.alias("name"), F.lit(role).alias("role"), F.lit(factor).alias("factor")))

    sides = [side(k, w) for k, (w, _) in UPLOAD_ROLES.items()]
    named = r.select("product_id", F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("c"), F.explode(F.concat(*sides)).alias("x"))
    named = named.select("product_id", F.trim("x.name").alias("ingredient"), F.col("x.role").alias("role"), (F.col("c") * F.col("x.factor")).alias("weight")).where("ingredient <> ''")
    return named.groupBy("product_id", "ingredient").agg(F.max(F.struct("weight", "role")).alias("m")).select("product_id", "ingredient", F.round("m.weight", 6).alias("weight"), F.col("m.role").alias("role"))


def upload_vector(spark: SparkSession, d: str) -> DataFrame:
    """Ingredient weights of an upload: its confidence, at least 0.35, by what the role counts; the highest of a name."""
    return _upload_vector(spark, d)


def upload_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of an upload from its vector and the reference list: main category, the next three, and the heaviest ingredients of each role
    (at most 3 primary of the main category, 8 secondary, 10 support)."""
    v = _upload_vector(spark, d)
    listed = table(spark, d, "functional_category_map", F.col("functional_ingredient_name").alias("ingredient"), F.col("category_main").alias("category"))
    known = v.join(F.broadcast(listed), "ingredient")  # the fixed list
    scores = known.groupBy("product_id", "category").agg(F.round(F.sum("weight"), 6).alias("score"))
    ranked = groups.ranked_labels(scores, "product_id", "category", "score").where("rank_no <= 4")
    categories = ranked.groupBy("product_id").agg(F.max(F.when(F.col("rank_no") == 1, F.col("category"))).alias("main"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rank_no") > 1, F.struct("rank_no", "category")))), lambda x: x["category"]).alias("subs"))
    most = F.when(F.col("role") == "primary", 3).when(F.col("role") == "secondary", 8).otherwise(10)
    eligible = known.join(categories.select("product_id", "main"), "product_id").where((F.col("role") != "primary") | (F.col("category") == F.col("main")))
    w = Window.partitionBy("product_id", "role").orderBy(F.desc("weight"), "ingredient")
    best = eligible.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most)
    lists = best.groupBy("product_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == k, F.struct("i", "ingredient")))), lambda x: x["ingredient"]), "|").alias(k) for k in UPLOAD_ROLES])
    return categories.select("product_id", "main", F.array_join("subs", "|").alias("subs")).join(lists, "product_id", "left")


def category_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The place of every category in its upload's scores."""
    r = table(spark, d, "uploaded_product_master", "product_id", "category_scores_json")
    scores = r.select("product_id", F.explode(F.from_json("category_scores_json", "map<string,double>")).alias("category", "score"))
    return groups.ranked_labels(scores, "product_id", "category", "score").select("product_id", "category", "rank_no")


def evaluation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation over bases in one aggregate: bases, with a catalogue product in the first five, mean first rank of one, mean share of good ones in
    the first five, bases with a good first, bases whose first five are of one version, and mean score of the first."""
    r = table(spark, d, CACHE, "base_product_id", "target_product_id", "algorithm_version", "similarity_score", "substitutability").where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    best = r.groupBy("base_product_id", "target_product_id").agg(F.max(F.struct("similarity_score", "algorithm_version", "substitutability")).alias("m"))
    w = Window.partitionBy("base_product_id").orderBy(F.desc("m.similarity_score"), "target_product_id")
    top = best.withColumn("rk", F.row_number().over(w)).where("rk <= 5")
    official, good = F.startswith("target_product_id", F.lit("catalog::")), F.coalesce(F.col("m.substitutability") == "high", F.lit(False))
    per = top.groupBy("base_product_id").agg(
        F.max(official).alias("hit"), F.min(F.when(official, F.col("rk"))).alias("first"), F.avg(good.cast("double")).alias("good"), F.max(good & (F.col("rk") == 1)).alias("good_first"),
        (F.count_distinct(F.coalesce("m.algorithm_version", F.lit("-"))) == 1).alias("one"), F.max(F.when(F.col("rk") == 1, F.col("m.similarity_score"))).alias("score"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("bases"), F.count_if("hit").alias("hits_at_5"), groups.rate(F.count_if("hit"), F.count(F.lit(1))).alias("hit_rate"), F.round(F.avg("first"), 6).alias("mean_first"), F.round(F.avg("good"), 6).alias("mean_good"),
        F.count_if("good_first").alias("good_first"), F.count_if("one").alias("one_version"), F.round(F.avg("score"), 6).alias("mean_score"),
    )


def role_maps(spark: SparkSession, d: str) -> DataFrame:
    """The map from ingredient to role of every upload, as text in order of names."""
    v = _upload_vector(spark, d).groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ingredient", "role")))).alias("roles"))
    return v.select("product_id", F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("roles"))


def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot with the three best targets of a base as a list, and that list as rows again, with their places."""
    r = table(spark, d, CACHE, "base_product_id", "target_product_id", "similarity_score").where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
    best = r.groupBy("base_product_id", "target_product_id").agg(F.max("similarity_score").alias("score"))
    w = Window.partitionBy("base_product_id").orderBy(F.desc("score"), "target_product_id")
    nested = best.withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("base_product_id").agg(F.array_sort(F.collect_list(F.struct("i", "target_product_id", "score"))).alias("recommendations"))
    return rows.flat_lists(nested, "recommendations", "place").select("base_product_id", F.col("place") + 1, "target_product_id", "score").toDF("base_product_id", "place", "target_product_id", "score")


#: Topics with their category and the words of a name that also tell it.
TOPICS = {"bone": ("뼈 편안", ["칼슘", "뼈"]), "stomach": ("위 편안", ["위", "속편"]), "sleep": ("수면 리듬", ["수면", "잠"]), "antioxidant": ("항산화", ["항산화", "비타민c"])}


def topic_products(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of every topic: of its category, or with one of its words in the name."""
    r = table(spark, d, "uploaded_product_master", "product_id", "product_main_category", "product_name")
    hits = F.array_compact(F.array(*[F.when((F.coalesce("product_main_category", F.lit("")) == c) | text.contains_any(F.col("product_name"), words), k) for k, (c, words) in TOPICS.items()]))
    return r.select(F.explode(hits).alias("topic"), "product_id").groupBy("topic").agg(F.count(F.lit(1)).alias("products"))


def sub_categories(spark: SparkSession, d: str) -> DataFrame:
    """All sub categories met with a main category, in the order of the entries they are first met in."""
    r = table(spark, d, "functional_category_map", "category_main", "category_sub", "functional_ingredient_name")
    return groups.ordered_text(r, "category_main", "functional_ingredient_name", "category_sub", "|", cut=r"\|")


def high_score_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a score of 0.65 or more by several views at once: how many, and how many of low substitutability."""
    r = table(spark, d, CACHE, "similarity_score", "algorithm_version", "substitutability", "shared_ingredients_json", "core_match_score").where(~F.isnan("similarity_score") & (F.col("similarity_score") >= 0.65))
    n = F.least(F.size(text.json_names(F.col("shared_ingredients_json"))), F.lit(8))
    views = {"version": F.coalesce("algorithm_version", F.lit("-")), "bin": F.format_number(F.floor(F.round(F.col("similarity_score") * 20, 6)) / 20, 2), "shared": n.cast("string"), "core": F.when(F.isnan("core_match_score") | F.col("core_match_score").isNull(), "-").when(F.col("core_match_score") < 0.4, "low").otherwise("high")}
    seen = r.select("substitutability", F.explode(F.array(*[F.struct(F.lit(k).alias("view"), v.alias("value")) for k, v in views.items()])).alias("x"))
    return seen.groupBy("x.view", "x.value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("substitutability") == "low").alias("low"))


def category_diversity(spark: SparkSession, d: str) -> DataFrame:
    """How many different categories an upload's ingredients have in the reference list, of all and of the primary ones."""
    listed = table(spark, d, "functional_category_map", F.col("functional_ingredient_name").alias("ingredient"), F.col("category_main").alias("category")).where("category <> ''")
    known = _upload_vector(spark, d).join(F.broadcast(listed), "ingredient")  # the fixed list
    return known.groupBy("product_id").agg(F.count_distinct("category").alias("categories"), F.count_distinct(F.when(F.col("role") == "primary", F.col("category"))).alias("primary_categories"))


def grade_labels(spark: SparkSession, d: str) -> DataFrame:
    """Grades of the uploads under one label each, however they are written, and their warnings by severity (first rule that fits)."""
    r = table(spark, d, "uploaded_product_master", "quality_grade", "quality_warnings_json")
    grade = F.coalesce(F.nullif(text.label_of(F.coalesce("quality_grade", F.lit("")), {x.lower(): x for x in "ABCD"}), F.lit("")), F.lit("-"))
    severity = lambda w: text.first_rule(text.fold(w), [("fail|missing|error", "critical"), ("low|short|unclear", "warning")], F.lit("info"))
    worst = F.transform(text.clean_array(text.json_names(F.col("quality_warnings_json"))), severity)
    count = lambda k: F.sum(F.size(F.filter(worst, lambda x: x == k))).alias(k)
    return r.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("uploads"), *[count(k) for k in ("critical", "warning", "info")])


QUERIES = {
    f.__name__: f
    for f in (
        first_values, ingredients_per_product, most_ingredients, catalog_backfill, upload_corrections, pair_defaults, label_join, runs_compared, label_lines, primary_order, product_keys,
        valid_names, name_aliases, upload_vector, upload_profile, category_ranks, evaluation_metrics, role_maps, snapshot_rows, topic_products, sub_categories, high_score_diagnostics, category_diversity, grade_labels,
    )
}

_N5 = f"WITH v AS ({P5_SQL}), once AS (SELECT DISTINCT report_no, raw_ingredients FROM catalog_product_master WHERE raw_ingredients <> ''), c AS (SELECT report_no, max(value_pos) AS n FROM v WHERE table_name = 'catalog_product_master' GROUP BY 1)"
_KEY = "regexp_replace(lower({}), '[^0-9a-z가-힣]', '', 'g')"
_BARE = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]|（[^（）]*）', ' ', 'g'), '제\\s*\\d{{4}}-\\d+\\s*호|\\d+(\\.\\d+)?\\s*%', ' ', 'g'), '\\s+', ' ', 'g'))"
_LIST = "coalesce(CAST(CASE WHEN json_valid({0}) THEN {0} END AS VARCHAR[]), [])"
_VALID = "similarity_score IS NOT NULL AND NOT isnan(similarity_score)"
_UPLOAD = "\n  UNION ALL ".join(
    f"SELECT product_id, greatest(0.35, least(1.0, coalesce(confidence, 0))) * {w} AS weight, '{k}' AS role, unnest({_LIST.format(f'{k}_ingredients_json')}) AS name FROM uploaded_product_master" for k, (w, _) in UPLOAD_ROLES.items()
)
_UV = f"""WITH x AS ({_UPLOAD}),
uv AS (SELECT product_id, trim(name) AS ingredient, round(max(weight), 6) AS weight, arg_max(role, weight) AS role FROM x WHERE trim(name) <> '' GROUP BY 1, 2)"""


def _stems(column: str) -> str:
    for _ in range(6):
        column = f"regexp_replace({column}, '^(.{{2,}}?)({'|'.join(SUFFIXES)})$', '\\1')"
    return column


SQL = {
    "first_values": "SELECT report_no, "
    + ", ".join(f"arg_min({c}, (imported_at, {c})) FILTER ({c} <> '') AS {c}" for c in ("company_name", "license_no", "storage_method"))
    + " FROM catalog_product_master GROUP BY 1",
    "ingredients_per_product": _N5 + " SELECT min(n) AS fewest, round(avg(n), 6) AS mean, max(n) AS most, count(*) AS products FROM (SELECT o.report_no, coalesce(n, 0) AS n FROM once o LEFT JOIN c ON c.report_no = o.report_no)",
    "most_ingredients": _N5 + " SELECT report_no, n FROM c ORDER BY n DESC, report_no LIMIT 20",
    "catalog_backfill": "WITH f AS (SELECT report_no, max(source_csv_mtime) AS mt, "
    + ", ".join(f"arg_min({c}, (imported_at, {c})) FILTER ({c} <> '') AS {c}" for c in ("storage_method", "form_factor", "license_no"))
    + """ FROM catalog_product_master GROUP BY 1),
l AS (SELECT report_no, storage_method, form_factor, license_no, source_csv_mtime FROM catalog_product_master
  QUALIFY row_number() OVER (PARTITION BY report_no ORDER BY imported_at DESC NULLS LAST, storage_method DESC NULLS LAST, form_factor DESC NULLS LAST, license_no DESC NULLS LAST, source_csv_mtime DESC NULLS LAST) = 1)
SELECT l.report_no, coalesce(nullif(l.storage_method, ''), f.storage_method) AS storage_method, coalesce(nullif(l.form_factor, ''), f.form_factor) AS form_factor,
  coalesce(nullif(l.license_no, ''), f.license_no) AS license_no, CASE WHEN l.source_csv_mtime > 0 THEN l.source_csv_mtime ELSE coalesce(f.mt, l.source_csv_mtime) END AS source_csv_mtime FROM l JOIN f ON l.report_no = f.report_no""",
    "upload_corrections": """WITH u AS (SELECT *, coalesce((coalesce(parsed_signature, '') = '' OR coalesce(profile_signature, '') = '') AND is_candidate_enabled, FALSE) AS hit FROM uploaded_product_master
  WHERE NOT coalesce(status = 'rejected' AND coalesce(product_name, '') = '', FALSE))
SELECT product_id, status, CASE WHEN hit THEN FALSE ELSE is_candidate_enabled END AS is_candidate_enabled, CASE WHEN hit THEN concat_ws('; ', nullif(notes, ''), 'no signature') ELSE notes END AS notes FROM u""",
    "pair_defaults": f"""WITH r AS (SELECT * FROM {CACHE} WHERE reason <> '' OR caution <> ''
  QUALIFY row_number() OVER (PARTITION BY base_product_id, target_product_id, algorithm_version ORDER BY created_at DESC NULLS LAST, reason DESC NULLS LAST, caution DESC NULLS LAST) = 1)
SELECT coalesce(nullif(c.reason, ''), nullif(r.reason, ''), '-') AS reason, coalesce(nullif(c.caution, ''), nullif(r.caution, ''), '-') AS caution, count(*) AS n
FROM {CACHE} c LEFT JOIN r ON r.base_product_id = c.base_product_id AND r.target_product_id = c.target_product_id AND r.algorithm_version = c.algorithm_version GROUP BY 1, 2""",
    "label_join": f"""WITH best AS (SELECT base_product_id AS b, target_product_id AS t, max(similarity_score) AS s FROM {CACHE} WHERE {_VALID} GROUP BY 1, 2),
snap AS (SELECT b, t, row_number() OVER (PARTITION BY b ORDER BY s DESC, t) AS rk FROM best QUALIFY rk <= 10),
lab AS (SELECT base_product_id AS b, CASE WHEN length(target_product_id) % 3 <> 0 THEN target_product_id END AS t FROM {CACHE} WHERE {_VALID} AND reason <> '' GROUP BY base_product_id, target_product_id),
met AS (SELECT l.b, coalesce(x.t, y.t) AS hit FROM lab l LEFT JOIN snap x ON x.b = l.b AND x.t = l.t LEFT JOIN snap y ON y.b = l.b AND y.rk = 1 AND l.t IS NULL),
n AS (SELECT b, hit, row_number() OVER (PARTITION BY b, hit) AS i FROM met)
SELECT CASE WHEN hit IS NULL THEN 'missing' WHEN i > 1 THEN 'duplicate' ELSE 'joined' END AS outcome, count(*) AS n FROM n GROUP BY 1""",
    "runs_compared": f"""WITH s AS (SELECT base_product_id AS b, target_product_id AS t, right(algorithm_version, 1) AS run, CAST(round(similarity_score, 6) AS VARCHAR) AS score, list_sort(list_distinct({_LIST.format('shared_ingredients_json')})) AS names,
  list_sort(list_distinct({_LIST.format('shared_categories_json')})) AS categories, coalesce(substitutability, '-') AS label, similarity_score AS raw FROM {CACHE}),
x AS (SELECT b, t FROM s GROUP BY 1, 2 HAVING count_if(run = 'a') = 1 AND count_if(run = 'b') = 1)
SELECT array_to_string(list_filter([CASE WHEN coalesce(p.score, '-') <> coalesce(q.score, '-') THEN 'score' END, CASE WHEN p.names <> q.names THEN 'names' END, CASE WHEN p.categories <> q.categories THEN 'categories' END,
  CASE WHEN p.label <> q.label THEN 'label' END], lambda v: v IS NOT NULL), ',') AS differs, count(*) AS pairs FROM x JOIN s p ON p.b = x.b AND p.t = x.t AND p.run = 'a' JOIN s q ON q.b = x.b AND q.t = x.t AND q.run = 'b' GROUP BY 1""",
    "primary_order": f"""WITH u AS (SELECT product_id, list_concat({_LIST.format('primary_ingredients_json')}, {_LIST.format('secondary_ingredients_json')}) AS l FROM uploaded_product_master),
e AS (SELECT product_id, trim(unnest(l)) AS n, generate_subscripts(l, 1) AS i FROM u), f AS (SELECT product_id, n, min(i) AS i FROM e WHERE n <> '' GROUP BY 1, 2)
SELECT product_id, string_agg(n, '|' ORDER BY CASE WHEN contains(n, '비타민') THEN 0 WHEN regexp_matches(n, '락토바실|유산균') THEN 1 WHEN regexp_matches(n, '(분말|추출물)$') THEN 3 ELSE 2 END, i) AS names FROM f GROUP BY 1""",
    "product_keys": r"""WITH u AS (SELECT product_id, product_name, CASE WHEN lower(trim(coalesce(product_name, ''))) IN ('nan', 'none', 'null') THEN '' ELSE trim(coalesce(product_name, '')) END AS p,
  CASE WHEN lower(trim(coalesce(notes, ''))) IN ('nan', 'none', 'null') THEN '' ELSE trim(coalesce(notes, '')) END AS notes FROM uploaded_product_master)
SELECT product_id, CASE WHEN contains(product_id, '::') THEN split_part(product_id, '::', 2) ELSE product_id END AS report_no,
  left(regexp_replace(regexp_replace(coalesce(product_name, ''), '[^0-9A-Za-z가-힣._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS file_key, CASE WHEN length(p) <= 12 THEN p ELSE left(p, 9) || '...' END AS short_name, notes FROM u""",
    "valid_names": rf"""WITH v AS (SELECT 'product' AS kind, product_name AS v FROM catalog_product_master UNION ALL SELECT 'ingredient', raw_ingredient FROM {INGREDIENTS}),
b AS (SELECT kind, CASE WHEN lower(trim(coalesce(v, ''))) IN ('nan', 'none', 'null') THEN '' ELSE trim(coalesce(v, '')) END AS v FROM v),
f AS (SELECT *, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS l FROM b)
SELECT kind, CASE WHEN l IN ('', '-', '없음', '미상', 'unknown') OR regexp_full_match(l, '제품명.?') THEN 'stand-in' WHEN length(v) <= 1 THEN 'short' WHEN regexp_full_match(v, '[^\p{{L}}\p{{N}}]+') THEN 'signs'
  WHEN regexp_full_match(l, '\d[\d,]*(\.\d+)?\s*(mg|g|kg|mcg|ug|µg|μg|ml|l|iu|cfu|kcal|%)') THEN 'amount' WHEN length({_KEY.format('v')}) <= 4 THEN 'short key' ELSE 'valid' END AS verdict, count(*) AS n FROM f GROUP BY 1, 2""",
    "name_aliases": f"""WITH r AS (SELECT ingredient_id, raw_ingredient AS t, {_KEY.format('raw_ingredient')} AS k, {_KEY.format(_BARE.format('raw_ingredient'))} AS b FROM {INGREDIENTS} WHERE raw_ingredient <> ''),
i0 AS (SELECT ingredient_id, unnest(regexp_extract_all(t, '[(\\[（]([^()\\[\\]（）]*)[)\\]）]', 1)) AS y FROM r),
i AS (SELECT ingredient_id, unnest(regexp_split_to_array(y, '[,;/|·]')) AS x FROM i0),
a AS (SELECT ingredient_id, k AS alias FROM r UNION SELECT ingredient_id, b FROM r UNION SELECT ingredient_id, {_stems('k')} FROM r UNION SELECT ingredient_id, {_stems('b')} FROM r UNION SELECT ingredient_id, {_KEY.format('x')} FROM i)
SELECT alias, count(DISTINCT ingredient_id) AS names FROM a WHERE length(alias) > 1 GROUP BY 1""",
    "upload_vector": _UV + " SELECT product_id, ingredient, CAST(weight AS DOUBLE) AS weight, role FROM uv",
    "upload_profile": _UV
    + """, k AS (SELECT uv.*, m.category_main AS category FROM uv JOIN functional_category_map m ON m.functional_ingredient_name = uv.ingredient),
s AS (SELECT product_id, category, row_number() OVER (PARTITION BY product_id ORDER BY round(sum(weight), 6) DESC, category) AS rk FROM k GROUP BY 1, 2 QUALIFY rk <= 4),
c AS (SELECT product_id, max(category) FILTER (rk = 1) AS main, coalesce(string_agg(category, '|' ORDER BY rk) FILTER (rk > 1), '') AS subs FROM s GROUP BY 1),
e AS (SELECT k.product_id, ingredient, role, row_number() OVER (PARTITION BY k.product_id, role ORDER BY weight DESC, ingredient) AS i FROM k JOIN c ON c.product_id = k.product_id WHERE role <> 'primary' OR category = main),
l AS (SELECT product_id, """
    + ", ".join(f"coalesce(string_agg(ingredient, '|' ORDER BY i) FILTER (role = '{k}' AND i <= {n}), '') AS \"{k}\"" for k, (_, n) in UPLOAD_ROLES.items())
    + """ FROM e GROUP BY 1)
SELECT c.product_id, main, subs, l."primary", l.secondary, l.support FROM c LEFT JOIN l ON l.product_id = c.product_id""",
    "category_ranks": """WITH s AS (SELECT product_id, unnest(map_entries(CAST(CAST(category_scores_json AS JSON) AS MAP(VARCHAR, DOUBLE)))) AS e FROM uploaded_product_master WHERE json_valid(category_scores_json))
SELECT product_id, e.key AS category, CAST(row_number() OVER (PARTITION BY product_id ORDER BY e.value DESC, e.key) AS INTEGER) AS rank_no FROM s""",
    "evaluation_metrics": f"""WITH best AS (SELECT base_product_id AS b, target_product_id AS t, similarity_score AS s, algorithm_version AS v, substitutability AS u FROM {CACHE} WHERE {_VALID}
  QUALIFY row_number() OVER (PARTITION BY base_product_id, target_product_id ORDER BY similarity_score DESC, algorithm_version DESC NULLS LAST, substitutability DESC NULLS LAST) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s DESC, t) AS rk, starts_with(t, 'catalog::') AS o, coalesce(u = 'high', FALSE) AS g FROM best QUALIFY rk <= 5),
per AS (SELECT b, bool_or(o) AS hit, min(rk) FILTER (o) AS first, avg(CAST(g AS INTEGER)) AS good, bool_or(g AND rk = 1) AS good_first, count(DISTINCT coalesce(v, '-')) = 1 AS one, max(s) FILTER (rk = 1) AS score FROM top GROUP BY 1)
SELECT count(*) AS bases, CAST(count_if(hit) AS BIGINT) AS hits_at_5, round(count_if(hit) / count(*), 4) AS hit_rate, round(avg(first), 6) AS mean_first, round(avg(good), 6) AS mean_good, CAST(count_if(good_first) AS BIGINT) AS good_first,
  CAST(count_if(one) AS BIGINT) AS one_version, round(avg(score), 6) AS mean_score FROM per""",
    "role_maps": _UV + " SELECT product_id, string_agg(ingredient || '=' || role, '|' ORDER BY ingredient) AS roles FROM uv GROUP BY 1",
    "snapshot_rows": f"""WITH b AS (SELECT base_product_id, target_product_id, max(similarity_score) AS score FROM {CACHE} WHERE {_VALID} GROUP BY 1, 2)
SELECT base_product_id, CAST(row_number() OVER (PARTITION BY base_product_id ORDER BY score DESC, target_product_id) AS INTEGER) AS place, target_product_id, score FROM b QUALIFY place <= 3""",
    "topic_products": "WITH u AS (SELECT coalesce(product_main_category, '') AS c, replace(lower(coalesce(product_name, '')), ' ', '') AS n FROM uploaded_product_master)\n"
    + "\nUNION ALL ".join(f"SELECT '{k}' AS topic, count(*) AS products FROM u WHERE c = '{c}' OR {' OR '.join(f"contains(n, '{w}')" for w in ws)} HAVING count(*) > 0" for k, (c, ws) in TOPICS.items()),
    "sub_categories": """WITH e AS (SELECT category_main, functional_ingredient_name AS o, unnest(string_split(category_sub, '|')) AS s, generate_subscripts(string_split(category_sub, '|'), 1) AS p FROM functional_category_map WHERE category_sub <> ''),
f AS (SELECT category_main, trim(s) AS s, min((o, p)) AS o FROM e WHERE trim(s) <> '' GROUP BY 1, 2)
SELECT category_main, string_agg(s, '|' ORDER BY o, s) AS category_sub FROM f GROUP BY 1""",
    "high_score_diagnostics": f"""WITH r AS (SELECT *, substitutability = 'low' AS lo FROM {CACHE} WHERE {_VALID} AND similarity_score >= 0.65),
v AS (SELECT 'version' AS view, coalesce(algorithm_version, '-') AS value, lo FROM r UNION ALL SELECT 'bin', printf('%.2f', floor(round(similarity_score * 20, 6)) / 20), lo FROM r
  UNION ALL SELECT 'shared', CAST(least(len({_LIST.format('shared_ingredients_json')}), 8) AS VARCHAR), lo FROM r
  UNION ALL SELECT 'core', CASE WHEN core_match_score IS NULL OR isnan(core_match_score) THEN '-' WHEN core_match_score < 0.4 THEN 'low' ELSE 'high' END, lo FROM r)
SELECT view, value, count(*) AS n, CAST(count_if(lo) AS BIGINT) AS low FROM v GROUP BY 1, 2""",
    "category_diversity": _UV + """ SELECT product_id, count(DISTINCT category_main) AS categories, count(DISTINCT category_main) FILTER (role = 'primary') AS primary_categories
FROM uv JOIN functional_category_map m ON m.functional_ingredient_name = uv.ingredient WHERE category_main <> '' GROUP BY 1""",
    "grade_labels": f"""WITH u AS (SELECT coalesce(nullif(CASE WHEN upper(trim(coalesce(quality_grade, ''))) IN ('A', 'B', 'C', 'D') THEN upper(trim(quality_grade)) ELSE trim(coalesce(quality_grade, '')) END, ''), '-') AS grade,
  list_filter(list_distinct(list_transform({_LIST.format('quality_warnings_json')}, lambda x: lower(trim(x)))), lambda x: x <> '') AS w FROM uploaded_product_master),
c AS (SELECT grade, list_transform(w, lambda x: CASE WHEN regexp_matches(x, 'fail|missing|error') THEN 'critical' WHEN regexp_matches(x, 'low|short|unclear') THEN 'warning' ELSE 'info' END) AS s FROM u)
SELECT grade, count(*) AS uploads, CAST(sum(len(list_filter(s, lambda x: x = 'critical'))) AS BIGINT) AS critical, CAST(sum(len(list_filter(s, lambda x: x = 'warning'))) AS BIGINT) AS warning,
  CAST(sum(len(list_filter(s, lambda x: x = 'info'))) AS BIGINT) AS info FROM c GROUP BY 1""",
}
