"""Similarity of products as weighted ingredient vectors, bound to orders (products), parts (ingredients) and their lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.operators import groups, vectors
from hanmaru.operators.skew import meet_within
from hanmaru.session import kept_for, write_through
from hanmaru.sources.tables import table

VEC = """vec AS (
  SELECT l_orderkey AS owner, l_partkey AS item, max(0.55 + 0.4 * (l_quantity / 50.0)) AS weight FROM lineitem GROUP BY 1, 2)"""
IMAP = """imap AS (
  SELECT p_partkey AS item, p_type AS category, p_brand AS sub, 0.25 + (p_size % 50) / 70.0 AS conf,
    CASE WHEN p_size % 10 = 0 THEN 'excipient' WHEN p_size % 10 IN (1, 2) THEN 'nutrient' ELSE 'functional' END AS kind FROM part)"""
CAT = """cat AS (
  SELECT v.owner, m.category, sum(v.weight * greatest(0.45, m.conf)) AS score FROM vec v JOIN imap m ON v.item = m.item GROUP BY 1, 2)"""
MAIN = """ranked AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round(score, 9) DESC, category) AS rn FROM cat),
main AS (SELECT owner, category AS main FROM ranked WHERE rn = 1)"""
SEM = """sem AS (
  SELECT v.owner, v.item, n.main, m.kind, CASE WHEN m.kind = 'nutrient' AND m.category = n.main THEN 0.4 WHEN m.kind = 'nutrient' THEN 0.2
    WHEN m.category = n.main THEN 1.0 ELSE 0.3 END AS weight
  FROM vec v JOIN imap m ON v.item = m.item JOIN main n ON v.owner = n.owner WHERE m.kind <> 'excipient')"""
PAIRS = """tot AS (SELECT owner, sum(weight) AS tw FROM sem GROUP BY 1),
pair AS (
  SELECT b.owner AS base_id, t.owner AS target_id, sum(least(b.weight, t.weight)) AS smin, sum(greatest(b.weight, t.weight)) AS smax, sum(b.weight) AS sb, sum(t.weight) AS st,
    count(*) AS shared
  FROM sem b JOIN sem t ON b.item = t.item AND b.main = t.main AND b.owner <> t.owner GROUP BY 1, 2),
scored AS (
  SELECT p.base_id, p.target_id, round(p.smin / (p.smax + (x.tw - p.sb) + (y.tw - p.st)), 6) AS score, p.shared
  FROM pair p JOIN tot x ON p.base_id = x.owner JOIN tot y ON p.target_id = y.owner),
topk AS (
  SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY score DESC, target_id) AS rk FROM scored QUALIFY rk <= 10)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def vec(spark: SparkSession, d: str) -> DataFrame:
    return vectors.max_merge(table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", "l_partkey", 0.55 + 0.4 * (F.col("l_quantity") / 50.0))


def imap(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("p_size") % 10
    return table(spark, d, "part", "p_partkey", "p_type", "p_brand", "p_size").select(
        F.col("p_partkey").alias("item"), F.col("p_type").alias("category"), F.col("p_brand").alias("sub"), (0.25 + (F.col("p_size") % 50) / 70.0).alias("conf"),
        F.when(r == 0, "excipient").when(r.isin(1, 2), "nutrient").otherwise("functional").alias("kind"),
    )


def category_scores_of(spark: SparkSession, d: str) -> DataFrame:
    return vec(spark, d).join(imap(spark, d), "item").groupBy("owner", "category").agg(F.sum(F.col("weight") * F.greatest(F.lit(0.45), F.col("conf"))).alias("score"))


def main_category_of(spark: SparkSession, d: str) -> DataFrame:
    scores = category_scores_of(spark, d).withColumn("score", F.round("score", 9))
    return groups.arg_max(scores, "owner", "category", "score")


def semantic_of(spark: SparkSession, d: str) -> DataFrame:
    main = main_category_of(spark, d).select("owner", F.col("category").alias("main"))
    rows = vec(spark, d).join(imap(spark, d).where("kind <> 'excipient'"), "item").join(main, "owner")
    aligned = F.col("category") == F.col("main")
    weight = F.when((F.col("kind") == "nutrient") & aligned, 0.4).when(F.col("kind") == "nutrient", 0.2).when(aligned, 1.0).otherwise(0.3)
    return rows.select("owner", "item", "main", "kind", weight.alias("weight"))


def _sources(d: str) -> list[str]:
    return [f"{d}/lineitem.parquet", f"{d}/part.parquet"]


def kept_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The semantic vectors, computed once for the files they are made of: the joins of all pairs read them more than once."""
    return kept_for(spark, "semantic", _sources(d), lambda: semantic_of(spark, d))


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    return vectors.weighted_jaccard(kept_semantic(spark, d), "main").withColumn("score", F.round("score", 6))


def top_of(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The k best targets of every base, computed once for the files they are made of; all queries on best pairs read these."""
    return kept_for(spark, f"best-{k}", _sources(d), lambda: vectors.top_pairs(scored_of(spark, d), k, F.desc("score"), F.col("target_id")))


def vector_max_merge(spark: SparkSession, d: str) -> DataFrame:
    return vec(spark, d).select(F.col("owner").alias("product_id"), F.col("item").alias("ingredient"), F.round("weight", 6).alias("weight"))


def document_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    return vectors.idf(vec(spark, d)).select(F.col("item").alias("ingredient"), "df", F.round("idf", 6).alias("idf"))


def category_scores(spark: SparkSession, d: str) -> DataFrame:
    return category_scores_of(spark, d).select(F.col("owner").alias("product_id"), "category", F.round("score", 6).alias("score"))


def product_main_category(spark: SparkSession, d: str) -> DataFrame:
    return main_category_of(spark, d).select(F.col("owner").alias("product_id"), "category", F.round("score", 6).alias("score"), F.round("second_score", 6).alias("second_score"))


def relative_weight(spark: SparkSession, d: str) -> DataFrame:
    """Each weight relative to its product's highest, by an aggregate joined back."""
    v = vec(spark, d)
    top = v.groupBy("owner").agg(F.max("weight").alias("top"))
    return v.join(top, "owner").select(F.col("owner").alias("product_id"), F.col("item").alias("ingredient"), F.round(F.col("weight") / F.col("top"), 6).alias("share_of_top"))


def semantic_vector(spark: SparkSession, d: str) -> DataFrame:
    return semantic_of(spark, d).select(F.col("owner").alias("product_id"), F.col("item").alias("ingredient"), F.col("main").alias("main_category"), "weight")


def nutrient_total_cap(spark: SparkSession, d: str) -> DataFrame:
    sem = semantic_of(spark, d)
    kinds = sem.select("owner", "item", "weight").join(imap(spark, d).select("item", "kind"), "item")
    capped = vectors.cap_share(kinds, F.col("kind") == "nutrient", 0.2)
    return capped.select(F.col("owner").alias("product_id"), F.col("item").alias("ingredient"), F.round("weight", 6).alias("weight"))


def topk_similar(spark: SparkSession, d: str) -> DataFrame:
    return top_of(spark, d).select("base_id", "target_id", "score", "shared", "rk")


def _filled(pool: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(base_id, target_id, pool_score, rk): the k best targets of each base; where fewer share anything with it, products of the same main
    category with the smallest ids follow with a score of 0. At most 2 k + 1 ids of a category can be wanted for that."""
    best = vectors.top_pairs(pool, k, F.desc("pool_score"), F.col("target_id")).drop("rk")
    few = owners.join(best.groupBy(F.col("base_id").alias("owner")).agg(F.count(F.lit(1)).alias("n")), "owner", "left").where(F.coalesce("n", F.lit(0)) < k)
    seeds = owners.withColumn("i", F.row_number().over(Window.partitionBy("main").orderBy("owner"))).where(F.col("i") <= 2 * k + 1).select("main", F.col("owner").alias("target_id"))
    fill = few.select(F.col("owner").alias("base_id"), "main").join(seeds, "main").where("base_id <> target_id").select("base_id", "target_id", F.lit(0.0).alias("pool_score"))
    fill = fill.join(best.select("base_id", "target_id"), ["base_id", "target_id"], "left_anti")
    return vectors.top_pairs(best.unionByName(fill), k, F.desc("pool_score"), F.col("target_id"))


def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """The 20 targets of each base with the highest sum of weight x idf over shared ingredients, filled up with others of the main category.
    Ingredients in more than 5 % of the products count only for products in which they weigh 0.7 or more."""
    sem = kept_semantic(spark, d)
    weighed = sem.join(vectors.idf(vec(spark, d)), "item").select("owner", "item", "main", F.col("weight").alias("plain"), (F.col("weight") * F.col("idf")).alias("weight"))
    met = vectors.shared_items(write_through(weighed, "weighed"), "main", 0.05, once=True, keep=F.col("plain") >= 0.7)
    sums = met.groupBy("base_id", "target_id").agg(F.sum("bw").alias("sb"), F.sum("tw").alias("st"))
    ways = [F.struct(F.col(x).alias("base_id"), F.col(y).alias("target_id"), F.round(z, 6).alias("pool_score")) for x, y, z in (("base_id", "target_id", "st"), ("target_id", "base_id", "sb"))]
    return _filled(sums.select(F.inline(F.array(*ways))), sem.select("owner", "main").distinct(), 20)


#: Fixed values of the first measure: what a role counts, the most an idf counts in it, what an ingredient of another category keeps, and
#: the share of each component in the score; of the pool: what a shared ingredient counts by its role, and what is taken off.
ROLES = ("primary", "secondary", "support")
ROLE_FACTOR, IDF_CAP, OFF_CATEGORY = (1.2, 0.55, 0.2), (6.0, 3.5, 2.0), (0.75, 0.35, 0.5)
SHARES, FAMILY_SHARE, NO_PRIMARY_CAP = (0.65, 0.20, 0.05), 0.10, 0.35
HALF = 1e-9  # added before rounding, so that halves go up whatever their last binary digit
POOL_WEIGHT, SUPPORT_ONLY, FAMILY_CONFLICT = (4.0, 1.2, 0.25), 2.0, 1.5
#: So many families are bits of an int, beside two for the role.
BITS = 28


def _by_role(role: Column, values: tuple[float, ...]) -> Column:
    out = F.when(role == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(role == i, v)
    return out


def role_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(owner, item, main, role 0 to 2, family, idf, df, weight, families): effective weights of the first measure. The family of an
    ingredient is its sub category; families: those of the owner's primary ones. The rows are placed by item once, for what an ingredient
    has, and by owner once."""
    def build() -> DataFrame:
        v = vec(spark, d)
        owners, df = v.agg(F.count_distinct("owner")).first()[0], v.groupBy("item").agg(F.count(F.lit(1)).alias("df"))  # one number
        known = imap(spark, d).select("item", "category", F.col("sub").alias("family"), (F.col("kind") == "excipient").alias("filler"), F.greatest(F.lit(0.45), F.col("conf")).alias("conf")).join(df, "item")
        rows = v.join(known, "item").repartition("owner")
        own, category = Window.partitionBy("owner"), Window.partitionBy("owner", "category")
        rows = rows.withColumn("score", F.round(F.sum(F.col("weight") * F.col("conf")).over(category), 9)).withColumn("w", F.round("weight", 9))
        rows = rows.withColumn("main", F.min(F.struct((-F.col("score")).alias("s"), "category")).over(own)["category"]).withColumn("top", F.max("w").over(own))
        rows = rows.withColumn("role", F.when(F.col("filler"), 2).when((F.col("category") == F.col("main")) & (F.col("w") >= 0.72 * F.col("top")), 0).otherwise(1))
        rows = rows.withColumn("primaries", F.count_if(F.col("role") == 0).over(own)).withColumn("heaviest", F.min(F.struct((-F.col("w")).alias("w"), "item")).over(own)["item"])
        rows = rows.withColumn("role", F.when((F.col("primaries") == 0) & (F.col("item") == F.col("heaviest")), 0).otherwise(F.col("role")))
        rows = rows.withColumn("families", F.collect_set(F.when(F.col("role") == 0, F.col("family"))).over(own))
        rows = rows.withColumn("idf", F.log((F.lit(1.0) + owners) / (F.lit(1.0) + F.col("df"))) + 1)
        off = F.when(F.col("category") == F.col("main"), 1.0).otherwise(_by_role(F.col("role"), OFF_CATEGORY))
        weight = F.col("weight") * F.least("idf", _by_role(F.col("role"), IDF_CAP)) * _by_role(F.col("role"), ROLE_FACTOR) * off
        return rows.select("owner", "item", "main", "role", "family", "idf", "df", weight.alias("weight"), "families")

    return kept_for(spark, "role-vectors", _sources(d), build)


def pool_v1(spark: SparkSession, d: str) -> DataFrame:
    """(base_id, target_id, pool_score, rk): the 20 targets with the highest sum of role weight x idf over shared ingredients, by the role in
    the target. Ingredients in more than 5 % of the products count only as support. Pairs that share support only lose 2, pairs
    without a primary family in common 1.5."""
    v = role_vectors(spark, d)
    return _pool_v1(v, counts_in_pool(v))


def counts_in_pool(v: DataFrame) -> Column:
    """Whether an entry counts for the pool: ingredients in more than 5 % of the products only as support."""
    owners = v.agg(F.count_distinct("owner")).first()[0]  # one number
    return (F.col("df") <= max(1, math.floor(0.05 * owners))) | (F.col("role") == 2)


def _pool_v1(v: DataFrame, counts: Column, measured: bool = False) -> DataFrame:
    """The pool; with `measured`, also the components of the first measure (`ROLES`), family and shared, over the entries that count. What either
    side has besides the shared ingredients is its total less these (the columns total_0 to total_2), so no entry is looked up again."""
    names = sorted(r[0] for r in v.where("role = 0").select("family").distinct().limit(BITS + 1).collect() if r[0] is not None)
    if len(names) <= BITS:  # an owner's families and the role in 4 bytes
        told = F.col("role")
        for i, name in enumerate(names, 2):
            told = told + F.when(F.array_contains("families", name), 1 << i).otherwise(0)
        fields, role = {"told": told}, lambda side: F.col(f"{side}_told").bitwiseAND(F.lit(3))
        in_common = F.col("b_told").bitwiseAND(F.col("t_told")) > 3
        family = F.coalesce(F.try_divide(F.bit_count(F.shiftright(F.col("b_told").bitwiseAND(F.col("t_told")), 2)), F.bit_count(F.shiftright(F.col("b_told").bitwiseOR(F.col("t_told")), 2))), F.lit(0.0))
    else:
        fields, role = {"role": F.col("role").cast("tinyint"), "families": F.col("families")}, lambda side: F.col(f"{side}_role")
        in_common = F.arrays_overlap("b_families", "t_families")
        family = vectors.set_similarity(F.col("b_families"), F.col("t_families"))
    more = []
    if measured:
        fields |= {c: F.col(c) for c in ("weight", "total_0", "total_1", "total_2")}
        b, t, both = F.col("b_weight"), F.col("t_weight"), F.least(role("b"), role("t"))
        of = lambda which, r, x: F.sum(F.when(which == r, x).otherwise(0.0))
        for r, name in enumerate(ROLES):
            high = of(both, r, F.greatest(b, t)) + (F.first(f"b_total_{r}") - of(role("b"), r, b)) + (F.first(f"t_total_{r}") - of(role("t"), r, t))
            more.append(F.coalesce(F.try_divide(of(both, r, F.least(b, t)), high), F.lit(0.0)).alias(name))
        more += [F.first(family).alias("family"), F.count(F.lit(1)).alias("shared")]
    counted = v.where(counts).select("owner", "item", "main", "idf", *[c.alias(n) for n, c in fields.items()])
    met, low = vectors.meet_narrow(counted, ["item", "main"], ["idf", *fields], [*fields])
    sums = met.groupBy("b_owner", "t_owner").agg(
        F.sum(_by_role(role("t"), POOL_WEIGHT) * F.col("b_idf")).alias("s"), F.min(F.least(role("b"), role("t"))).alias("best"), F.max(in_common).alias("in_common"), *more
    )
    score = F.col("s") - F.when(F.col("best") == 2, SUPPORT_ONLY).otherwise(0.0) - F.when(F.col("in_common"), 0.0).otherwise(FAMILY_CONFLICT)
    kept = [*ROLES, "family", "shared"] if measured else []
    return vectors.best_pairs(sums.select("b_owner", "t_owner", F.round(score, 6).alias("pool_score"), *kept), low, 20, F.desc("pool_score"), F.col("target_id"))


def candidate_pool_v1(spark: SparkSession, d: str) -> DataFrame:
    return pool_v1(spark, d)


def aligned(pairs: DataFrame, v: DataFrame, *first: str) -> DataFrame:
    """(base_id, target_id, item, b, t, role, first...): the entries of both sides of each pair over the union of their items; b and t are
    weights, 0 where a side lacks the item, role the strongest of both."""
    sides = [
        pairs.select("base_id", "target_id").join(v.select(F.col("owner").alias(side), "item", "role", *first, *[(F.col("weight") if side == s else F.lit(0.0)).alias(n) for s, n in (("base_id", "b"), ("target_id", "t"))]), side)
        for side in ("base_id", "target_id")
    ]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("base_id", "target_id", "item").agg(F.max("b").alias("b"), F.max("t").alias("t"), F.min("role").alias("role"), *[F.min(c).alias(c) for c in first])


def weighted_jaccard_v1(spark: SparkSession, d: str) -> DataFrame:
    """The first measure on the pairs of its pool: weighted Jaccard by component (the strongest role of an ingredient), 0.65 primary, 0.20
    secondary, 0.05 support and 0.10 the families of the primary ones; at most 0.35 where no primary ingredient or family is shared."""
    v = role_vectors(spark, d)
    counts = counts_in_pool(v)
    if v.where(~counts).isEmpty():
        own = Window.partitionBy("owner")
        per = _pool_v1(v.withColumns({f"total_{r}": F.sum(F.when(F.col("role") == r, F.col("weight")).otherwise(0.0)).over(own) for r in range(len(ROLES))}), counts, measured=True)
    else:
        per = _measured_apart(v, _pool_v1(v, counts))
    score = SHARES[0] * F.col("primary") + SHARES[1] * F.col("secondary") + FAMILY_SHARE * F.col("family") + SHARES[2] * F.col("support")
    capped = F.when((F.col("primary") <= 0) & (F.col("family") <= 0), F.least(score, F.lit(NO_PRIMARY_CAP))).otherwise(score)
    final = F.when(F.col("shared") == 0, 0.0).otherwise(capped)
    return per.select("base_id", "target_id", *[F.round(F.col(c) + HALF, 6).alias(c) for c in (*ROLES, "family")], F.round(final + HALF, 6).alias("score"))


def _measured_apart(v: DataFrame, pool: DataFrame) -> DataFrame:
    """The components for the pairs of a pool, where ingredients too frequent to count for it count for the measure."""
    low = lambda r: F.sum(F.when(F.col("role") == r, F.least("b", "t")).otherwise(0.0))
    high = lambda r: F.sum(F.when(F.col("role") == r, F.greatest("b", "t")).otherwise(0.0))
    per = aligned(pool, v).groupBy("base_id", "target_id").agg(
        *[F.coalesce(F.try_divide(low(r), high(r)), F.lit(0.0)).alias(n) for r, n in enumerate(ROLES)], F.count_if((F.col("b") > 0) & (F.col("t") > 0)).alias("shared")
    )
    families = v.where("role = 0").groupBy("owner").agg(F.collect_set("family").alias("f"))
    a, b = families.select(F.col("owner").alias("base_id"), F.col("f").alias("bf")), families.select(F.col("owner").alias("target_id"), F.col("f").alias("tf"))
    none = F.array().cast("array<string>")
    return per.join(a, "base_id", "left").join(b, "target_id", "left").withColumn("family", vectors.set_similarity(F.coalesce("bf", none), F.coalesce("tf", none)))


def semantic_jaccard_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """The measure by semantic weights on the ten best pairs, multiplied by how much of the base's core the target covers, then capped in
    order, each cap only where the score is above it: 0.64 if only weak ingredients are shared and neither side has a core; 0.64 if no
    core ingredient is shared, all shared are weak, at most two, and fewer than three of the base are left; 0.64 if one core ingredient
    is shared, two in all at most, and three or more of the base are left; 0.64 if no core ingredient is shared, two in all at most,
    and three or more are left; 0.97 if the two are equal and weigh 1.5 or less. `caps` names those that took hold."""
    sem = kept_semantic(spark, d)
    sizes = sem.groupBy("owner").agg(F.sum("weight").alias("total"), F.count_if(F.col("weight") >= 0.7).alias("core"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("owner", "total", F.col("core").cast("int"), F.col("n").cast("int"))
    met, low = vectors.meet_narrow(sem.select("owner", "item", "main", "weight").join(sizes, "owner"), ["item", "main"], ["weight", "total", "core", "n"], ["weight", "total", "core", "n"])
    b, t = F.col("b_weight"), F.col("t_weight")
    sums = met.groupBy("b_owner", "t_owner").agg(
        F.sum(F.least(b, t)).alias("smin"), F.sum(F.greatest(b, t) - b - t).alias("less"), F.count(F.lit(1)).alias("shared"), F.count_if((b >= 0.7) & (t >= 0.7)).alias("shared_core"),
        F.count_if((b >= 0.7) | (t >= 0.7)).alias("strong"), *[F.first(f"{side}_{c}").alias(f"{side}_{c}") for side in "bt" for c in ("total", "core", "n")],
    )
    sums = sums.withColumn("raw", F.col("smin") / (F.col("less") + F.col("b_total") + F.col("t_total"))).withColumn("score", F.round("raw", 6))
    a = vectors.best_pairs(sums, low, 10, F.desc("score"), F.col("target_id")).select(
        "base_id", "target_id", "raw", F.col("b_core").alias("core"), F.col("t_core").alias("core_t"), "shared_core", "shared", "strong", (F.col("b_n") - F.col("shared")).alias("left"),
        (F.col("t_n") - F.col("shared")).alias("extra"), F.least("b_total", "t_total").alias("mass"),
    )
    cover = F.coalesce(F.try_divide(F.col("shared_core"), F.col("core")), F.lit(0.0))
    mult = F.when((F.col("core") == 0) | (cover >= 1), 1.0).when(cover > 0, 0.85 + 0.15 * cover).otherwise(0.68)
    no_core, weak = (F.col("core") == 0) & (F.col("core_t") == 0), F.col("strong") == 0
    shared, left = F.col("shared"), F.col("left")
    steps = [
        ("weak_only", 0.64, weak & no_core), ("no_core_with_extra", 0.64, (F.col("shared_core") == 0) & weak & (shared <= 2) & (left < 3) & (left + F.col("extra") > 0)),
        ("single_core", 0.64, (F.col("shared_core") == 1) & (shared <= 2) & (left >= 3)), ("no_core_low_coverage", 0.64, (F.col("shared_core") == 0) & (shared <= 2) & (left >= 3)),
        ("sparse_exact", 0.97, (F.col("s") >= 0.999999) & (F.col("mass") <= 1.5)),
    ]
    out = a.withColumn("s", F.round(F.col("raw") * mult, 9)).withColumn("caps", F.array().cast("array<string>"))
    for name, most, when in steps:
        hit = when & (F.col("s") > most)
        out = out.withColumn("caps", F.when(hit, F.array_append("caps", F.lit(name))).otherwise(F.col("caps"))).withColumn("s", F.when(hit, most).otherwise(F.col("s")))
    return out.select("base_id", "target_id", F.round("raw", 6).alias("raw"), F.round("s", 6).alias("score"), F.array_join("caps", ",").alias("caps"))


def function_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted Jaccard of the category scores of each of the ten best pairs."""
    scores = category_scores_of(spark, d).groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("m"))
    top = top_of(spark, d).select("base_id", "target_id")
    a, b = scores.select(F.col("owner").alias("base_id"), F.col("m").alias("a")), scores.select(F.col("owner").alias("target_id"), F.col("m").alias("b"))
    return top.join(a, "base_id").join(b, "target_id").select("base_id", "target_id", vectors.map_similarity(F.col("a"), F.col("b")).alias("function_similarity"))


def _sets(spark: SparkSession, d: str, least: float) -> DataFrame:
    return kept_semantic(spark, d).where(F.col("weight") >= least).groupBy("owner").agg(F.collect_set("item").alias("items"))


def _top_with_sets(spark: SparkSession, d: str, least: float) -> DataFrame:
    sets = _sets(spark, d, least)
    a, b = sets.select(F.col("owner").alias("base_id"), F.col("items").alias("a")), sets.select(F.col("owner").alias("target_id"), F.col("items").alias("b"))
    none = F.array().cast("array<bigint>")
    top = top_of(spark, d).select("base_id", "target_id").join(a, "base_id", "left").join(b, "target_id", "left")
    return top.withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))


def core_match(spark: SparkSession, d: str) -> DataFrame:
    return _top_with_sets(spark, d, 0.7).select("base_id", "target_id", F.round(vectors.set_similarity(F.col("a"), F.col("b")), 6).alias("core_match"))


def core_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the base's core the target covers, and the multiplier that follows: 1 in full, 0.85 + 0.15 c in part, 0.68 not at all."""
    shared, core = F.size(F.array_intersect("a", "b")), F.size("a")
    c = F.coalesce(F.try_divide(shared, core), F.lit(0.0))
    mult = F.when((core == 0) | (c >= 1), 1.0).when(c > 0, 0.85 + 0.15 * c).otherwise(0.68)
    return _top_with_sets(spark, d, 0.7).select("base_id", "target_id", core.alias("core"), shared.alias("shared_core"), F.round(mult, 6).alias("multiplier"))


def profile_compare(spark: SparkSession, d: str) -> DataFrame:
    parts = vectors.compare_sets(F.col("a"), F.col("b"))
    return _top_with_sets(spark, d, 0.0).select("base_id", "target_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for n, c in parts.items()])


_CORE = _with(VEC, IMAP, CAT, MAIN, SEM, PAIRS)
_COUNTS = _CORE + """, core AS (SELECT owner, item FROM sem WHERE weight >= 0.7),
sizes AS (SELECT owner, count(*) AS n FROM core GROUP BY 1),
met AS (SELECT t.base_id, t.target_id, count(*) AS shared FROM topk t JOIN core a ON a.owner = t.base_id JOIN core b ON b.owner = t.target_id AND b.item = a.item GROUP BY 1, 2),
counts AS (
  SELECT t.base_id, t.target_id, coalesce(x.n, 0) AS nb, coalesce(y.n, 0) AS nt, coalesce(m.shared, 0) AS s
  FROM topk t LEFT JOIN sizes x ON x.owner = t.base_id LEFT JOIN sizes y ON y.owner = t.target_id LEFT JOIN met m ON m.base_id = t.base_id AND m.target_id = t.target_id)
"""

_V1 = _with(VEC, IMAP, CAT, MAIN) + """, wt AS (SELECT v.owner, v.item, round(v.weight, 9) AS weight, v.weight AS plain, max(round(v.weight, 9)) OVER (PARTITION BY v.owner) AS top FROM vec v),
r0 AS (SELECT w.owner, w.item, w.weight, w.plain, m.category, m.sub, n.main,
    CASE WHEN m.kind = 'excipient' THEN 2 WHEN m.category = n.main AND w.weight >= 0.72 * w.top THEN 0 ELSE 1 END AS role FROM wt w JOIN imap m ON w.item = m.item JOIN main n ON n.owner = w.owner),
r1 AS (SELECT *, CASE WHEN count_if(role = 0) OVER (PARTITION BY owner) = 0 AND row_number() OVER (PARTITION BY owner ORDER BY weight DESC, item) = 1 THEN 0 ELSE role END AS final FROM r0),
idf AS (SELECT item, count(*) AS df, ln((1.0 + (SELECT count(DISTINCT owner) FROM vec)) / (1.0 + count(*))) + 1 AS idf FROM vec GROUP BY 1),
rv AS (SELECT owner, r1.item, main, final AS role, sub AS family, idf, df, CAST(plain AS DOUBLE) * least(idf, [6.0, 3.5, 2.0][final + 1]) * [1.2, 0.55, 0.2][final + 1]
    * CASE WHEN category = main THEN 1.0 ELSE [0.75, 0.35, 0.5][final + 1] END AS weight FROM r1 JOIN idf ON idf.item = r1.item),
families AS (SELECT owner, list(DISTINCT family) AS f FROM rv WHERE role = 0 GROUP BY 1),
counted AS (SELECT *, [4.0, 1.2, 0.25][role + 1] * idf AS pw FROM rv WHERE role = 2 OR df <= greatest(1, floor(0.05 * (SELECT count(DISTINCT owner) FROM vec)))),
sums AS (SELECT b.owner AS base_id, t.owner AS target_id, sum(t.pw) AS s, min(least(b.role, t.role)) AS best FROM counted b JOIN counted t ON b.item = t.item AND b.main = t.main AND b.owner <> t.owner GROUP BY 1, 2),
pool1 AS (SELECT base_id, target_id, round(s - CASE WHEN best = 2 THEN 2.0 ELSE 0 END - CASE WHEN len(list_intersect(coalesce(x.f, []), coalesce(y.f, []))) > 0 THEN 0 ELSE 1.5 END, 6) AS pool_score,
    row_number() OVER (PARTITION BY base_id ORDER BY round(s - CASE WHEN best = 2 THEN 2.0 ELSE 0 END - CASE WHEN len(list_intersect(coalesce(x.f, []), coalesce(y.f, []))) > 0 THEN 0 ELSE 1.5 END, 6) DESC, target_id) AS rk
  FROM sums LEFT JOIN families x ON x.owner = base_id LEFT JOIN families y ON y.owner = target_id QUALIFY rk <= 20)
"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_max_merge, document_frequency_idf, category_scores, product_main_category, relative_weight, semantic_vector, nutrient_total_cap, topk_similar,
        candidate_pool, candidate_pool_v1, weighted_jaccard_v1, semantic_jaccard_adjusted, function_similarity, core_match, core_coverage, profile_compare,
    )
}
SQL = {
    "vector_max_merge": _with(VEC) + "SELECT owner AS product_id, item AS ingredient, round(weight, 6) AS weight FROM vec",
    "document_frequency_idf": _with(VEC) + "SELECT item AS ingredient, count(*) AS df, round(ln((1.0 + (SELECT count(DISTINCT owner) FROM vec)) / (1.0 + count(*))) + 1, 6) AS idf FROM vec GROUP BY 1",
    "category_scores": _with(VEC, IMAP, CAT) + "SELECT owner AS product_id, category, round(score, 6) AS score FROM cat",
    "product_main_category": _with(VEC, IMAP, CAT, MAIN)
    + """SELECT a.owner AS product_id, a.category, round(round(a.score, 9), 6) AS score, coalesce(round(round(b.score, 9), 6), 0.0) AS second_score
FROM ranked a LEFT JOIN ranked b ON a.owner = b.owner AND b.rn = 2 WHERE a.rn = 1""",
    "relative_weight": _with(VEC) + "SELECT owner AS product_id, item AS ingredient, round(weight / max(weight) OVER (PARTITION BY owner), 6) AS share_of_top FROM vec",
    "semantic_vector": _with(VEC, IMAP, CAT, MAIN, SEM) + "SELECT owner AS product_id, item AS ingredient, main AS main_category, CAST(weight AS DOUBLE) AS weight FROM sem",
    "nutrient_total_cap": _with(VEC, IMAP, CAT, MAIN, SEM)
    + """SELECT owner AS product_id, item AS ingredient, round(CASE WHEN kind = 'nutrient' AND o > 0 AND c > o * 0.25 THEN weight * (o * 0.25) / c ELSE weight END, 6) AS weight
FROM (SELECT *, sum(CASE WHEN kind = 'nutrient' THEN CAST(weight AS DOUBLE) ELSE 0 END) OVER (PARTITION BY owner) AS c,
  sum(CASE WHEN kind = 'nutrient' THEN 0 ELSE CAST(weight AS DOUBLE) END) OVER (PARTITION BY owner) AS o FROM sem)""",
    "topk_similar": _CORE + "SELECT base_id, target_id, score, shared, rk FROM topk",
    "candidate_pool": _with(VEC, IMAP, CAT, MAIN, SEM)
    + """, freq AS (SELECT item, count(*) AS df FROM sem GROUP BY 1),
rare AS (SELECT item FROM freq WHERE df <= greatest(1, floor(0.05 * (SELECT count(DISTINCT owner) FROM sem)))),
counted AS (SELECT * FROM sem WHERE weight >= 0.7 OR item IN (SELECT item FROM rare)),
w AS (SELECT item, ln((1.0 + (SELECT count(DISTINCT owner) FROM vec)) / (1.0 + count(*))) + 1 AS idf FROM vec GROUP BY 1),
owners AS (SELECT DISTINCT owner, main FROM sem),
pool AS (
  SELECT b.owner AS base_id, t.owner AS target_id, round(sum(t.weight * w.idf), 6) AS pool_score
  FROM counted b JOIN counted t ON b.item = t.item AND b.main = t.main AND b.owner <> t.owner JOIN w ON w.item = b.item GROUP BY 1, 2),
seeded AS (
  SELECT * FROM pool UNION ALL SELECT b.owner, t.owner, 0.0 FROM owners b JOIN owners t ON b.main = t.main AND b.owner <> t.owner ANTI JOIN pool p ON p.base_id = b.owner AND p.target_id = t.owner)
SELECT base_id, target_id, CAST(pool_score AS DOUBLE) AS pool_score, row_number() OVER (PARTITION BY base_id ORDER BY pool_score DESC, target_id) AS rk FROM seeded QUALIFY rk <= 20""",
    "candidate_pool_v1": _V1 + "SELECT * FROM pool1",
    "weighted_jaccard_v1": _V1
    + """, sides AS (
  SELECT p.base_id, p.target_id, v.item, v.role, v.weight AS b, 0.0 AS t FROM pool1 p JOIN rv v ON v.owner = p.base_id
  UNION ALL SELECT p.base_id, p.target_id, v.item, v.role, 0.0, v.weight FROM pool1 p JOIN rv v ON v.owner = p.target_id),
al AS (SELECT base_id, target_id, item, min(role) AS role, max(b) AS b, max(t) AS t FROM sides GROUP BY 1, 2, 3),
per AS (
  SELECT base_id, target_id, """
    + ", ".join(
        f"coalesce(sum(least(b, t)) FILTER (role = {i}) / nullif(sum(greatest(b, t)) FILTER (role = {i}), 0), 0) AS {n}" for i, n in enumerate(ROLES)
    )
    + """, count_if(b > 0 AND t > 0) AS shared FROM al GROUP BY 1, 2),
fam AS (
  SELECT p.*, coalesce(len(list_intersect(x.f, y.f)) / nullif(len(list_distinct(list_concat(coalesce(x.f, []), coalesce(y.f, [])))), 0), 0) AS family
  FROM per p LEFT JOIN families x ON x.owner = base_id LEFT JOIN families y ON y.owner = target_id),
s AS (SELECT *, 0.65 * "primary" + 0.2 * secondary + 0.1 * family + 0.05 * support AS raw FROM fam)
SELECT base_id, target_id, round("primary" + 1e-9, 6) AS "primary", round(secondary + 1e-9, 6) AS secondary, round(support + 1e-9, 6) AS support, round(family + 1e-9, 6) AS family,
  round(CASE WHEN shared = 0 THEN 0 WHEN "primary" <= 0 AND family <= 0 THEN least(raw, 0.35) ELSE raw END + 1e-9, 6) AS score FROM s""",
    "semantic_jaccard_adjusted": _CORE
    + """, sides AS (
  SELECT p.base_id, p.target_id, v.item, CAST(v.weight AS DOUBLE) AS b, 0.0 AS t FROM topk p JOIN sem v ON v.owner = p.base_id
  UNION ALL SELECT p.base_id, p.target_id, v.item, 0.0, v.weight FROM topk p JOIN sem v ON v.owner = p.target_id),
al AS (SELECT base_id, target_id, item, max(b) AS b, max(t) AS t FROM sides GROUP BY 1, 2, 3),
a AS (
  SELECT base_id, target_id, sum(least(b, t)) / sum(greatest(b, t)) AS raw, count_if(b >= 0.7) AS core, count_if(t >= 0.7) AS core_t, count_if(b >= 0.7 AND t >= 0.7) AS shared_core,
    count_if(b > 0 AND t > 0) AS shared, count_if(b > 0 AND t > 0 AND (b >= 0.7 OR t >= 0.7)) AS strong, count_if(b > 0 AND t = 0) AS lft, count_if(t > 0 AND b = 0) AS extra, least(sum(b), sum(t)) AS mass
  FROM al GROUP BY 1, 2),
s0 AS (SELECT *, round(raw * CASE WHEN core = 0 OR shared_core >= core THEN 1.0 WHEN shared_core > 0 THEN 0.85 + 0.15 * (CAST(shared_core AS DOUBLE) / core) ELSE 0.68 END, 9) AS s FROM a),
s1 AS (SELECT *, strong = 0 AND core = 0 AND core_t = 0 AND s > 0.64 AS c1 FROM s0),
s2 AS (SELECT *, NOT c1 AND shared_core = 0 AND strong = 0 AND shared <= 2 AND lft < 3 AND lft + extra > 0 AND s > 0.64 AS c2 FROM s1),
s3 AS (SELECT *, NOT c1 AND NOT c2 AND shared_core = 1 AND shared <= 2 AND lft >= 3 AND s > 0.64 AS c3 FROM s2),
s4 AS (SELECT *, NOT c1 AND NOT c2 AND NOT c3 AND shared_core = 0 AND shared <= 2 AND lft >= 3 AND s > 0.64 AS c4 FROM s3),
s5 AS (SELECT *, NOT (c1 OR c2 OR c3 OR c4) AND s >= 0.999999 AND mass <= 1.5 AS c5 FROM s4)
SELECT base_id, target_id, round(raw, 6) AS raw, round(CASE WHEN c1 OR c2 OR c3 OR c4 THEN 0.64 WHEN c5 THEN 0.97 ELSE s END, 6) AS score,
  CASE WHEN c1 THEN 'weak_only' WHEN c2 THEN 'no_core_with_extra' WHEN c3 THEN 'single_core' WHEN c4 THEN 'no_core_low_coverage' WHEN c5 THEN 'sparse_exact' ELSE '' END AS caps FROM s5""",
    "function_similarity": _CORE
    + """, u AS (
  SELECT t.base_id, t.target_id, c.category, c.score AS a, 0.0 AS b FROM topk t JOIN cat c ON c.owner = t.base_id
  UNION ALL SELECT t.base_id, t.target_id, c.category, 0.0, c.score FROM topk t JOIN cat c ON c.owner = t.target_id),
m AS (SELECT base_id, target_id, category, max(a) AS a, max(b) AS b FROM u GROUP BY 1, 2, 3)
SELECT base_id, target_id, round(sum(least(a, b)) / sum(greatest(a, b)), 6) AS function_similarity FROM m GROUP BY 1, 2""",
    "core_match": _COUNTS + "SELECT base_id, target_id, CASE WHEN nb + nt - s = 0 THEN 0.0 ELSE round(s / (nb + nt - s), 6) END AS core_match FROM counts",
    "core_coverage": _COUNTS
    + """SELECT base_id, target_id, nb AS core, s AS shared_core,
  round(CASE WHEN nb = 0 OR s = nb THEN 1.0 WHEN s > 0 THEN 0.85 + 0.15 * (CAST(s AS DOUBLE) / nb) ELSE 0.68 END, 6) AS multiplier FROM counts""",
    "profile_compare": _CORE
    + """, l AS (SELECT owner, list(item) AS items FROM sem GROUP BY 1)
SELECT t.base_id, t.target_id, array_to_string(list_sort(list_intersect(a.items, b.items)), ',') AS shared,
  array_to_string(list_sort(list_filter(a.items, lambda x: NOT list_contains(b.items, x))), ',') AS base_only,
  array_to_string(list_sort(list_filter(b.items, lambda x: NOT list_contains(a.items, x))), ',') AS target_only
FROM topk t JOIN l a ON a.owner = t.base_id JOIN l b ON b.owner = t.target_id""",
}
