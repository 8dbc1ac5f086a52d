"""A quality classifier on pair features: features, class weights, boosted trees, prediction and cross-validation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanmaru.functions.text import json_names
from hanmaru.session import write_through

NUMERIC = (
    "similarity", "function_similarity", "core_match", "shared", "base_only", "target_only", "shared_categories", "different_categories",
    "shared_share", "score_gap", "core_gap", "weak_core", "no_shared", "base_size", "target_size", "size_gap", "base_cover", "target_cover", "category_share", "lowest", "highest", "mean_score",
    "product_score", "high_score", "high_low_core", "cold", "single_shared", "broad_target", "narrow_base", "no_category", "reasoned", "cautioned", "score_missing",
)
NOMINAL = ("algorithm_version",)


def pair_features(pairs: DataFrame) -> DataFrame:
    """Numeric features of cached pairs; missing and NaN scores count as 0, missing lists as empty."""
    def score(c: str) -> Column:
        return F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))

    def size(c: str) -> Column:
        return F.size(json_names(F.col(c))).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    c, e = size("shared_categories_json"), size("different_categories_json")
    s, f, m = score("similarity_score"), score("function_similarity_score"), score("core_match_score")
    a, b, t = size("shared_ingredients_json"), size("base_only_ingredients_json"), size("target_only_ingredients_json")
    return pairs.select(
        "base_product_id", "target_product_id", F.coalesce("algorithm_version", F.lit("-")).alias("algorithm_version"), "substitutability",
        s.alias("similarity"), f.alias("function_similarity"), m.alias("core_match"), a.alias("shared"), b.alias("base_only"), t.alias("target_only"),
        size("shared_categories_json").alias("shared_categories"), size("different_categories_json").alias("different_categories"),
        F.coalesce(F.try_divide(a, a + b + t), F.lit(0.0)).alias("shared_share"), (s - f).alias("score_gap"), (s - m).alias("core_gap"),
        (m < 0.4).cast("double").alias("weak_core"), (a == 0).cast("double").alias("no_shared"),
        (a + b).alias("base_size"), (a + t).alias("target_size"), F.abs(b - t).alias("size_gap"), share(a, a + b).alias("base_cover"), share(a, a + t).alias("target_cover"), share(c, c + e).alias("category_share"),
        F.least(s, f, m).alias("lowest"), F.greatest(s, f, m).alias("highest"), ((s + f + m) / 3).alias("mean_score"), (s * m).alias("product_score"),
        flag(s >= 0.65).alias("high_score"), flag((s >= 0.65) & (m < 0.4)).alias("high_low_core"), flag((s < 0.45) & (f < 0.4)).alias("cold"), flag(a == 1).alias("single_shared"),
        flag((b == 0) & (t >= 3)).alias("broad_target"), flag(a + b <= 2).alias("narrow_base"), flag(c == 0).alias("no_category"), flag(F.coalesce("reason", F.lit("")) != "").alias("reasoned"),
        flag(F.coalesce("caution", F.lit("")) != "").alias("cautioned"), flag(F.col("similarity_score").isNull() | F.isnan("similarity_score")).alias("score_missing"),
    )


def weighted_labels(rows: DataFrame, label: Column) -> DataFrame:
    """Adds label (0 or 1) and weight: positives weigh as the ratio of negatives to positives, so both classes weigh the same."""
    out = rows.withColumn("label", F.coalesce(label, F.lit(False)).cast("double"))
    pos, n = out.agg(F.sum("label"), F.count(F.lit(1))).first()
    ratio = (n - pos) / pos if pos else 1.0
    return out.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(1.0))


def train(rows: DataFrame, trees: int = 400, rate: float = 0.05, depth: int = 6, subsample: float = 0.8, seed: int = 7, sample_rows: int = 200_000) -> PipelineModel:
    """Boosted trees on labelled rows. At most about `sample_rows` of them are used, a documented bound: more do not change the trees."""
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("base_product_id", "target_product_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    index = StringIndexer(inputCols=list(NOMINAL), outputCols=[f"{c}_no" for c in NOMINAL], handleInvalid="keep", stringOrderType="alphabetAsc")
    vector = VectorAssembler(inputCols=[*NUMERIC, *[f"{c}_no" for c in NOMINAL]], outputCol="features")
    trees_ = GBTClassifier(maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, weightCol="weight", seed=seed)
    return Pipeline(stages=[index, vector, trees_]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, threshold: float) -> DataFrame:
    """Adds weak_probability and quality_label: weak from the threshold on, uncertain from 0.6 of it, else good."""
    p = F.round(vector_to_array("probability")[1], 6)
    out = model.transform(rows).withColumn("weak_probability", p)
    label = F.when(F.col("weak_probability") >= threshold, "weak").when(F.col("weak_probability") >= 0.6 * threshold, "uncertain").otherwise("good")
    return out.withColumn("quality_label", label).drop("features", "rawPrediction", "probability", "prediction", *[f"{c}_no" for c in NOMINAL])


def best_threshold(rows: DataFrame, score: Column, positive: Column, floor: float, ranges: int = 1000) -> DataFrame:
    """(threshold, tp, flagged, all_pos, precision, f1) of the threshold with the highest F1 among those whose precision is at least
    `floor` (among all, if none is); of equal ones the highest. Every distinct score is a threshold, exactly: sums by distinct score
    are cut into ranges, running sums are made within each and of the ranges' totals, so no window holds more than a range."""
    counts = rows.select(score.alias("threshold"), F.coalesce(positive, F.lit(False)).cast("long").alias("p")).where(F.col("threshold").isNotNull())
    counts = write_through(counts.groupBy("threshold").agg(F.sum("p").alias("pos"), F.count(F.lit(1)).alias("n")), "thresholds")
    low, high = counts.agg(F.min("threshold"), F.max("threshold")).first()  # two numbers
    width = ((high or 0.0) - (low or 0.0)) / ranges or 1.0
    cut = counts.withColumn("r", F.floor((F.col("threshold") - F.lit(low or 0.0)) / width))
    totals = cut.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select("r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.sum("rp").over(everything).alias("all_pos"))  # as many rows as ranges
    inside = Window.partitionBy("r").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.join(F.broadcast(before), "r").select("threshold", (F.sum("pos").over(inside) + F.col("bp")).alias("tp"), (F.sum("n").over(inside) + F.col("bn")).alias("flagged"), "all_pos")
    f1 = F.round(2 * F.col("tp") / (F.col("flagged") + F.col("all_pos")), 9)
    scored = run.withColumn("precision", F.round(F.col("tp") / F.col("flagged"), 9)).withColumn("f1", f1)
    best = scored.orderBy((F.col("precision") >= floor).cast("int").desc(), F.desc("f1"), F.desc("threshold")).limit(1)
    return best.select(F.round("threshold", 9).alias("threshold"), "tp", "flagged", "all_pos", "precision", "f1")


def cross_validate(rows: DataFrame, folds: int = 5, **options: float) -> list[tuple[float, float]]:
    """(area under ROC, under precision-recall) of each fold; folds by a hash of the pair, so that a pair is always in the same."""
    fold = F.pmod(F.xxhash64(F.lit(1), "base_product_id", "target_product_id"), F.lit(folds))
    out = []
    for i in range(folds):
        scored = train(rows.where(fold != i), **options).transform(rows.where(fold == i))
        out.append(tuple(BinaryClassificationEvaluator(metricName=m).evaluate(scored) for m in ("areaUnderROC", "areaUnderPR")))
    return out
