"""Aggregations: unique mentions, histograms, cross tables, condition impacts, ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A share rounded, 0 where there is nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def first_distinct(df: DataFrame, key: str, value: str, n: int, *order: Column) -> DataFrame:
    """(key, value): the first n distinct non-empty values of every key in the order (of the values, unless given) as an array. Values are
    distinct before they meet and limited before the shuffle (WindowGroupLimit), so no key gathers all of its rows."""
    rows = df.where(F.col(key).isNotNull() & (F.col(value) != ""))
    best = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("__o")) if order else rows.select(key, value).distinct().withColumn("__o", F.struct(value))
    w = Window.partitionBy(key).orderBy("__o", value)
    kept = best.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


def unique_mentions(mentions: DataFrame, key: str, variant: str, product: str, top: int = 8, products: int = 8) -> DataFrame:
    """Per key: mentions, products, the most frequent variant (then the shortest, then the first by its bytes), the `top` variants and the
    first product ids. Two levels of aggregation: a key is reduced to its variants before its variants meet, and only the best of
    those meet."""
    per_variant = mentions.groupBy(key, variant).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.length(variant), variant)
    best = per_variant.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top)
    listed = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(variant).alias("v")))), lambda x: x["v"]).alias("variants"))
    sums = mentions.groupBy(key).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(product).alias("products"))
    ids = first_distinct(mentions.select(key, F.col(product).cast("string").alias("first_products")), key, "first_products", products)
    return sums.join(listed, key).join(ids, key, "left").select(key, "mentions", "products", F.col("variants")[0].alias("representative"), "variants", "first_products")


def first_non_empty(df: DataFrame, key: str, columns: list[str], *order: Column) -> DataFrame:
    """Per key the first value of each column, in the order, that is neither null nor empty; null if there is none."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c) != "", F.struct(*order, F.col(c)))).alias(c) for c in columns])


def histogram(df: DataFrame, column: str, default: str) -> DataFrame:
    """Counts by value; null and empty values count under `default`."""
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def cross_table(df: DataFrame, row: str, column: str, values: list[str], bad: list[str]) -> DataFrame:
    """Per row value the total, the count of each of the fixed `values`, and the share of the `bad` ones; one pass, no pivot discovery."""
    counts = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(row).agg(F.count(F.lit(1)).alias("total"), *counts, rate(F.count_if(F.col(column).isin(bad)), F.count(F.lit(1))).alias("bad_rate"))


def condition_impacts(df: DataFrame, conditions: list[tuple[str, Column]], measures: dict[str, Column]) -> DataFrame:
    """One row per named condition: rows that fulfil it and conditional counts among them. All conditions are aggregated in one scan."""
    aggs = []
    for name, c in conditions:
        hit = F.coalesce(c, F.lit(False))
        aggs.append(F.struct(F.lit(name).alias("condition"), F.count_if(hit).alias("hits"), *[F.count_if(hit & F.coalesce(m, F.lit(False))).alias(k) for k, m in measures.items()]))
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def ordered_text(df: DataFrame, key: str, order: str, text: str, separator: str = " | ", cut: str | None = None) -> DataFrame:
    """Per key the distinct non-empty texts in order, joined; with `cut` a text is first split at that pattern. A text counts once, at its
    first place, before the texts of a key meet; the result holds them all."""
    rows = df.where(F.col(text) != "").select(F.col(key), F.col(order).alias("__o"), F.col(text).alias("__t"))
    if cut:
        rows = rows.select(key, "__o", F.posexplode(F.split("__t", cut)).alias("__p", "__t")).withColumn("__t", F.trim("__t")).where("__t <> ''")
        rows = rows.withColumn("__o", F.struct("__o", "__p")).drop("__p")
    once = rows.groupBy(key, "__t").agg(F.min("__o").alias("__o"))
    listed = F.array_sort(F.collect_list(F.struct("__o", "__t")))
    return once.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["__t"]), separator).alias(text))


def arg_max(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """Per group the label with the highest score (then the smallest label), its score, and the second score (0 if none). Only the two
    best of a group meet."""
    w = Window.partitionBy(group).orderBy(F.desc(score), label)
    best = df.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= 2)
    first = lambda c: F.max(F.when(F.col("__i") == 1, F.col(c)))
    return best.groupBy(group).agg(first(label).alias(label), first(score).alias(f"__{score}"), F.coalesce(F.max(F.when(F.col("__i") == 2, F.col(score))), F.lit(0.0)).alias("second_score")).select(
        group, label, F.col(f"__{score}").alias(score), "second_score"
    )


def ranked_labels(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """Adds rank_no: the place of every label in its group by score, then label. Groups are of the few labels of a product."""
    return df.withColumn("rank_no", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), label)))
