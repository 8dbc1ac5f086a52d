"""Top N items within every group, also where some groups hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, subgroups: int | None = None) -> DataFrame:
    """(group, item, score, rank_no): the n distinct items of each group with the highest score.

    Two stages; unless given, `subgroups` is one for every two million rows, 64 at least. A hash of the item spreads every group over `subgroups`; each subgroup keeps its n best, and only these
    (at most n x subgroups rows of a group, however large it is) are ranked against each other. An item's score is its
    highest that is neither null nor NaN; items without one, and null groups or items, do not rank. Equal scores: smaller
    item first, by the bytes of its string. The repeats of an item always meet in one subgroup, so the ranks are exact.
    An empty table gives an empty result; -0.0 and 0.0 are equal.
    """
    subgroups = subgroups or max(64, -(-df.count() // 2_000_000))
    value = F.col(score).cast("double") + F.lit(0.0)
    fits = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    rows = df.where(fits).select(F.col(group).alias("__g"), F.col(item).alias("__i"), value.alias("__s"))
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64("__i"), F.lit(subgroups)).cast("int"))
    best = rows.groupBy("__g", "__sub", "__i").agg(F.max("__s").alias("__s"))
    order = (F.desc("__s"), F.asc("__i"))
    kept = best.withColumn("r", F.row_number().over(Window.partitionBy("__g", "__sub").orderBy(*order))).where(F.col("r") <= n).drop("r")
    ranked = kept.withColumn("rank_no", F.row_number().over(Window.partitionBy("__g").orderBy(*order))).where(F.col("rank_no") <= n)
    return ranked.select(F.col("__g").alias(group), F.col("__i").alias(item), F.col("__s").alias(score), F.col("rank_no").cast("int").alias("rank_no"))
