"""Sparse weighted vectors in long form (owner, item, weight): building, capping, comparing all pairs that share an item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanmaru.operators.skew import each_pair, meet_by_base, meet_within


def max_merge(rows: DataFrame, owner: str, item: str, weight: Column) -> DataFrame:
    """(owner, item, weight): the highest weight of every item of an owner; weights of 0 and below, and null keys, are no entries. The rows are
    placed by owner, so that what follows per owner (sums, arg max, joins back) needs no further exchange."""
    return (
        rows.select(F.col(owner).alias("owner"), F.col(item).alias("item"), weight.cast("double").alias("weight"))
        .where(F.col("owner").isNotNull() & F.col("item").isNotNull() & (F.col("weight") > 0))
        .repartition("owner").groupBy("owner", "item").agg(F.max("weight").alias("weight"))
    )


def idf(vectors: DataFrame) -> DataFrame:
    """(item, df, idf): in how many owners an item is, and ln((1 + N) / (1 + df)) + 1."""
    owners = vectors.agg(F.count_distinct("owner")).first()[0]  # one number
    return vectors.groupBy("item").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(1.0) + owners) / (F.lit(1.0) + F.col("df"))) + 1)


def cap_share(vectors: DataFrame, capped: Column, share: float) -> DataFrame:
    """Weights of `capped` items scaled down so that they are at most `share` of their owner's total; others stay. The sums are an aggregate
    joined back, not a window over the rows of an owner."""
    sums = vectors.groupBy("owner").agg(F.sum(F.when(capped, F.col("weight")).otherwise(0.0)).alias("c"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("o"))
    limit = F.col("o") * F.lit(share / (1 - share))
    factor = F.when((F.col("c") > limit) & (F.col("o") > 0), limit / F.col("c")).otherwise(1.0)
    return vectors.join(sums.select("owner", factor.alias("f")), "owner").select("owner", "item", F.when(capped, F.col("weight") * F.col("f")).otherwise(F.col("weight")).alias("weight"))


def frequent_dropped(vectors: DataFrame, df_share: float, keep: Column | None = None) -> DataFrame:
    """Vectors without the items in more than `df_share` of all owners, entries that fulfil `keep` aside."""
    owners = vectors.agg(F.count_distinct("owner")).first()[0]  # one number
    rare = vectors.groupBy("item").agg((F.count(F.lit(1)) <= max(1, math.floor(df_share * owners))).alias("__rare"))
    stays = F.col("__rare") | F.coalesce(keep, F.lit(False)) if keep is not None else F.col("__rare")
    return vectors.join(rare, "item").where(stays).drop("__rare")


def shared_items(vectors: DataFrame, block: str | None, df_share: float | None, once: bool = False, keep: Column | None = None) -> DataFrame:
    """Entries of vectors that meet on the item (and on `block`), different owners only: the inverted-index join. Items in more than
    `df_share` of all owners are left out where a cutoff is given, but for entries that fulfil `keep`; that is part of the measure, not
    of the plan. With `once` only the smaller owner of a pair is the base. Owners of an item are cut into chunks that meet each other
    in separate tasks, so no task holds all owners of a frequent item."""
    if df_share is not None:
        vectors = frequent_dropped(vectors, df_share, keep)
    keys = ["item"] + ([block] if block else [])
    met = meet_within(vectors, keys, "owner")
    pair = F.col("l.owner") < F.col("r.owner") if once else F.col("l.owner") != F.col("r.owner")
    totals = [F.col("l.total").alias("bt"), F.col("r.total").alias("tt")] if "total" in vectors.columns else []
    return met.where(pair).select(F.col("l.owner").alias("base_id"), F.col("r.owner").alias("target_id"), F.col("l.item").alias("item"), F.col("l.weight").alias("bw"), F.col("r.weight").alias("tw"), *totals)


def weighted_jaccard(vectors: DataFrame, block: str | None = None, df_share: float | None = None) -> DataFrame:
    """(base_id, target_id, score, shared): sum of minima over sum of maxima of the weights, for all pairs of owners that share an item
    (within a block). The sum of maxima over the union of keys is that over the shared ones plus what either owner has besides, so no
    outer join is needed. Every entry carries its owner's total into the join, so the pairs are shuffled once, to be summed up, and
    never again to look anything up. The measure is symmetric: every pair is computed once and given out both ways."""
    totals = vectors.groupBy("owner").agg(F.sum("weight").alias("total"))
    met = shared_items(vectors.join(totals, "owner"), block, df_share, once=True)
    pairs = met.groupBy("base_id", "target_id").agg(
        F.sum(F.least("bw", "tw")).alias("smin"), F.sum(F.greatest("bw", "tw") - F.col("bw") - F.col("tw")).alias("less"), F.max("bt").alias("tb"), F.max("tt").alias("tt"),
        F.count(F.lit(1)).alias("shared"),
    )
    scored = pairs.select("base_id", "target_id", (F.col("smin") / (F.col("less") + F.col("tb") + F.col("tt"))).alias("score"), "shared")
    ways = F.array(F.struct(F.col("base_id").alias("b"), F.col("target_id").alias("t")), F.struct(F.col("target_id").alias("b"), F.col("base_id").alias("t")))
    return scored.select(F.explode(ways).alias("w"), "score", "shared").select(F.col("w.b").alias("base_id"), F.col("w.t").alias("target_id"), "score", "shared")


#: Entries of a partition of bases.
BASE_ROWS = 100_000


def meet_narrow(vectors: DataFrame, group: list[str], base: list[str], target: list[str]) -> tuple[DataFrame, int | None]:
    """A row for each pair of entries of different owners that meet in a group, placed by the base's owner: its columns as `b_...`, the
    target's as `t_...`. Owners go through the shuffle as 4 bytes where their range allows it, less the number that is given besides."""
    low, high, n = vectors.agg(F.min("owner"), F.max("owner"), F.count(F.lit(1))).first()  # three numbers
    narrow = isinstance(low, int) and high - low < 2**31
    if narrow:
        vectors = vectors.withColumn("owner", (F.col("owner") - F.lit(low)).cast("int"))
    parts = max(n // BASE_ROWS, vectors.sparkSession.sparkContext.defaultParallelism)
    return each_pair(meet_by_base(vectors, group, "owner", ["owner", *base], ["owner", *target], parts), "owner", *target), low if narrow else None


def best_pairs(pairs: DataFrame, low: int | None, k: int, *order: Column) -> DataFrame:
    """`top_pairs` of rows by b_owner and t_owner of `meet_narrow`, with the owners as they were (base_id, target_id)."""
    top = top_pairs(pairs.withColumnRenamed("b_owner", "base_id").withColumnRenamed("t_owner", "target_id"), k, *order)
    return top if low is None else top.withColumns({c: F.col(c).cast("bigint") + F.lit(low) for c in ("base_id", "target_id")})


def top_pairs(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best targets of every base with their rank; limited before the shuffle as well (WindowGroupLimit)."""
    w = Window.partitionBy("base_id").orderBy(*order)
    return pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def align(a: Column, b: Column) -> tuple[Column, Column]:
    """(sum of minima, sum of maxima) of two map columns over the union of their keys, missing ones 0."""
    merged = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"))))
    low = F.aggregate(merged, F.lit(0.0), lambda s, v: s + F.least(v["x"], v["y"]))
    high = F.aggregate(merged, F.lit(0.0), lambda s, v: s + F.greatest(v["x"], v["y"]))
    return low, high


def map_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two map columns, 6 digits, 0 if both are empty."""
    low, high = align(a, b)
    return F.coalesce(F.round(F.try_divide(low, high), 6), F.lit(0.0))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two array columns, 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def compare_sets(a: Column, b: Column) -> dict[str, Column]:
    """What two arrays share and what either has besides, sorted."""
    return {"shared": F.sort_array(F.array_intersect(a, b)), "base_only": F.sort_array(F.array_except(a, b)), "target_only": F.sort_array(F.array_except(b, a))}
