"""Row-level operators: one row per key, replacement, merging of versions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanmaru.session import write_through


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in the given order. Only the columns needed for the order meet in a sort; a key with many rows costs a
    partial limit before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def dedupe_with_dropped(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): one row per key, the first or the last in the given order (ties: by the other columns), and every other row.
    Rows with a null in a key are never duplicates. Aggregates only: equal rows are counted first, and no key is sorted."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *rest)
    counted = df.where(complete).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__row", row)
    best = counted.groupBy(*keys).agg((F.max if keep == "last" else F.min)("__row").alias("__best"))
    kept = best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns]).unionByName(df.where(~complete))
    surplus = counted.join(best, keys).withColumn("__n", F.col("__n") - (F.col("__row") == F.col("__best")).cast("int")).where("__n > 0")
    return kept, surplus.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*df.columns)


def replace_keys(base: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows whose key the newer rows do not have, and all newer rows (retry replacement, delete-then-insert)."""
    return base.join(newer.select(*keys).distinct(), keys, "left_anti").unionByName(newer, allowMissingColumns=True)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Insert or update by key; of several changes to a key the one with the highest version wins. Columns that changes lack keep the
    value of the base row, as in an update that does not name them; in new rows they are null."""
    newest = first_per_key(changes, keys, version.desc_nulls_last())
    lacking = [c for c in base.columns if c not in changes.columns]
    if lacking:
        newest = newest.join(base.select(*keys, *lacking).drop_duplicates(keys), keys, "left")
    return replace_keys(base, newest.select(*base.columns), keys)


def backfill(left: DataFrame, right: DataFrame, keys: list[str], texts: list[str], numbers: list[str]) -> DataFrame:
    """Left rows whose empty texts and numbers not above 0 are filled from the right row of the same key, which must be one per key."""
    other = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in (*texts, *numbers)])
    value = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"__{c}"), F.lit(""))) for c in texts}
    value |= {c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c))) for c in numbers}
    return left.join(other, keys, "left").select(*[value[c].alias(c) if c in value else F.col(c) for c in left.columns])


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: new values where the condition is true; where it is false or null rows stay. All values are computed
    from the old row."""
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... WHERE: rows for which the condition is true go."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def invalidate(cache: DataFrame, ids: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """Cache rows none of whose `columns` is among the ids. The ids meet each column in an anti join."""
    keys = ids.select(F.col(id_column).alias("__id")).where(F.col(id_column).isNotNull()).distinct()
    for c in columns:
        cache = cache.join(keys, cache[c] == keys["__id"], "left_anti")
    return cache


def latest_by_key(df: DataFrame, keys: list[str], *versions: str) -> DataFrame:
    """The latest row of every key as an aggregate (max_by), without a sort; ties fall to the largest row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(v) for v in versions], F.struct(*rest))).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows expected and there, and how many are missing or too many."""
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    a = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = e.join(a, keys, "full_outer").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "actual")])
    return both.select(*keys, "expected", "actual", F.greatest(F.lit(0), F.col("expected") - F.col("actual")).alias("missing"), F.greatest(F.lit(0), F.col("actual") - F.col("expected")).alias("extra"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows with the total count; a page beyond the last becomes the last. A bounded result: the rows of a page."""
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("page_no", F.lit(number)).withColumn("total_rows", F.lit(total))


def union_padded(*tagged: tuple[str, DataFrame]) -> DataFrame:
    """UNION ALL of tables with unequal columns, missing ones null, each row tagged with its origin."""
    out = None
    for tag, df in tagged:
        part = df.withColumn("origin", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, size: int, seed: int, forced: list | None = None) -> DataFrame:
    """A sample of `size` rows: forced keys first, then up to `per_stratum` of every stratum, then any others, each in the order of a
    seeded digest of the key. The limit is the operator's purpose."""
    rank = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    is_forced = F.col(key).isin(forced or [])
    w = Window.partitionBy(stratum).orderBy(rank, key)
    tiered = df.withColumn("__tier", F.when(is_forced, 0).when(F.row_number().over(w) <= per_stratum, 1).otherwise(2))
    return tiered.orderBy("__tier", rank, key).limit(size).drop("__tier")


def join_labels(labels: DataFrame, rows: DataFrame, group: str, item: str, rank: str) -> tuple[DataFrame, DataFrame]:
    """(joined, errors): labels meet the rows of their group by the item's id, else, where they have none that is there, by the rank.
    Errors (all label columns and `error`): labels that meet no row, and all but the first label of a row ('duplicate')."""
    numbered = write_through(labels.withColumn("__label", F.monotonically_increasing_id()), "labels")  # the numbers must stay what they are
    target = rows.withColumn("__row", F.struct(*rows.columns)).select(F.col(group).alias("__g"), F.col(item).alias("__i"), F.col(rank).alias("__r"), "__row")
    by_id = numbered.join(target.select("__g", "__i", F.col("__row").alias("__by_id")), (F.col(group) == F.col("__g")) & (F.col(item) == F.col("__i")), "left").drop("__g", "__i")
    both = by_id.join(target.select("__g", "__r", F.col("__row").alias("__by_rank")), (F.col(group) == F.col("__g")) & (F.col(rank) == F.col("__r")) & F.col("__by_id").isNull(), "left").drop("__g", "__r")
    met = both.withColumn("__row", F.coalesce("__by_id", "__by_rank")).drop("__by_id", "__by_rank")
    first = met.where(F.col("__row").isNotNull()).groupBy("__row").agg(F.min("__label").alias("__first"))
    marked = met.join(first, "__row", "left")
    error = F.when(F.col("__row").isNull(), "missing").when(F.col("__label") != F.col("__first"), "duplicate")
    marked = marked.withColumn("error", error)
    joined = marked.where(F.col("error").isNull()).select(*[F.col(c) if c not in (item, rank) else F.col(f"__row.{c}").alias(c) for c in labels.columns], *[F.col(f"__row.{c}").alias(c) for c in rows.columns if c not in labels.columns])
    return joined, marked.where(F.col("error").isNotNull()).select(*labels.columns, "error")


def flat_lists(df: DataFrame, column: str, place: str) -> DataFrame:
    """One row per item of a list of structs: its fields as columns, its place from 0, and the other columns; rows without items go."""
    item = F.posexplode(column).alias(place, "__item")
    others = [c for c in df.columns if c != column]
    return df.select(*others, item).select(*others, place, "__item.*")
