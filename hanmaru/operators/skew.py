"""Keys that hold a large share of all rows: lookups, and groups whose rows meet in bounded pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanmaru.session import write_through

#: Up to so many rows of a looked-up table are broadcast (a few MB); beyond, it is joined by shuffle, every row at each of so many salts.
BROADCAST_ROWS = 200_000
SALTS = 64
#: Rows of a group that may meet in one task; larger groups are cut. The same at every size.
CHUNK = 4000


def join_shuffled(left: DataFrame, right: DataFrame, on: list[str] | str | Column, how: str = "inner") -> DataFrame:
    """A join that is never made a broadcast. The planner guesses a table's size from its files; it knows neither how far they are compressed
    nor how many rows Python functions and `explode` make of one, and what it broadcasts goes through the driver."""
    return left.join(right.hint("merge"), on, how)


def look_up(rows: DataFrame, table: DataFrame, on: list[str], salt: Column, how: str = "left") -> DataFrame:
    """`rows` joined with a table of one row per key, also where one key holds a large share of the rows: a table of up to
    `BROADCAST_ROWS` rows is broadcast; a larger one is repeated for every salt and the rows are spread by a hash of `salt`, so that
    no task holds all rows of a key."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_shuffled(rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")), salted, [*on, "__salt"], how).drop("__salt")


def hot_groups(df: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The groups with more than `limit` rows, and their sizes (group_rows)."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"))
    return write_through(sizes.where(F.col("group_rows") > limit), "hot-groups")


def _cells(df: DataFrame, group: list[str], key: str, chunk: int, maybe_hot: Column | None = None) -> DataFrame:
    """The rows of each group placed in cells (`group`, __low, __high), with the chunk (__part) they are of; `row` is the struct of all columns."""
    rows = df
    for name in group:
        rows = rows.where(F.col(name).isNotNull())
    hot = hot_groups((rows.where(maybe_hot) if maybe_hot is not None else rows).select(*group), group, chunk)
    parts = F.coalesce(F.ceil(F.col("group_rows") / F.lit(chunk)), F.lit(1)).cast("int")
    placed = look_up(rows, hot, group, F.col(key)).withColumn("__parts", parts).drop("group_rows")
    part = F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")
    cells = placed.withColumn("__part", part).withColumn("__meets", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return cells.select(
        *group, F.least("__part", "__meets").alias("__low"), F.greatest("__part", "__meets").alias("__high"), "__part",
        F.struct(*df.columns).alias("row"),
    )


def meet_within(df: DataFrame, group: list[str], key: str, chunk: int = CHUNK, maybe_hot: Column | None = None) -> DataFrame:
    """Joins the rows of each group with each other: columns `l` and `r`, structs of all columns of `df`. Every pair of two
    different rows comes out at least in one order; the caller keeps the order and the pairs wanted.

    A group of more than `chunk` rows is cut by a hash of the key into chunks; each pair of chunks is a join key of its own, so no
    task ever holds a group. Rows with a null in `group` meet nothing. `maybe_hot`: a condition that all rows of groups larger than
    `chunk` fulfil, to look for those among fewer rows.
    """
    side = _cells(df, group, key, chunk, maybe_hot)
    on = [*group, "__low", "__high"]
    left, right = side.alias("a"), side.alias("b")
    both = left.join(right, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
    # a cell of two different chunks holds both chunks on either side: only rows of different chunks are its own
    own = (F.col("a.__low") == F.col("a.__high")) | (F.col("a.__part") != F.col("b.__part"))
    return both.where(own).select(F.col("a.row").alias("l"), F.col("b.row").alias("r"))


def meet_by_base(df: DataFrame, group: list[str], key: str, base: list[str], target: list[str], parts: int, chunk: int = CHUNK) -> DataFrame:
    """What `meet_within` gives for different keys, as one row for each row of a group (`b_...`, of the columns `base`) with arrays of all it meets
    there (`t_...`, of the columns `target`), placed by key in `parts` partitions. A number in an array costs its own width in the
    shuffle, where a row for each pair costs several times that. A cell's arrays hold at most two chunks."""
    needed = list(dict.fromkeys([key, *base, *target]))
    cells = _cells(df, group, key, chunk).select(*group, "__low", "__high", "__part", F.struct(*[F.col("row")[c].alias(c) for c in needed]).alias("row"))
    cells = cells.withColumn("__cell", F.xxhash64(*group, "__low", "__high")).repartition("__cell")
    listed = cells.groupBy("__cell", *group, "__low", "__high").agg(F.collect_list(F.struct("__part", "row")).alias("all"))
    each = listed.select("__low", "__high", "all", F.explode("all").alias("b"))
    met = F.filter("all", lambda x: (x["row"][key] != F.col("b.row")[key]) & ((F.col("__low") == F.col("__high")) | (x["__part"] != F.col("b.__part"))))
    each = each.select(F.col("b.row").alias("row"), met.alias("met")).where(F.size("met") > 0)
    each = each.select(*[F.col("row")[c].alias(f"b_{c}") for c in base], *[F.col("met")["row"][c].alias(f"t_{c}") for c in target])
    return each.repartition(parts, f"b_{base[0]}")


def each_pair(rows: DataFrame, *target: str) -> DataFrame:
    """A row for each pair of `meet_by_base`; stays placed by the base."""
    return rows.select(*[c for c in rows.columns if c.startswith("b_")], F.inline(F.arrays_zip(*[f"t_{c}" for c in target])))
