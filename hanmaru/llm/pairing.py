"""Pairs within groups, and parts no key fills alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmaru.operators.skew import BROADCAST_ROWS, CHUNK, hot_groups, join_shuffled, look_up, meet_within

__all__ = ["BROADCAST_ROWS", "CHUNK", "hot_groups", "join_shuffled", "look_up", "meet_within", "pairs_within", "spread"]


def spread(df: DataFrame, key: str, parts: int, into: str) -> DataFrame:
    """Adds `into`, a part from 0 to parts - 1 by a hash of the key. The rows of a key met more often than 1000 times are spread by
    their place in the table as well, so no part holds a hot key; read such a table from files, as places in it must stay when a
    task is repeated."""
    place = F.monotonically_increasing_id()
    marked = look_up(df.withColumn("__place", place), hot_groups(df.select(key), [key], 1000), [key], F.col("__place"))
    own = F.when(F.col("group_rows").isNotNull(), F.col("__place"))
    return marked.withColumn(into, F.pmod(F.xxhash64(key, own), F.lit(parts)).cast("int")).drop("group_rows", "__place")


def pairs_within(df: DataFrame, group: str, key: str, differ: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(left_key, right_key): all pairs of different keys of a group, smaller key first; with `differ`, only of rows that differ
    in that column. Rows with a null group make no pairs."""
    met = meet_within(df.select(group, key, *([differ] if differ else [])), [group], key, chunk)
    wanted = F.col(f"l.{key}") < F.col(f"r.{key}")
    if differ:
        wanted &= F.col(f"l.{differ}") != F.col(f"r.{differ}")
    return met.where(wanted).select(F.col(f"l.{key}").alias("left_key"), F.col(f"r.{key}").alias("right_key"))
