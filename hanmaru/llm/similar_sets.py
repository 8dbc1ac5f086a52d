"""All similar pairs between set-valued records: metric pivot partitioning under Jaccard distance.

Pivots are a bounded number of the sets, those with the most copies, as families of near-copies gather round such. A set lives in the ball of its nearest pivot if it is within `radius` of it, else in
the outer cell. The triangle inequality bounds where its partners (distance at most r = 1 - threshold) can live:

* a partner living in ball q is within `radius` of q, and no farther from q than from the pivot nearest to this set; so this
  set visits q only if d(x, q) <= min(radius, d(x, nearest)) + r (with one more r for the second bound);
* a partner living in the outer cell is farther than `radius` from every pivot; so a set of a ball visits the outer cell only
  if its own distance exceeds radius - r.

Since radius + r < 1, a set never needs to visit a pivot it shares nothing with. Within a cell the join is exact: rows meet on
the tokens of their prefixes in order of global rarity, length and position bounds cut further, and the overlap is counted in
full. A pair is given out in one cell only. Equal sets are joined once, as one representative, and expanded at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanmaru.llm.pairing import BROADCAST_ROWS, meet_within, pairs_within
from hanmaru.session import write_through

OUTER = -1
EPS = 1e-9


def _ordered_with_pivots(sets: DataFrame, pivots: DataFrame, hot_share: int, chunk: int) -> DataFrame:
    """Each distinct set with its tokens rarest first and, with repeats, the pivots that hold its tokens. Frequencies are told apart only
    for tokens in more than a `hot_share`-th of the places or in more sets than half a chunk; all others count as rare."""
    tokens = sets.select("scope", "set_id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("freq"))
    total = tokens.count()
    hot = write_through(counts.where(F.col("freq") > max(2, min(total // hot_share, chunk // 2))), "hot-tokens")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    at = pivots.select("scope", "pivot", F.explode("tokens").alias("token")).groupBy("scope", "token").agg(F.collect_list("pivot").alias("pivots"))
    known = tokens.join(hot, ["scope", "token"], "left").join(F.broadcast(at), ["scope", "token"], "left")
    return known.groupBy("scope", "set_id").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token"))).alias("ranked"),
        F.flatten(F.collect_list("pivots")).alias("near"),
    )


def _cells(ordered: DataFrame, pivot_sizes: list[int], threshold: float, radius: float) -> DataFrame:
    """Adds n, home and the cells a set is in (its home and those it visits)."""
    r = 1 - threshold
    sizes = F.array(*[F.lit(s) for s in pivot_sizes]) if pivot_sizes else F.array(F.lit(0))
    out = ordered.withColumn("n", F.size("ranked"))

    def distance(p: Column) -> Column:
        shared = F.size(F.filter("near", lambda x: x == p))
        return F.lit(1.0) - shared / (F.col("n") + F.element_at(sizes, p + 1) - shared)

    out = out.withColumn("dist", F.array_sort(F.transform(F.array_distinct("near"), lambda p: F.struct(distance(p).alias("d"), p.alias("p"))))).drop("near")
    first = F.get("dist", F.lit(0))
    out = out.withColumn("d0", F.coalesce(first["d"], F.lit(1.0))).withColumn("home", F.when(F.col("d0") <= radius, first["p"]).otherwise(F.lit(OUTER)))
    bound = F.least(F.lit(radius) + r, F.col("d0") + 2 * r) + EPS
    visits = F.transform(F.filter("dist", lambda x: (x["d"] <= bound) & (x["p"] != F.col("home"))), lambda x: x["p"])
    outer = F.when((F.col("home") != OUTER) & (F.col("d0") > radius - r - EPS), F.array(F.lit(OUTER))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("cells", F.concat(F.array("home"), visits, outer)).drop("dist", "d0")


def pivots_for(sets: int) -> int:
    """How many pivots so many distinct sets get: 16, more from 65,536 sets on with their square root, and 256 at most. Every set is
    compared with every pivot it shares a value with, and the pivots are broadcast, so their number is bounded."""
    return min(256, max(16, math.isqrt(sets) // 16))


def similar_distinct_sets(sets: DataFrame, threshold: float, pivots: int | None = None, radius: float = 0.55, hot_share: int = 10_000, chunk: int = 4000) -> DataFrame:
    """(left_id, right_id): all pairs of distinct sets (scope, set_id, tokens, copies) of one scope with Jaccard similarity >= threshold."""
    r = 1 - threshold
    if radius + r >= 1:
        raise ValueError("radius must stay below the threshold, else every set would visit every pivot")
    pivots = pivots_for(sets.count()) if pivots is None else pivots
    sample = [row.set_id for row in sets.orderBy(F.desc("copies"), "set_id").limit(pivots).select("set_id").collect()]  # at most `pivots` rows
    order = {s: i for i, s in enumerate(sample)}
    chosen = [(row.scope, order[row.set_id], row.tokens) for row in sets.where(F.col("set_id").isin(sample)).collect()] if sample else []
    spark = sets.sparkSession
    pivot_rows = spark.createDataFrame(chosen, "scope string, pivot int, tokens array<bigint>")
    sizes = [0] * len(sample)
    for _, i, tokens in chosen:
        sizes[i] = len(tokens)
    ordered = _ordered_with_pivots(sets, pivot_rows, hot_share, chunk)
    celled = write_through(_cells(ordered, sizes, threshold, radius), "cells")  # read three times below
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(EPS)).cast("int") + 1
    lists = celled.select("scope", "set_id", "n", "home", "cells", F.transform("ranked", lambda x: x["token"]).alias("tokens"), F.slice("ranked", F.lit(1), prefix).alias("head"))
    placed = lists.select("scope", "set_id", "n", "home", "tokens", F.size("head").alias("p"), F.explode("cells").alias("cell"), "head")
    entries = placed.select("scope", "cell", F.posexplode("head").alias("pos", "entry"), "set_id", "n", "home", "tokens", "p").select(
        "scope", "cell", F.col("entry.token").alias("token"), F.col("entry.freq").alias("freq"), "pos", "set_id", "n", "home", "tokens", "p"
    )
    # only tokens whose frequency is known can make a group larger than a chunk
    met = meet_within(entries, ["scope", "cell", "token"], "set_id", chunk, F.col("freq") > 0)
    least = F.ceil((F.col("l.n") + F.col("r.n")) * F.lit(threshold / (1 + threshold)) - F.lit(EPS))
    possible = (
        (F.col("l.set_id") < F.col("r.set_id"))
        & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * F.lit(threshold) - F.lit(EPS))
        & ((F.col("l.home") == F.col("r.home")) & (F.col("l.home") == F.col("l.cell")) | (F.col("l.home") != F.col("r.home")) & (F.col("l.cell") == F.least("l.home", "r.home")))
        & (F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos")) >= least)
    )
    heads = F.array_intersect(F.slice("l.tokens", F.lit(1), F.col("l.p")), F.slice("r.tokens", F.lit(1), F.col("r.p")))
    once = F.get(heads, F.lit(0)) == F.col("l.token")
    exact = F.size(F.array_intersect("l.tokens", "r.tokens")) >= least
    return met.where(possible).where(once).where(exact).select(F.col("l.set_id").alias("left_id"), F.col("r.set_id").alias("right_id"))


def similar_pairs(records: DataFrame, threshold: float = 0.7, **options: int | float) -> DataFrame:
    """(scope, left_key, right_key): all pairs of different keys of a scope whose sets have Jaccard similarity >= threshold,
    smaller key (as a string) first.

    `records`: scope, key and `tokens`, an array of values. A key met in several rows counts once, with the union of its
    values; null and repeated values count as none; keys without any value, null keys and null arrays make no pairs. Values
    are compared by a 64-bit hash, sets by 128 bits of hashes.
    """
    hashed = F.filter(F.transform("tokens", lambda t: F.when(t.isNotNull(), F.xxhash64(t))), lambda h: h.isNotNull())
    rows = records.where(F.col("key").isNotNull()).select("scope", F.col("key").cast("string").alias("key"), F.array_sort(F.array_distinct(hashed)).alias("tokens")).where(F.size("tokens") > 0)
    joined = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens"))))
    keyed = rows.groupBy("scope", "key").agg(joined.alias("tokens"))
    keyed = write_through(
        keyed.withColumn("set_id", F.concat(F.hex(F.xxhash64(F.lit(1), "scope", "tokens")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), "scope", "tokens")))), "sets"
    )
    distinct = keyed.groupBy("set_id").agg(F.first("scope").alias("scope"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    distinct = write_through(distinct.select("scope", "set_id", "tokens", "copies"), "distinct-sets")
    several = distinct.where(F.col("copies") > 1).select("set_id")
    members = keyed.select("scope", "set_id", "key")
    equal = pairs_within(members.join(several, "set_id").select("set_id", F.struct("scope", "key").alias("member")), "set_id", "member")
    equal = equal.select(F.col("left_key.scope").alias("scope"), F.col("left_key.key").alias("a"), F.col("right_key.key").alias("b"))
    links = similar_distinct_sets(distinct, threshold, **options)
    other = (
        links.join(members.select(F.col("set_id").alias("left_id"), "scope", F.col("key").alias("a")), "left_id")
        .join(members.select(F.col("set_id").alias("right_id"), F.col("key").alias("b")), "right_id")
        .select("scope", "a", "b")
    )
    return equal.unionByName(other).select("scope", F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"))
