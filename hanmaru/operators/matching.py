"""Entity matching: tiers tried in order and their trace, unique aliases, lexical and vector candidates, their merge and what is accepted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanmaru.functions import text
from hanmaru.operators.rows import first_per_key

#: A list side of a join is broadcast up to so many rows; a longer one is joined by shuffle.
LIST_ROWS = 100_000
#: Letters that stand together in the index of keys; shorter keys are looked up as a whole.
GRAM = 4


def small(df: DataFrame) -> DataFrame:
    """A broadcast side after a check of its size; larger lists are joined as Spark plans it."""
    return F.broadcast(df) if df.limit(LIST_ROWS + 1).count() <= LIST_ROWS else df


def trace(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame, Column, list[Column]]]) -> DataFrame:
    """(key, tier, tier_name, entry, place): what every tier finds for every row, best first by the tier's order, then by entry. A tier is
    (name, candidates, join condition, order); candidates have a column `entry`. Every tier is an equi join of its own."""
    found = None
    for number, (name, candidates, on, order) in enumerate(tiers):
        hits = rows.join(candidates, on).select(F.col(key), F.lit(number).alias("tier"), F.lit(name).alias("tier_name"), "entry", F.struct(*order).alias("o"))
        best = hits.groupBy(key, "tier", "tier_name", "entry").agg(F.min("o").alias("o"))
        ranked = best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("o", "entry"))).drop("o")
        found = ranked if found is None else found.unionByName(ranked)
    return found


def cascade(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame, Column, list[Column]]]) -> DataFrame:
    """The first tier with a match wins for every row; within a tier the order given decides. Tiers are those of `trace`. Rows no tier
    matches come out with nulls. One aggregation picks the winner."""
    found = None
    for number, (name, candidates, on, order) in enumerate(tiers):
        hits = rows.join(candidates, on).select(F.col(key), F.lit(number).alias("tier"), F.lit(name).alias("tier_name"), "entry", F.struct(*order).alias("o"))
        best = first_per_key(hits, [key], F.col("o"), F.col("entry")).select(key, "tier", "tier_name", "entry")
        found = best if found is None else found.unionByName(best)
    winner = found.groupBy(key).agg(F.min(F.struct("tier", "tier_name", "entry")).alias("w"))
    return rows.select(key).join(winner, key, "left").select(key, F.col("w.tier_name").alias("tier_name"), F.col("w.entry").alias("entry"))


def unique_aliases(aliases: DataFrame, alias: str, entry: str) -> DataFrame:
    """Aliases that mean one entry only."""
    return aliases.groupBy(alias).agg(F.min(entry).alias(entry), F.max(entry).alias("__max")).where(F.col(entry) == F.col("__max")).drop("__max")


def _grams(key: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - GRAM + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(GRAM))))


def contained(names: DataFrame, name_key: str, entries: DataFrame, alias_key: str, least: int = GRAM) -> DataFrame:
    """Names joined with the entries whose key of `least` letters or more (at least `GRAM`) is within the name, or within whose key the
    name of as many letters is, and those whose key is equal. Keys are found by an index of the letters they begin with, in an equi
    join with those of the other side; containment is verified. No pair comes out twice."""
    n, a = F.col(name_key), F.col(alias_key)
    least = max(least, GRAM)
    listed = small(entries)
    equal = names.join(listed, n == a)
    named = names.where(F.length(n) >= least)
    keyed = entries.where(F.length(a) >= least)
    inside = named.withColumn("__gram", F.explode(_grams(n))).join(small(keyed.withColumn("__gram", F.substring(a, 1, GRAM))), "__gram").where(F.contains(n, a) & (n != a))
    around = named.withColumn("__gram", F.substring(n, 1, GRAM)).join(small(keyed.withColumn("__gram", F.explode(_grams(a)))), "__gram").where(F.contains(a, n) & (n != a))
    return equal.unionByName(inside.drop("__gram")).unionByName(around.drop("__gram"))


def lexical_candidates(names: DataFrame, name_key: str, entries: DataFrame, alias_key: str, entry: str, k: int, suffixes: list[str] | None = None) -> DataFrame:
    """The k best entries of every name: 1.0 equal keys, 0.95 equal without endings (`suffixes`), 0.78 a key of four or more letters within
    the name, 0.70 the name of four or more within a key."""
    n, a = F.col(name_key), F.col(alias_key)
    score = F.when(n == a, 1.0).when(F.contains(n, a), 0.78).otherwise(0.70)
    once = names.select(name_key).where(F.length(n) > 0).distinct()
    listed = entries.select(entry, alias_key).where(F.length(a) > 0)
    met = contained(once, name_key, listed, alias_key).select(name_key, entry, score.alias("lexical"))
    if suffixes:
        bare, listed_bare = text.strip_suffixes(n, suffixes), text.strip_suffixes(a, suffixes)
        alike = once.withColumn("__bare", bare).join(small(listed.withColumn("__bare", listed_bare)), "__bare")
        met = met.unionByName(alike.select(name_key, entry, F.lit(0.95).alias("lexical")))
    best = met.groupBy(name_key, entry).agg(F.max("lexical").alias("lexical"))
    w = Window.partitionBy(name_key).orderBy(F.desc("lexical"), entry)
    return best.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def letter_vector(key: Column, size: int = 64) -> Column:
    """A vector of a key without a model: its pairs of neighbouring letters, ends included, counted by a sum of their codes modulo `size`.
    A null or empty key has no vector (null)."""
    framed = F.concat(F.lit("^"), key, F.lit("$"))
    codes = F.transform(F.sequence(F.lit(1), F.length(framed)), lambda i: F.ascii(F.substring(framed, i, F.lit(1))))

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """`body` of a value that is computed once."""
        return F.transform(F.array(value), body)[0]

    def counts(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.size(F.filter(places, lambda p: p == j)).cast("double"))

    def places(c: Column) -> Column:
        return F.transform(F.slice(c, 2, F.size(c)), lambda x, i: (F.element_at(c, i + 1) * 31 + x) % size)

    return F.when(F.length(key) > 0, bound(bound(codes, places), counts))


def merge_candidates(name: str, entry: str, k: int, **scores: DataFrame) -> DataFrame:
    """Candidate lists merged by (name, entry): the highest of each score, best of all scores first, then the single scores, then the entry."""
    out = None
    for score, df in scores.items():
        part = df.select(name, entry, *[(F.col(score) if s == score else F.lit(None)).cast("double").alias(s) for s in scores])
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy(name, entry).agg(*[F.coalesce(F.max(s), F.lit(0.0)).alias(s) for s in scores])
    top = F.greatest(*scores) if len(scores) > 1 else F.col(next(iter(scores)))
    w = Window.partitionBy(name).orderBy(top.desc(), *[F.desc(s) for s in scores], entry)
    return merged.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def accepted(candidates: DataFrame, name: str, entry: str, lexical: str, vector: str) -> DataFrame:
    """(name, entry, method) of the first candidate of a name where it is good enough: 0.95 lexical, or 0.92 by vectors and 0.08 more than
    the next one by vectors."""
    w = Window.partitionBy(name)
    best = candidates.withColumn("__second", F.max(F.when(F.col("rk") > 1, F.col(vector))).over(w)).where("rk = 1")
    margin = F.col(vector) - F.coalesce("__second", F.lit(0.0))
    method = F.when(F.col(lexical) >= 0.95, "lexical").when((F.col(vector) >= 0.92) & (F.round(margin, 6) >= 0.08), "vector")
    return best.select(name, entry, method.alias("method")).where(F.col("method").isNotNull())


def _packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """(block, ids, matrix): rows in blocks of about `block` rows, each an array of ids and one of all their numbers."""
    blocks = max(1, -(-rows.count() // block))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))))
    packed = numbered.groupBy("block").agg(listed.alias("r"))
    return packed.select("block", F.transform("r", lambda x: x["i"]).alias("ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias("numbers"))


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block_rows: int = 4096) -> DataFrame:
    """(query_id, neighbour_id, cosine, rk): the k nearest rows of every query by cosine to six digits, then by the smaller id, exactly.

    Both sides are packed in blocks of about `block_rows` rows; every block of queries meets every block of the corpus, one matrix
    product in a task, and keeps the k best of each query (with ties), which are all that is shuffled after. So there may be any
    number of queries; a task holds one block of either side. Rows without a vector are left out.
    """
    q = _packed(queries.select(key, vector).where(F.col(vector).isNotNull()), key, vector, block_rows)
    c = _packed(corpus.select(key, vector).where(F.col(vector).isNotNull()), key, vector, block_rows)
    count = c.agg(F.max("block")).first()[0]  # one number
    everywhere = q.select(F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"), F.explode(F.sequence(F.lit(0), F.lit(count or 0))).alias("block"))
    met = everywhere.join(c, "block").select("q_ids", "q_numbers", "ids", "numbers")

    def unit(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        m = np.asarray(numbers, dtype=np.float64).reshape(len(ids), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_numbers, ids, numbers in frame.itertuples(index=False):
                qi, ci = np.asarray(q_ids), np.asarray(ids)
                s = np.round(unit(qi, q_numbers) @ unit(ci, numbers).T, 6)
                s[qi[:, None] == ci[None, :]] = -np.inf
                take = min(k, s.shape[1])
                kth = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
                r, j = np.nonzero((s >= kth) & np.isfinite(s))  # ties of the k-th all stay
                yield pd.DataFrame({"query_id": qi[r], "neighbour_id": ci[j], "cosine": s[r, j]})

    near = met.mapInPandas(run, "query_id long, neighbour_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id")
    return near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
