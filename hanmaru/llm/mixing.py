"""Mixing sources to target weights.

The documents of each source, in a fixed order, are one stream of tokens cut into blocks of fixed length. A plan's mix has as
many slots as its shares and repeats allow. Its slots are spread over output shards; how many slots of a shard each source gets
is drawn: the multinomial counts of all shards, conditional on the totals, come from splitting the totals in halves again and
again by hypergeometric draws, so every shard finds its own counts without the others. A slot is the n-th use of its source;
a pseudorandom permutation of the source's blocks, another one for every repeat, says which block it is, and a join by block
number brings the tokens.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanmaru.llm.pairing import spread
from hanmaru.llm.tokens import token_sizes
from hanmaru.session import write_through

BLOCK_TOKENS = 512
SHARD_SLOTS = 1024
#: Documents of a source that share a window when offsets are summed up.
BUCKET_DOCS = 20_000


def _seed(*what: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, what)).encode(), digest_size=8).digest(), "little")


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places `index`: four Feistel rounds over the next even power of two, walked on
    until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_seed(seed, r)) for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x = out[todo]
            left, right = x >> np.uint64(half), x & mask
            for k in keys:
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(32)
                left, right = right, left ^ (f & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = out >= n
    return out.astype(np.int64)


#: numpy draws hypergeometric numbers for populations below this.
NUMPY_MOST = 1_000_000_000


def _stirling(n: float) -> float:
    """ln n! without its leading terms (n + 1/2) ln n - n + ln(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - 1 / (1260 * n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without loss of digits where the two are close."""
    v = (x - mean) / (x + mean)
    if abs(v) >= 0.1:
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    total, power, k = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        step = power / (2 * k + 1)
        if total + step == total:
            return total
        total, k = total + step, k + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """ln of the probability of x among n at p, by its saddle point: as exact for 10^15 as for 10."""
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    return _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` drawn from good + bad are good, for populations of any size: ratio of uniforms with the exact probabilities."""
    n = good + bad
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    p, mean = take / n, take * good / n
    spread_ = math.sqrt(mean * (bad / n) * ((n - take) / max(n - 1, 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread_ + 3 - 2 * math.sqrt(3 / math.e)

    def log_probability(x: int) -> float:
        return _log_binomial(x, good, p) + _log_binomial(take - x, bad, p)

    top = log_probability(min(high, max(low, (take + 1) * (good + 1) // (n + 2))))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_probability(x) - top:
            return x


def _half(rng: np.random.Generator, totals: list[int], take: int) -> list[int]:
    """How many of `take` slots drawn from all slots each source gets."""
    out, left = [], sum(totals)
    for have in totals:
        left -= have
        if not take or not have + left:
            got = 0
        elif max(have, left) < NUMPY_MOST:
            got = int(rng.hypergeometric(have, left, take))
        else:
            got = hypergeometric(rng, have, left, take)
        out.append(got)
        take -= got
    return out


def shard_counts(totals: list[int], slots: int, shards: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """(counts, starts): the slots of each source in a shard, and in all shards before it. Sums over shards are the totals."""
    low, high, starts = 0, shards, [0] * len(totals)
    everything = sum(totals)
    while high - low > 1:
        mid = (low + high) // 2
        take = min(mid * slots, everything) - min(low * slots, everything)
        first = _half(np.random.default_rng(_seed(seed, low, high)), totals, take)
        if shard < mid:
            high, totals = mid, first
        else:
            low, starts, totals = mid, [a + b for a, b in zip(starts, first, strict=True)], [a - b for a, b in zip(totals, first, strict=True)]
    return totals, starts


@dataclass(frozen=True)
class Plan:
    """A plan and what it draws: sources in order, their blocks and their slots."""

    name: str
    sources: tuple[str, ...]
    blocks: tuple[int, ...]
    slots: tuple[int, ...]


def slots_of(shares: list[float], repeats: list[int], tokens: list[int], blocks: list[int]) -> list[int]:
    """The slots of each source in the largest mix that keeps all shares and repeats. Shares are of tokens: the last block of a
    source is shorter than the others, so a slot of a source stands for its mean block. A source without tokens, or one that may
    not be used at all, gets none; the others keep their shares towards each other."""
    wanted = [(r * t / s) for s, r, t in zip(shares, repeats, tokens, strict=True) if s > 0 and t and r > 0]
    total = min(wanted, default=0.0)
    return [min(round(s * total * b / t), r * b) if t and r > 0 else 0 for s, r, t, b in zip(shares, repeats, tokens, blocks, strict=True)]


def _draw(plans: dict[str, Plan], shard_slots: int, seed: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, shard in zip(frame["plan_name"], frame["shard"], strict=True):
                plan = plans[name]
                total = sum(plan.slots)
                counts, starts = shard_counts(list(plan.slots), shard_slots, -(-total // shard_slots), int(shard), _seed(seed, name))
                order = np.random.default_rng(_seed(seed, name, shard, "order")).permutation(sum(counts))
                parts, at = [], 0
                for source, n, start, blocks in zip(plan.sources, counts, starts, plan.blocks, strict=True):
                    use = np.arange(start, start + n)
                    block = np.empty(n, dtype=np.int64)
                    for repeat in np.unique(use // blocks) if n else ():
                        mine = use // blocks == repeat
                        block[mine] = permuted(use[mine] % blocks, blocks, _seed(seed, name, source, int(repeat)))
                    parts.append(pd.DataFrame({"plan_name": name, "shard": int(shard), "slot": order[at : at + n], "source": source, "repeat_no": use // max(blocks, 1), "block": block}))
                    at += n
                yield pd.concat(parts, ignore_index=True)

    return run


def blocks_of(sized: DataFrame, key: str, source: str, block_tokens: int, rows: int) -> DataFrame:
    """(source, block, key, token_from, tokens): the pieces of documents in the blocks of each source's stream. Offsets are summed
    per bucket of documents and then over buckets, so that no window holds a source."""
    buckets = max(1, -(-rows // BUCKET_DOCS))
    placed = spread(sized, key, buckets, "bucket")
    sums = placed.groupBy(source, "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(source, "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(source, "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, [source, "bucket"])
    at = at.select(F.col(source).alias("source"), key, (F.col("start") + F.col("ahead")).alias("a"), (F.col("start") + F.col("ahead") + F.col("n_tokens")).alias("b"))
    size = F.lit(block_tokens)
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    low, high = F.greatest("a", F.col("block") * size), F.least("b", (F.col("block") + 1) * size)
    return pieces.select("source", "block", key, (low - F.col("a")).alias("token_from"), (high - low).alias("tokens"))


def mix_sources(docs: DataFrame, key: str, text: str, source: str, targets: list[tuple[str, str, float, int]], block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """(plan_name, shard, slot, source, repeat_no, block, key, token_from, tokens): the mix of each plan, piece by piece.

    `targets`: (plan, source, target share, most repeats). The mix is the largest one in which every source has its share of the
    slots and no block is used more often than its source may be repeated; a repeat uses every block once. Shares of a plan that do
    not add up to 1 are scaled. A source of a plan that has no documents gets no slots: the mix is made of the others, which keep
    their shares towards each other, and `share_report` says that the source reached 0. Targets with a null in them and
    documents without a source, of other sources, or without tokens are in no plan.
    """
    targets = [t for t in targets if None not in t]
    spark = docs.sparkSession
    wanted = sorted({t[1] for t in targets})
    chosen = docs.where(F.col(source).isin(wanted)).select(F.col(key).alias("item"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = write_through(token_sizes(chosen, "item", "text", "source").where("n_tokens > 0"), "token-sizes")
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()  # as many rows as the plans have sources
    tokens = {r.source: r.tokens for r in per_source}
    plans: dict[str, Plan] = {}
    for name in sorted({t[0] for t in targets}):
        mine = sorted((t for t in targets if t[0] == name), key=lambda t: t[1])
        whole = sum(t[2] for t in mine) or 1.0
        have = [tokens.get(t[1], 0) for t in mine]
        blocks = [-(-n // block_tokens) for n in have]
        slots = slots_of([t[2] / whole for t in mine], [t[3] for t in mine], have, blocks)
        if sum(slots):
            plans[name] = Plan(name, tuple(t[1] for t in mine), tuple(blocks), tuple(slots))
    schema = "plan_name string, shard bigint, slot bigint, source string, repeat_no bigint, block bigint"
    shards = None
    for p in plans.values():
        part = spark.range(-(-sum(p.slots) // shard_slots)).select(F.lit(p.name).alias("plan_name"), F.col("id").alias("shard"))
        shards = part if shards is None else shards.unionByName(part)
    if shards is None:
        return spark.createDataFrame([], f"{schema}, `{key}` {dict(docs.dtypes)[key]}, token_from bigint, tokens bigint")
    drawn = shards.mapInPandas(_draw(plans, shard_slots, seed), schema)
    pieces = blocks_of(sized, "item", "source", block_tokens, sum(r.docs for r in per_source))
    out = drawn.join(pieces, ["source", "block"])
    return out.select("plan_name", "shard", "slot", "source", "repeat_no", "block", F.col("item").alias(key), "token_from", "tokens")


def share_report(mixed: DataFrame, key: str, targets: list[tuple[str, str, float, int]]) -> DataFrame:
    """(plan_name, source, target_share, max_repeats, tokens, reached_share, documents, most_uses) of a mix."""
    spark = mixed.sparkSession
    goal = spark.createDataFrame(targets, "plan_name string, source string, target_share double, max_repeats int")
    per_doc = mixed.groupBy("plan_name", "source", key).agg(F.sum("tokens").alias("tokens"), (F.max("repeat_no") + 1).alias("uses"))
    sums = per_doc.groupBy("plan_name", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy("plan_name"))
    return goal.join(sums, ["plan_name", "source"], "left").select(
        "plan_name", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(share, F.lit(0.0)).alias("reached_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
