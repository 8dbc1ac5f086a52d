import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from hanmaru.llm import mixing, tokens

TARGETS = [("p", "a", 0.5, 1), ("p", "b", 0.3, 2), ("p", "c", 0.2, 4), ("q", "a", 0.9, 1), ("q", "missing", 0.1, 3)]


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(mixing.permuted(np.arange(100), 100, 1)) != list(mixing.permuted(np.arange(100), 100, 2))


def test_counts_of_shards_add_up():
    totals, slots = [700, 50, 3, 0], 32
    shards = -(-sum(totals) // slots)
    sums, spread = [0] * 4, []
    for s in range(shards):
        counts, starts = mixing.shard_counts(totals, slots, shards, s, 9)
        assert starts == sums
        assert sum(counts) == min(slots, sum(totals) - s * slots)
        sums = [a + b for a, b in zip(sums, counts, strict=True)]
        spread.append(counts[0])
    assert sums == totals and len(set(spread)) > 1


def test_draws_of_any_size_against_probabilities():
    rng = np.random.default_rng(3)
    good, bad, take = 30, 50, 20
    seen = Counter(mixing.hypergeometric(rng, good, bad, take) for _ in range(20_000))
    for x in range(21):
        p = math.comb(good, x) * math.comb(bad, take - x) / math.comb(good + bad, take)
        assert abs(seen[x] / 20_000 - p) < 5 * math.sqrt(p / 20_000) + 1e-4
    assert mixing.hypergeometric(rng, 5, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 5, 3) == 0


@pytest.mark.parametrize("size", [900_000_000, 1_000_000_000, 10**12, 10**15])
def test_draws_do_not_stop_at_a_size(size):
    totals, take = [size, size // 2, 7], size // 3
    draws = [mixing._half(np.random.default_rng(s), totals, take) for s in range(200)]
    assert all(sum(d) == take and all(0 <= g <= h for g, h in zip(d, totals, strict=True)) for d in draws)
    first = np.array([d[0] for d in draws], dtype=float)
    n = sum(totals)
    deviation = math.sqrt(take * (size / n) * (1 - size / n) * (n - take) / (n - 1))
    assert len(set(first)) > 150
    assert abs(first.mean() - take * size / n) < 5 * deviation / math.sqrt(200)
    assert 0.8 < first.std() / deviation < 1.2


@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no vocabulary files")
def test_mix(spark):
    rng = np.random.default_rng(1)
    words = "비타민 칼슘 the label food".split()
    rows, n = [], 0
    for source, docs in (("a", 400), ("b", 150), ("c", 30), ("other", 20), (None, 20)):
        for _ in range(docs):
            rows.append((n, " ".join(rng.choice(words, size=rng.integers(1, 80))), source))
            n += 1
    rows += [(9001, None, "a"), (9002, "", "a"), (None, "x", "a")]
    df = spark.createDataFrame(rows, "k long, text string, source string")
    mixed = mixing.mix_sources(df, "k", "text", "source", TARGETS, block_tokens=32, shard_slots=50).cache()
    got = mixed.collect()
    assert {r.plan_name for r in got} == {"p", "q"}
    assert {r.source for r in got if r.plan_name == "q"} == {"a"}  # the other source of q has no documents
    got = [r for r in got if r.plan_name == "p"]
    source = {k: s for k, _, s in rows}
    assert all(source[r.k] == r.source for r in got)
    slots = defaultdict(set)
    uses = Counter()
    for r in got:
        slots[r.shard, r.slot].add((r.source, r.block, r.repeat_no))
        uses[r.k, r.token_from] += 1
    assert all(len(v) == 1 for v in slots.values())
    most = {s: m for p, s, _, m in TARGETS if p == "p"}
    assert all(n <= most[source[k]] for (k, _), n in uses.items())
    shares = {r.source: r for r in mixing.share_report(mixed, "k", TARGETS).where("plan_name = 'p'").collect()}
    for p, s, share, _ in TARGETS:
        if p == "p":
            assert abs(shares[s].reached_share - share) < 0.01
    limits = {s: most[s] * sum(len(tokens.encoding().encode_ordinary(t)) for _, t, x in rows if x == s and t) / share for p, s, share, _ in TARGETS if p == "p"}
    assert sum(r.tokens for r in shares.values()) > 0.97 * min(limits.values())
    again = mixing.mix_sources(df.repartition(3), "k", "text", "source", TARGETS, block_tokens=32, shard_slots=50).collect()
    assert sorted(tuple(r) for r in again if r.plan_name == "p") == sorted(map(tuple, got))
    report = {r.source: r.reached_share for r in mixing.share_report(mixed, "k", TARGETS).where("plan_name = 'q'").collect()}
    assert report == {"a": 1.0, "missing": 0.0}


@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no vocabulary files")
def test_empty(spark):
    df = spark.createDataFrame([], "k long, text string, source string")
    assert mixing.mix_sources(df, "k", "text", "source", TARGETS).count() == 0
