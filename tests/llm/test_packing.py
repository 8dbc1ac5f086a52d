from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from hanmaru.llm import packing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no vocabulary files")
CAPACITIES = [("short", 16), ("long", 64)]


def docs(spark):
    words = "비타민 칼슘 추출물 분말 health food the of label capsule".split()
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(900, texts[0]), (901, None), (902, ""), (None, "x"), (903, "가" * 3000)]
    return spark.createDataFrame(rows, "k long, text string")


def test_every_token_once_and_capacity_kept(spark):
    df = docs(spark)
    size = {r.k: r.n_tokens for r in tokens.token_sizes(df, "k", "text").collect()}
    coder = tokens.encoding()
    assert all(size[r.k] == len(coder.encode_ordinary(r.text)) for r in df.where("k is not null and text <> ''").collect())
    rows = packing.pack_documents(df, "k", "text", CAPACITIES, shard_tokens=2000).collect()
    for name, capacity in CAPACITIES:
        spans, load = defaultdict(list), defaultdict(int)
        for r in rows:
            if r.pack_name == name:
                spans[r.k].append((r.token_from, r.tokens))
                load[r.shard, r.container] += r.tokens
        assert max(load.values()) <= capacity
        assert spans.keys() == size.keys()
        for k, parts in spans.items():
            parts.sort()
            assert [p for p, _ in parts] == list(np.cumsum([0, *[n for _, n in parts][:-1]]))
            assert sum(n for _, n in parts) == size[k]
            assert len(parts) == 1 or size[k] > capacity
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    packed = spark.createDataFrame(rows)
    sized = tokens.token_sizes(df, "k", "text")
    checked = packing.check_packs(packed, sized, "k", CAPACITIES).collect()
    assert len(checked) == 2 * len(size) and all(r.whole and r.kept for r in checked)
    worse = packing.check_packs(packed.where("k <> 3 or tokens <> 64").where("k <> 5"), sized, "k", [("short", 8), ("long", 64)]).where("not whole or not kept").collect()
    assert {5} <= {r.k for r in worse if r.pack_name == "long" and not r.whole} <= {3, 5}
    assert any(not r.kept for r in worse if r.pack_name == "short")
    report = {r.pack_name: r for r in packing.fill_report(spark.createDataFrame(rows), CAPACITIES).collect()}
    assert report["short"].tokens == sum(size.values())


def test_neighbours_come_together():
    bags = [np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([1, 2, 3]), np.array([7, 8, 9])]
    sizes = np.array([50, 50, 40, 40])
    index = packing.Index(bags, [np.ones(3)] * 4, sizes, np.ones(10), 45.0)
    rows = packing.pack_shard(np.arange(4), sizes, bags, index, 100)
    boxes = defaultdict(set)
    for c, _, item, _, _, retrieved in rows:
        boxes[c].add(item)
        assert retrieved == (item >= 2)
    assert sorted(map(sorted, boxes.values())) == [[0, 2], [1, 3]]


def test_scores_against_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    bags = [np.unique(np.minimum(rng.geometric(0.05, size=rng.integers(1, 40)), 99)) for _ in range(120)]
    counts = [rng.integers(1, 4, len(b)) for b in bags]
    lengths, idf = np.array([c.sum() for c in counts]), rng.random(100)
    for entries in (packing.MATRIX_ENTRIES, 600, 0):  # all, some and no frequent tokens in the matrix
        monkeypatch.setattr(packing, "MATRIX_ENTRIES", entries)
        index = packing.Index(bags, counts, lengths, idf, 20.0)
        got = index.scores(bags[:7])
        kept = np.flatnonzero(rng.random(120) < 0.4)
        assert np.array_equal(index.only(kept).scores(bags[:7]), got[:, kept])
        for q in range(7):
            for d, (bag, tf) in enumerate(zip(bags, counts, strict=True)):
                norm = packing.K1 * (1 - packing.B + packing.B * lengths[d] / 20.0)
                want = sum(idf[t] * n * (packing.K1 + 1) / (n + norm) for t, n in zip(bag, tf, strict=True) if t in bags[q])
                assert abs(got[q, d] - want) < 1e-8


def test_best_first_keeps_ties():
    score = np.array([1.0, 3, 2, 2, 2, 0, 3])
    assert list(packing.best_first(score, 3)) == [1, 6, 2, 3, 4]
    assert list(packing.best_first(score[:2], 9)) == [1, 0]


def test_unused_against_brute_force():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 40, 200)
    unused, left = packing.Unused(sizes), set(range(200))
    while left:
        room = int(rng.integers(0, 45))
        got = unused.largest_within(room)
        fits = [sizes[i] for i in left if sizes[i] <= room]
        assert (sizes[got] == max(fits) and got in left) if fits else got == -1
        item = got if got >= 0 else next(iter(left))
        unused.take(item)
        left.discard(item)


def test_long_texts_count_as_the_tokenizer_says(spark):
    texts = ["비타민 칼슘 ab  12\n" * 17_001, "가나다" * 90_001, " " * 100_001 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.n_tokens for r in tokens.token_sizes(df, "k", "text").collect()}
    assert got == {i: len(tokens.encoding().encode_ordinary(t)) for i, t in enumerate(texts)}


def test_empty(spark):
    assert packing.pack_documents(docs(spark).where("false"), "k", "text", CAPACITIES).count() == 0
