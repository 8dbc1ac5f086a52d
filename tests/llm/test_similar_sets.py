import random

import pytest

from hanmaru.llm.pairing import pairs_within
from hanmaru.llm.similar_sets import pivots_for, similar_distinct_sets, similar_pairs


def brute(sets, t):
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= t * len(x | y) - 1e-9:
                out.add((a, b))
    return out


@pytest.mark.parametrize("vocabulary,chunk", [(400, 4000), (14, 20)])
def test_against_brute_force(spark, vocabulary, chunk):
    rnd = random.Random(vocabulary)
    sets = {}
    for n in range(250):
        if n % 3 == 0 or not sets:
            s = set(rnd.sample(range(vocabulary), rnd.randint(1, 9)))
        else:
            s = set(sets[rnd.choice(list(sets))])
            if s and rnd.random() < 0.6:
                s.discard(next(iter(s)))
            if rnd.random() < 0.6:
                s.add(rnd.randrange(vocabulary))
        sets[f"k{n:03d}"] = s
    rows = [("s", k, [f"v{x}" for x in s] + [None, *[f"v{x}" for x in s][:1]]) for k, s in sets.items()]
    rows += [("s", None, ["v1"]), ("s", "null", None), ("s", "empty", []), ("other", "k000", [f"v{x}" for x in sets["k000"]]), ("s", "k001", [f"v{x}" for x in sets["k001"]])]
    df = spark.createDataFrame(rows, "scope string, key string, tokens array<string>")
    for options in ({"chunk": chunk}, {"chunk": chunk, "pivots": 60, "radius": 0.65}, {"pivots": 0}):
        got = similar_pairs(df, 0.7, **options).collect()
        assert len(got) == len(set(got))
        assert {(r.left_key, r.right_key) for r in got if r.scope == "s"} == brute(sets, 0.7)
        assert not [r for r in got if r.scope == "other"]


def test_radius_must_leave_room(spark):
    with pytest.raises(ValueError):
        similar_distinct_sets(spark.createDataFrame([], "scope string, set_id string, tokens array<bigint>"), 0.7, radius=0.7)


def test_empty(spark):
    assert similar_pairs(spark.createDataFrame([], "scope string, key string, tokens array<string>")).count() == 0


def test_pairs_within_hot_group(spark):
    df = spark.createDataFrame([("hot", f"k{i:03d}", i % 2) for i in range(90)] + [("b", "x", 0), ("b", "y", 0), (None, "z", 1), (None, "w", 2)], "g string, k string, d int")
    got = [tuple(r) for r in pairs_within(df, "g", "k", chunk=10).collect()]
    assert len(got) == len(set(got)) == 90 * 89 // 2 + 1
    assert pairs_within(df, "g", "k", "d", chunk=10).count() == 45 * 45


def test_number_of_pivots_is_bounded():
    assert [pivots_for(n) for n in (0, 60_000, 1_000_000, 10**12)] == [16, 16, 62, 256]
