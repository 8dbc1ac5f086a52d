import math
import random

from hanmaru.llm.ranking import top_n


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), -math.inf))
    out = set()
    for g in {g for g, _ in best}:
        order = sorted((-s, i) for (h, i), s in best.items() if h == g)
        out |= {(g, i, k + 1) for k, (_, i) in enumerate(order[:n])}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [("hot" if k % 3 else f"g{rnd.randrange(40)}", f"t{rnd.randrange(300)}", rnd.choice([None, math.nan, 0.5, 0.5, round(rnd.random(), 2), 0.0, -0.0])) for k in range(3000)]
    rows += [(None, "a", 1.0), ("g", None, 1.0), ("only-null", "a", None), ("inf", "a", math.inf), ("inf", "b", -math.inf)]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumnRenamed("s", "group").withColumnRenamed("i", "sub")
    got = top_n(df, "g", "sub", "group", 4, subgroups=7)
    assert got.columns == ["g", "sub", "group", "rank_no"]
    assert {(r.g, r["sub"], r.rank_no) for r in got.collect()} == brute(rows, 4)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, i string, s double"), "g", "i", "s").count() == 0
