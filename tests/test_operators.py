import math
import random

import pytest
from pyspark.sql import functions as F

from hanmaru.functions import text
from hanmaru.operators import groups, matching, rows, vectors


def test_dedupe_keeps_incomplete_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, "w")], "k string, t int, v string")
    kept, dropped = rows.dedupe_with_dropped(df, ["k"], [F.col("t")])
    assert sorted(r.v for r in kept.collect()) == ["w", "y", "z"]
    assert [r.v for r in dropped.collect()] == ["x"]
    twice = df.unionByName(df.where("k = 'a'"))
    kept, dropped = rows.dedupe_with_dropped(twice, ["k"], [F.col("t")])
    assert sorted(r.v for r in kept.collect()) == ["w", "y", "z"]
    assert sorted(r.v for r in dropped.collect()) == ["x", "x", "y"]
    kept, _ = rows.dedupe_with_dropped(df, ["k"], [F.col("t")], keep="first")
    assert sorted(r.v for r in kept.collect()) == ["w", "x", "z"]


def test_upsert_invalidate_latest(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    out = rows.upsert(base, new, ["k"], F.col("t"))
    lacking = rows.upsert(base, new.drop("v"), ["k"], F.col("t"))
    assert sorted((r.k, r.v or "-", r.t) for r in lacking.collect()) == [(1, "a", 1), (2, "b", 3), (3, "-", 1)]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert rows.invalidate(out, spark.createDataFrame([("a",), (None,)], "i string"), "i", "v").count() == 2
    assert sorted(tuple(r) for r in rows.latest_by_key(new, ["k"], "t").collect()) == [(2, "d", 3), (3, "e", 1)]
    assert rows.coverage(base, new, ["k"]).where("k = 2").first()["extra"] == 1


def test_page_clamps(spark):
    df = spark.range(23).toDF("i")
    assert [r.i for r in rows.page(df, [F.col("i")], 9, 5).collect()] == [20, 21, 22]
    assert rows.page(df.where("i < 0"), [F.col("i")], 2, 5).count() == 0


def test_stratified_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("s"))
    out = rows.stratified_sample(df, "s", "i", 5, 40, 1, [7, 8]).collect()
    assert len(out) == 40 and {7, 8} <= {r.i for r in out}
    assert all(sum(r.s == s for r in out) >= 5 for s in range(3))
    assert {r.i for r in out} == {r.i for r in rows.stratified_sample(df.repartition(7), "s", "i", 5, 40, 1, [7, 8]).collect()}


def test_weighted_jaccard_against_brute_force(spark):
    rnd = random.Random(3)
    data = {(o, i): rnd.random() for o in range(30) for i in rnd.sample(range(20), 5)}
    v = vectors.max_merge(spark.createDataFrame([(o, i, w) for (o, i), w in data.items()] + [(1, None, 1.0), (None, 2, 1.0), (1, 5, -1.0)], "o int, i int, w double"), "o", "i", F.col("w"))
    got = {(r.base_id, r.target_id): r.score for r in vectors.weighted_jaccard(v).collect()}
    for a in range(30):
        for b in range(30):
            x, y = ({i: w for (o, i), w in data.items() if o == k} for k in (a, b))
            if a != b and x.keys() & y.keys():
                keys = x.keys() | y.keys()
                want = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
                assert math.isclose(got.pop((a, b)), want, abs_tol=1e-12)
    assert not got


def test_cap_share(spark):
    v = spark.createDataFrame([(1, "n", 3.0), (1, "f", 4.0), (2, "n", 1.0)], "owner int, item string, weight double")
    got = {(r.owner, r.item): r.weight for r in vectors.cap_share(v, F.col("item") == "n", 0.2).collect()}
    assert got == {(1, "n"): pytest.approx(1.0), (1, "f"): 4.0, (2, "n"): 1.0}


def test_maps_and_sets(spark):
    df = spark.sql("SELECT map('a', 1.0D, 'b', 2.0D) AS x, map('b', 1.0D) AS y, map_from_arrays(array(), array()) AS z, array(1, 2) AS p, array(2, 3) AS q")
    r = df.select(vectors.map_similarity(F.col("x"), F.col("y")).alias("s"), vectors.set_similarity(F.col("p"), F.col("q")).alias("j")).first()
    assert (r.s, round(r.j, 6)) == (0.333333, 0.333333)


def test_groups(spark):
    df = spark.createDataFrame([("a", "A x"), ("a", "Ax"), ("a", "Ax"), ("b", "b"), ("b", "B")], "k string, v string").withColumn("p", F.monotonically_increasing_id())
    got = {r.k: r for r in groups.unique_mentions(df, "k", "v", "p").collect()}
    assert (got["a"].representative, got["a"].mentions, got["b"].representative) == ("Ax", 3, "B")
    best = groups.arg_max(spark.createDataFrame([(1, "x", 2.0), (1, "w", 2.0), (1, "z", 1.0), (2, "q", 0.5)], "g int, l string, s double"), "g", "l", "s")
    assert sorted(tuple(r) for r in best.collect()) == [(1, "w", 2.0, 2.0), (2, "q", 0.5, 0.0)]


def test_cascade_order(spark):
    r = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "x", "y")], "id int, k1 string, k2 string")
    e = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, entry string")
    got = {x.id: (x.tier_name, x.entry) for x in matching.cascade(r, "id", [(n, e, F.col(n) == F.col("key"), [F.lit(0)]) for n in ("k1", "k2")]).collect()}
    assert got == {1: ("k1", "A"), 2: ("k2", "B"), 3: (None, None)}


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)], "i long, v array<double>").repartition(5)
    got = {}
    for r in matching.nearest(df.where("i < 20"), df, "i", "v", 4).collect():
        got.setdefault(r.query_id, []).append((r.rk, r.neighbour_id))
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = n[:20] @ n.T
    for q in range(20):
        s[q, q] = -9
        assert [x for _, x in sorted(got[q])] == sorted(range(300), key=lambda j: (-round(s[q, j], 6), j))[:4]
    assert matching.nearest(df.where("i < 0"), df, "i", "v", 4).count() == 0


def test_text(spark):
    df = spark.createDataFrame([("비타민C (제2019-9495호) 96.6%  가",), (None,)], "t string")
    r = df.select(text.strip_brackets(F.col("t")).alias("b"), text.key_of(F.col("t")).alias("k"), text.fold(F.col("t")).alias("f")).collect()
    assert (r[0].b, r[1].k, r[1].f) == ("비타민C 가", "", "")
    one = spark.createDataFrame([("가나추출분말", "Ａ​b\r\n", ["b", " a ", "", None, "b"], "abcd", "bcde")], "k string, n string, l array<string>, p string, q string")
    r = one.select(
        text.strip_suffixes(F.col("k"), ["추출", "분말"]).alias("s"), text.nfkc(F.col("n")).alias("n"), text.clean_array(F.col("l")).alias("l"),
        F.round(text.matching_ratio(F.col("p"), F.col("q")), 3).alias("m"), text.contains_any(F.col("p"), ["BC", "cd e", "bcd"]).alias("c"), text.count_phrase(F.col("l")).alias("ph"),
    ).first()
    assert (r.s, r.n, r.l, r.m, r.c) == ("가나", "Ab\n", ["b", "a"], 0.75, True)


def test_fuzzy_pairs_lose_none(spark):
    import difflib

    from hanmaru.plans.matching import fuzzy_pairs

    names = ["옹겅퀴오일", "이동덩굴잎오일", "유기농새모래덩굴뿌리추출분말", "엉겅퀴오일", "비타민c", "cvitamin", "aabbaabb"]
    entries = ["엉겅퀴오일", "인동덩굴잎오일", "새모래덩굴뿌리추출분말", "비타민", "vitaminc", "abababab"]
    got = fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name_key string"), spark.createDataFrame([(e, e) for e in entries], "entry string, entry_key string"))
    wanted = {(n, e) for n in names for e in entries if round(difflib.SequenceMatcher(None, n, e).ratio(), 6) >= 0.78}
    assert {(r.name_key, r.entry) for r in got.collect()} == wanted
    assert ("옹겅퀴오일", "엉겅퀴오일") in wanted


def test_quality_model_trains_with_the_defaults(spark, small, monkeypatch):
    from hanmaru.operators import learn
    from hanmaru.plans import tables

    given = []
    monkeypatch.setattr(learn, "train", lambda rows, **options: given.append(options))
    monkeypatch.setattr(learn, "predict", lambda model, rows, threshold: rows.selectExpr("'good' AS quality_label", "0.0 AS weak_probability"))
    tables.quality_model(spark, small)
    assert given == [{}]


def test_nearest_keeps_ties_of_the_final_order(spark):
    from hanmaru.operators.matching import nearest

    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 4e-4]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>").coalesce(1)
    got = nearest(rows.where("vec_id = 0"), rows, "vec_id", "embedding", 1).collect()
    assert [(r.neighbour_id, r.cosine) for r in got] == [(1, 1.0)]


def test_endings_to_the_last_and_text_helpers(spark):
    df = spark.createDataFrame([("가나다추출분말추출물분말제제추출분말", " NaN ", "a/b: 한 c"), (None, None, None), ("분말", "x", "")], "k string, n string, f string")
    got = df.select(
        text.strip_suffixes(F.col("k"), ["추출분말", "추출물", "분말", "제제"]).alias("k"), text.plain_or_empty(F.col("n")).alias("n"), text.file_key(F.col("f")).alias("f"),
        text.truncated(F.col("k"), 8).alias("t"), text.number_of(F.col("n"), identifier=F.lit("u::7")).alias("r"),
    ).collect()
    assert [tuple(r) for r in got] == [("가나다", "", "a_b_한_c", "가나다추출...", "NaN"), (None, "", "", None, "7"), ("분말", "x", "", "분말", "x")]
    sig = spark.createDataFrame([(["a", "b"], ["b", "a"], None, "")], "x array<string>, y array<string>, n string, e string")
    r = sig.select(
        (text.signature(F.col("x")) == text.signature(F.col("y"))).alias("o"), (text.signature(text.unordered(F.col("x"))) == text.signature(text.unordered(F.col("y")))).alias("u"),
        (text.signature(F.col("n")) == text.signature(F.col("e"))).alias("n"), text.clean_array(F.array(F.lit("a"), F.lit(" b"), F.lit("a"), F.lit("c")), 2).alias("c"),
    ).first()
    assert (r.o, r.u, r.n, r.c) == (False, True, False, ["a", "b"])
    t = spark.createDataFrame([("YES", '["a", "a", "b"]', "10 mg", "a b"), ("off?", "x|y, z", "mg", "abcde"), ("0", None, None, None)], "b string, l string, a string, s string")
    got = t.select(text.tolerant_boolean(F.col("b")), text.tolerant_list(F.col("l")), text.is_amount(F.col("a")), text.is_short_key(F.col("s")), text.label_of(F.col("b"), {"yes": "예"})).collect()
    assert [tuple(r) for r in got] == [(True, ["a", "b"], True, True, "예"), (None, ["x", "y", "z"], False, False, "off?"), (False, [], False, True, "0")]
    a = spark.createDataFrame([("가나 추출물(다라, 마바)",), (None,)], "t string").select(text.aliases_of(F.col("t"), ["추출물"])).collect()
    assert [r[0] for r in a] == [["가나추출물다라마바", "가나추출물", "가나", "다라", "마바"], []]


def test_groups_without_whole_keys(spark):
    df = spark.createDataFrame([("a", i % 12, f"v{i % 12}") for i in range(60)] + [("a", 99, ""), (None, 1, "x"), ("b", 5, None)], "k string, o int, v string")
    assert groups.first_distinct(df, "k", "v", 3).first().v == ["v0", "v1", "v10"]
    got = {r.k: r.v for r in groups.first_non_empty(df, "k", ["v"], F.col("o")).collect()}
    assert got == {"a": "v0", "b": None, None: "x"}
    text_ = groups.ordered_text(spark.createDataFrame([("k", 2, "b|a"), ("k", 1, "c | b"), ("k", 3, "")], "k string, o int, t string"), "k", "o", "t", cut=r"\|").first()
    assert text_.t == "c | b | a"


def test_update_delete_backfill(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "", 5), (3, None, None)], "k int, v string, n int")
    assert sorted(tuple(r) for r in rows.update_where(df, F.col("n") > 1, v=F.lit("z"), n=F.col("n") + 1).collect() if r.k < 3) == [(1, "a", 0), (2, "z", 6)]
    assert [r.k for r in rows.delete_where(df, F.col("n") > 1).collect()] == [1, 3]
    other = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "k int, v string, n int")
    assert sorted(tuple(r) for r in rows.backfill(df, other, ["k"], ["v"], ["n"]).collect() if r.k < 3) == [(1, "a", 7), (2, "y", 5)]


def test_join_labels(spark):
    have = spark.createDataFrame([("g", "a", 1, "A"), ("g", "b", 2, "B"), ("h", "a", 1, "C")], "g string, i string, r int, v string")
    labels = spark.createDataFrame([("g", "b", 1, "l1"), ("g", None, 1, "l2"), ("g", "zz", 2, "l3"), ("g", "zz", 9, "l4"), ("x", "a", 1, "l5")], "g string, i string, r int, label string").coalesce(1)
    joined, errors = rows.join_labels(labels, have, "g", "i", "r")
    assert sorted((r.label, r.i, r.r, r.v) for r in joined.collect()) == [("l1", "b", 2, "B"), ("l2", "a", 1, "A")]
    assert sorted((r.label, r.error) for r in errors.collect()) == [("l3", "duplicate"), ("l4", "missing"), ("l5", "missing")]


def test_best_threshold_against_brute_force(spark):
    from hanmaru.operators.learn import best_threshold

    rnd = random.Random(2)
    data = [(round(rnd.random(), 2), rnd.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(data, "s double, p boolean")
    for floor in (0.0, 0.6, 0.99):
        every = []
        for t in {s for s, _ in data}:
            flagged = [p for s, p in data if s >= t]
            every.append((round(sum(flagged) / len(flagged), 9) >= floor, round(2 * sum(flagged) / (len(flagged) + sum(p for _, p in data)), 9), t))
        got = best_threshold(df, F.col("s"), F.col("p"), floor, ranges=7).first()
        assert (got.precision >= floor, got.f1, got.threshold) == max(every)
    assert best_threshold(df.where("false"), F.col("s"), F.col("p"), 0.5).count() == 0


def test_contained_against_brute_force(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("가나다") for _ in range(rnd.randrange(1, 9))) for _ in range(80)]
    keys = ["".join(rnd.choice("가나다") for _ in range(rnd.randrange(1, 7))) for _ in range(40)]
    n = spark.createDataFrame([(x,) for x in sorted(set(names))], "n string")
    e = spark.createDataFrame([(x, x) for x in sorted(set(keys))], "e string, k string")
    got = [(r.n, r.e) for r in matching.contained(n, "n", e, "k").collect()]
    want = {(a, b) for a in names for b in keys if a == b or len(a) >= 4 and len(b) >= 4 and (a in b or b in a)}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(matching, "LIST_ROWS", 10)
    df = spark.range(64).select(F.col("id").alias("i"), F.array((F.col("id") % 8).cast("double"), F.lit(1.0)).alias("v"))
    got = matching.nearest(df, df, "i", "v", 3, block_rows=9).collect()
    assert len(got) == 64 * 3 and all(r.cosine == 1.0 and r.query_id % 8 == r.neighbour_id % 8 for r in got)


def test_frequent_items_are_cut_into_chunks(spark, monkeypatch):
    from hanmaru.operators import skew

    data = [(o, "hot", 1.0) for o in range(40)] + [(o, f"x{o % 5}", 0.5) for o in range(40)]
    df = spark.createDataFrame(data, "owner int, item string, weight double")
    want = sorted(map(tuple, vectors.weighted_jaccard(df).collect()))
    met = skew.meet_within(df, ["item"], "owner", chunk=7)
    pairs = {(r.a, r.b, r.i) for r in met.select(F.col("l.owner").alias("a"), F.col("r.owner").alias("b"), F.col("l.item").alias("i")).where("a < b").collect()}
    assert len(pairs) == 780 + 5 * 28 and len(want) == 1560


def test_label_lines(spark):
    from hanmaru.functions import labels

    text_ = "제품명 가\n원재료명 및 함량\n비타민C (아스코\n르브산), 아연 1\n0 mg\n칼슘,\n분말\n섭취방법 1일"
    cases = [text_, "비타민, 칼슘, 아연\n보관: 실온", "아무것도", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(labels.rejoined(labels.passage_lines(F.col("t")))).collect()]
    assert got == [["비타민C (아스코르브산), 아연 10 mg", "칼슘,분말"], ["비타민, 칼슘, 아연"], [], []] or got[0][0] == "비타민C (아스코르브산), 아연 10 mg"
    tokens = ["· 비타민C (아스코르브산)", "아연 10 mg", "1.5%", "원산지", "x"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(labels.clean_token(F.col("t"))).collect()] == ["비타민C", "아연", None, None, None]


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_look_up_small_and_large_tables(spark, monkeypatch, broadcast):
    from hanmaru.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    got = sorted((r.i, r.v) for r in skew.look_up(df, table, ["k"], F.col("i")).collect())
    assert got == sorted([(i, 1 if i % 3 else 2 if i == 0 else None) for i in range(60)] + [(99, None)])
    assert skew.look_up(df, table.select("k"), ["k"], F.col("i"), "left_semi").count() == 41


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_a_large_looked_up_table_is_not_broadcast(spark, monkeypatch, how):
    """Its file is small, so the planner would broadcast it, every row 64 times."""
    from hanmaru.operators import skew
    from hanmaru.session import write_through

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    table = write_through(spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("v")), "table")
    met = skew.look_up(spark.range(100).select((F.col("id") % 60).alias("k"), F.col("id").alias("i")), table, ["k"], F.col("i"), how)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == (100 if how == "left" else 90)


@pytest.mark.parametrize("chunk", [7, 4000])
def test_pairs_by_base_are_those_of_pairs(spark, chunk):
    from hanmaru.operators import skew

    random.seed(5)
    drawn = {(random.randrange(-20, 60), random.randrange(6)): float(i) for i in range(150)}
    df = spark.createDataFrame([(o, i, w) for (o, i), w in drawn.items()] + [(1, None, 1.0)], "owner long, item long, weight double")
    rows = skew.meet_by_base(df, ["item"], "owner", ["owner", "weight"], ["owner", "weight"], 3, chunk)
    got = sorted(tuple(r) for r in skew.each_pair(rows, "owner", "weight").collect())
    assert got == sorted((a, w, b, x) for (a, i), w in drawn.items() for (b, j), x in drawn.items() if i == j and a != b)
    assert rows.count() <= df.count() * (1 if chunk == 4000 else 10)


@pytest.mark.parametrize("at", [0, 2**40])
def test_owners_of_a_narrow_range_and_of_a_wide_one(spark, at):
    df = spark.createDataFrame([(-3, 1, 0.5), (7, 1, 0.25), (at, 1, 1.0)], "owner long, item long, weight double")
    pairs, low = vectors.meet_narrow(df, ["item"], ["weight"], ["weight"])
    best = vectors.best_pairs(pairs, low, 1, F.desc("t_weight"), F.col("target_id"))
    assert dict(pairs.dtypes)["t_owner"] == ("bigint" if at else "int")
    assert sorted((r.base_id, r.target_id) for r in best.collect()) == sorted([(-3, at), (7, at), (at, -3)])


def test_no_pairs(spark):
    pairs, low = vectors.meet_narrow(spark.createDataFrame([], "owner long, item long, weight double"), ["item"], ["weight"], ["weight"])
    assert vectors.best_pairs(pairs, low, 1, F.desc("t_weight"), F.col("target_id")).count() == 0


def test_shuffle_files_go_when_a_result_is_written(spark):
    import time
    from pathlib import Path

    from hanmaru.session import FREED, write_through

    def files():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for d in local for p in Path(d).rglob("shuffle_*.data")}

    before = files()
    counts = write_through(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert counts.count() == 7
    assert spark.conf.get(FREED, "false") == "false"


def test_pool_v1_shuffles_no_row_for_each_pair(spark, small):
    from hanmaru.plans import similarity

    plan = similarity.pool_v1(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan
    assert plan.split("Generate inline")[0].count("Exchange") == 0


def test_the_adjusted_measure_shuffles_no_entry_of_a_pair(spark, small):
    from hanmaru.plans import similarity

    plan = similarity.semantic_jaccard_adjusted(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Generate inline")[0].count("Exchange") == 0


def test_the_first_measure_by_totals_and_by_entries(spark, small):
    from pyspark.sql import Window

    from hanmaru.plans import similarity

    v = similarity.role_vectors(spark, small)
    own = Window.partitionBy("owner")
    totals = {f"total_{r}": F.sum(F.when(F.col("role") == r, F.col("weight")).otherwise(0.0)).over(own) for r in range(3)}
    names = ["primary", "secondary", "support", "family"]
    rounded = ["base_id", "target_id", "shared", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in names]]
    a = similarity._pool_v1(v.withColumns(totals), F.lit(True), measured=True).select(*rounded)
    b = similarity._measured_apart(v, similarity._pool_v1(v, F.lit(True))).select(*rounded)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = similarity.weighted_jaccard_v1(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan and plan.split("Generate inline")[0].count("Exchange") == 0
