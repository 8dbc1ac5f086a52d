import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from hanmaru.llm import ledger


def brute_key(text):
    plain = unicodedata.normalize("NFKC", text).lower()
    parts = [re.sub(r"[^\w.]|_", "", p) for p in re.split(r"[,;/|()\[\]{}<>、\r\n]", plain)]
    parts = [re.sub(r"(?<!\d)\.|\.(?!\d)", "", p) for p in parts]
    return tuple(sorted(p for p in parts if p))


def test_canonical_key(spark):
    same = ["비타민 K(총함량 83.0%, 394mg)", "[비타민_K] 394 MG | '총함량83.0%'", "총함량 83.0％，３９４mg，비타민 k~", "394mg\n비타민K\n총함량 83.0%."]
    other = ["비타민 K(총함량 830%, 394mg)", "비타민 K 총함량 83.0%, 394mg", "비타민 K(총함량 83.0%, 394mg, 394mg)"]
    rows = spark.createDataFrame([(t,) for t in same + other + ["", "~", None]], "t string").select(ledger.canonical_key(F.col("t")).alias("k")).collect()
    keys = [r.k for r in rows]
    assert len(set(keys[:4])) == 1 and len(set(keys[:7])) == 4
    assert keys[7] == keys[8] and keys[9] is None


def make(spark, texts):
    return spark.createDataFrame([(f"i{n:05d}", t) for n, t in enumerate(texts)], "record_id string, t string").select("record_id", ledger.canonical_key(F.col("t")).alias("key"))


def test_batches_equal_one_pass_and_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    texts = []
    for n in range(400):
        parts = ["hot", "1.5mg"] if n % 3 == 0 else [f"x{rnd.randrange(60)}", f"{rnd.randrange(4)}mg"]
        rnd.shuffle(parts)
        texts.append(rnd.choice(["{}, {}", "{} ({})", "[{}] {}", "{}/{}"]).format(*(p.upper() if rnd.random() < 0.5 else p for p in parts)))
    rows = make(spark, texts)
    book = ledger.CopyLedger(spark, str(tmp_path / "l"), buckets=4)
    for b in range(3):
        part = rows.where(F.pmod(F.hash("record_id"), F.lit(3)) == b)
        book.apply(part, f"b{b}")
        book.apply(part, f"b{b}")  # met again: nothing changes
    got = {(r.kept, r.copy) for r in ledger.surplus_copies(book.read(), rows).collect()}
    groups = {}
    for n, t in enumerate(texts):
        groups.setdefault(brute_key(t), []).append(f"i{n:05d}")
    assert got == {(g[0], c) for g in groups.values() for c in g[1:]}
    assert {(r.kept, r.copies) for r in book.read().collect()} == {(g[0], len(g)) for g in groups.values()}


def test_empty_and_nulls(spark, tmp_path):
    book = ledger.CopyLedger(spark, str(tmp_path / "l"))
    none = make(spark, [])
    assert book.read().count() == 0
    book.apply(none, "0")
    book.apply(make(spark, [None, "a", "A ", "x" * 100_000]), "1")
    assert sorted(r.copies for r in book.read().collect()) == [1, 2]
    assert ledger.surplus_copies(book.read(), none).count() == 0


def test_batches_by_time(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-01"), (3, "2024-06-01"), (4, "2024-12-31")], "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    parts = ledger.batches_by_time(df, "t", 3)
    assert [sorted(r.i for r in p.collect()) for p in parts] == [[1, 2], [3], [4]]
    assert len(ledger.batches_by_time(df.where("i = 1"), "t", 3)) == 1


def test_number_of_buckets_is_kept(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger.CopyLedger(spark, path, buckets=16).apply(make(spark, ["a", "b", "a "]), "0")
    with pytest.raises(ValueError, match="16 buckets, not 17"):
        ledger.CopyLedger(spark, path, buckets=17)
    book = ledger.CopyLedger(spark, path)
    book.apply(make(spark, ["A", "c"]), "1")
    assert sorted(r.copies for r in book.read().collect()) == [1, 1, 3]


def test_small_batches_leave_large_runs_and_stale_runs_go(spark, tmp_path):
    book = ledger.CopyLedger(spark, str(tmp_path / "l"), buckets=2)
    book.apply(make(spark, [f"x{i}" for i in range(200)]), "0")
    first = book.manifest()["runs"][0]["name"]
    for n in range(4):
        book.apply(make(spark, [f"X{n}", "y"]), str(n + 1))
    content = book.manifest()
    assert [r["name"] for r in content["runs"]][0] == first and len(content["runs"]) == 2
    assert {p.name for p in (tmp_path / "l").iterdir() if p.is_dir()} == {r["name"] for r in content["runs"]} | set(content["stale"])
    got = sorted(r.copies for r in book.read().collect())
    assert (len(got), got[-5:]) == (201, [2, 2, 2, 2, 4])
