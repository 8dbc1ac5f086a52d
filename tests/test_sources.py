import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hanmaru.sources import files

SCHEMA = StructType([StructField("k", StringType()), StructField("n", LongType())])


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,w,old\n 1 ,0.5,"a, ""b"""\n2,x,\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), {"id": "string", "w": "double", "name": "string"}, {"name": ["new", "old"]}).collect()
    assert [tuple(r) for r in got] == [("1", 0.5, 'a, "b"'), ("2", None, None)]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.read_csv(spark, str(tmp_path / "a.csv"), {"z": "string"})


def test_jsonl(spark, tmp_path):
    (tmp_path / "run-1").mkdir()
    (tmp_path / "run-1" / "part_007.jsonl").write_text('{"k": "a", "n": 1}\n\n{oops\n{"k": "b"}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "run-1"), SCHEMA)
    assert sorted((r.k, r.n) for r in good.collect()) == [("a", 1), ("b", None)]
    assert [r.line for r in bad.collect()] == ["{oops"]
    with pytest.raises(ValueError, match="part_007"):
        files.read_jsonl(spark, str(tmp_path / "run-1"), SCHEMA, strict=True)
    parts = files.read_parts(spark, [str(tmp_path / "run-1")], SCHEMA).where("k = 'a'").first()
    assert (parts.part_dir, parts.chunk) == ("run-1", 7)


def test_response_json(spark):
    texts = ["```json\n{\"a\": {\"b\": 1}}\n```", "Sure: {\"a\": 2} done", "none", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(files.response_json(F.col("t"))).collect()]
    assert [json.loads(g) if g else None for g in got] == [{"a": {"b": 1}}, {"a": 2}, None, None]


def test_sinks(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("p"))
    files.write_table(df.repartition(1), str(tmp_path / "c"), "json", rows_per_file=3)
    assert len(list((tmp_path / "c").glob("*.json"))) == 4
    files.write_table(df, str(tmp_path / "t"), by=["p"])
    files.write_table(df.where("p = 1").limit(1), str(tmp_path / "t"), by=["p"])
    assert spark.read.parquet(str(tmp_path / "t")).where("p = 0").count() == 5
    assert spark.read.parquet(str(tmp_path / "t")).where("p = 1").count() == 1
    assert files.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "t")) == str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "no"))


def test_write_through_and_clean(spark):
    from hanmaru.session import clean_scratch, write_through

    df = write_through(spark.range(5).toDF("i"), "numbers")
    assert df.count() == 5 and f"{spark.sparkContext.applicationId}/numbers" in df.inputFiles()[0]
    clean_scratch(spark)
    assert write_through(spark.range(3).toDF("i"), "numbers").count() == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from hanmaru.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_typed_columns_and_retries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ok,tags\n1,Yes,\"[\"\"x\"\", \"\"y\"\"]\"\n2,?,a|b\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), {"id": "int", "ok": "boolean", "tags": "list"}).collect()
    assert [tuple(r) for r in got] == [(1, True, ["x", "y"]), (2, None, ["a", "b"])]
    for name, rows in (("run", '{"k": "a", "n": 1}\n{"k": "b", "n": 1}\n'), ("retry", '{"k": "a", "n": 2}\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part_1.jsonl").write_text(rows)
    parts = files.read_parts(spark, [str(tmp_path / "run")], SCHEMA, [str(tmp_path / "retry")], ["k"]).collect()
    assert sorted((r.k, r.n, r.part_dir) for r in parts) == [("a", 2, "retry"), ("b", 1, "run")]


def test_response_wrappers(spark):
    lines = [
        json.dumps({"response": {"body": {"choices": [{"message": {"content": "```json\n{\"a\": 1}\n```"}}]}}}), json.dumps({"candidates": [{"content": {"parts": [{"text": "{\"a\":"}, {"text": " 2}"}]}}]}),
        json.dumps({"output": [{"content": [{"text": "x {\"a\": 3} y"}]}]}), '{"a": 4}',
    ]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in lines], "t string").select(files.response_json(F.col("t"))).collect()]
    assert [json.loads(g)["a"] for g in got] == [1, 2, 3, 4]


def test_backup_results_refresh_and_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.write_table(spark.range(3), path, backup=True) is None
    old = files.write_table(spark.read.parquet(path).where("id > 0"), path, backup=True)
    assert spark.read.parquet(old).count() == 3 and spark.read.parquet(path).count() == 2
    files.write_table(spark.range(1), path, mode="append")
    assert spark.read.parquet(path).count() == 3
    failed = spark.createDataFrame([(1, "bad"), (2, "bad")], "id int, error string")
    assert sorted(tuple(r) for r in files.write_results(spark.range(4), failed, str(tmp_path / "r")).collect()) == [("bad", 2), ("rows", 4)]
    source, target = str(tmp_path / "s"), str(tmp_path / "u")
    spark.range(2).write.parquet(source)
    build = lambda: spark.read.parquet(source)
    assert [files.refresh_table(spark, source, target, build) for _ in range(2)] == [True, False]
    spark.range(5).write.mode("overwrite").parquet(source)
    assert files.refresh_table(spark, source, target, build) and spark.read.parquet(target).count() == 5
    done = str(tmp_path / "d")
    handle = lambda df: df.withColumn("error", F.when(F.col("id") == 2, "late"))
    assert [files.process_rest(spark.range(n), "id", done, handle) for n in (3, 5)] == [3, 3]  # the failed row again, and two new ones


def test_kept_for_follows_the_files(spark, tmp_path):
    from hanmaru.session import kept_for

    source, built = str(tmp_path / "s"), []
    spark.range(2).write.parquet(source)
    build = lambda: built.append(1) or spark.read.parquet(source)
    assert [kept_for(spark, "test", [source], build).count() for _ in range(2)] == [2, 2] and len(built) == 1
    spark.range(3).write.mode("overwrite").parquet(source)
    assert kept_for(spark, "test", [source], build).count() == 3 and len(built) == 2
