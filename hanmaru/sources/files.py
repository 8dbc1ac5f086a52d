"""Files the pipeline exchanges: CSV with checked columns, JSON lines with bad lines set aside, runs in parts, model responses, sinks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hanmaru.functions import text
from hanmaru.operators.rows import replace_keys
from hanmaru.session import fingerprint, write_through


def read_csv(spark: SparkSession, path: str | list[str], required: dict[str, str], aliases: dict[str, list[str]] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV files with a header as columns of the types in `required`, trimmed; values that don't fit a numeric type become null, `boolean`
    and `list` are read tolerantly (`functions.text`). A column may go by other names (`aliases`: the first one present with a value
    counts). A missing column raises ValueError. Files are split over tasks unless `multi_line` says that values hold line breaks."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line).option("escape", '"').csv(path)
    clean = {c.lstrip("\ufeff").strip(): c for c in raw.columns}
    out, missing = [], []
    for name, kind in required.items():
        found = [clean[c] for c in (name, *(aliases or {}).get(name, [])) if c in clean]
        if not found:
            missing.append(name)
            continue
        value = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in found])
        typed = {"string": lambda v: v, "boolean": text.tolerant_boolean, "list": text.tolerant_list}.get(kind, lambda v, kind=kind: v.try_cast(kind))
        out.append(typed(value).alias(name))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*out)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines that are no JSON of the schema come out as (path, line) instead of ending the job; with `strict` the first
    of them raises ValueError that names its file. Blank lines are skipped."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = parsed.where(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()).select("path", F.col("value").alias("line"))
    if strict and (first := bad.limit(1).collect()):
        raise ValueError(f"malformed line in {first[0].path}: {first[0].line[:200]}")
    good = parsed.where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, bad


def read_parts(spark: SparkSession, paths: list[str], schema: StructType, retries: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """JSON lines of several runs in one table, each row with its folder (part_dir) and the number in its file's name (chunk). Rows of the
    folders `retries` replace all rows with their `keys`."""
    def read(where: list[str]) -> DataFrame:
        rows = spark.read.schema(schema).json(where).select("*", F.col("_metadata.file_path").alias("__path"))
        return rows.select(
            *[f.name for f in schema.fields],
            F.regexp_extract("__path", r"([^/]+)/[^/]+$", 1).alias("part_dir"),
            F.regexp_extract("__path", r"(\d+)[^/\d]*$", 1).try_cast("int").alias("chunk"),
        )

    return replace_keys(read(paths), read(retries), keys or []) if retries else read(paths)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists, on any Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        if target.getFileSystem(conf).exists(target):
            return p
    raise FileNotFoundError(" or ".join(paths))


#: Where answers of models keep their text: one text, or the texts of several parts.
ONE_TEXT = ("$.response.body.choices[0].message.content", "$.choices[0].message.content", "$.response.body.output_text", "$.output_text", "$.text")
PART_TEXTS = ("$.response.body.output[*].content[*].text", "$.output[*].content[*].text", "$.response.candidates[0].content.parts[*].text", "$.candidates[0].content.parts[*].text", "$.content[*].text")


def response_text(line: Column) -> Column:
    """The text in a line of a model's results, whichever of the known wrappers it is in; parts are put together. A line in none is itself
    the text."""
    one = [F.get_json_object(line, p) for p in ONE_TEXT]
    many = [F.get_json_object(line, p) for p in PART_TEXTS]
    joined = [F.when(m.startswith("["), F.array_join(F.from_json(m, "array<string>"), "")).otherwise(F.regexp_replace(m, r'^"|"$', "")) for m in many]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (*one, *joined)], line)


def response_json(line: Column) -> Column:
    """The JSON object in a model's answer: out of its wrapper, without code fences, from the first brace to the last; null if there is none."""
    bare = F.regexp_replace(response_text(line), r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def write_table(df: DataFrame, path: str, kind: str = "parquet", rows_per_file: int = 0, by: list[str] | None = None, mode: str = "overwrite", backup: bool = False) -> str | None:
    """Writes `path` anew, or with mode `append` adds to it; with `rows_per_file` no file has more rows; `by` gives partition folders, of which
    only those written are replaced. With `backup` the table there before is moved aside first; its new path is returned."""
    kept = None
    if backup:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(path)
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(old):
            kept = f"{path.rstrip('/')}.{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
            df = write_through(df, "replacement")  # it may be read from the table that is moved
            fs.rename(old, jvm.org.apache.hadoop.fs.Path(kept))
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(kind).save(path)
    return kept


def write_results(good: DataFrame, failed: DataFrame, path: str, kind: str = "json") -> DataFrame:
    """Writes rows, failed rows and a summary below `path` (rows, failed, summary); gives the summary: rows and failed ones by `error`."""
    write_table(good, f"{path}/rows", kind)
    write_table(failed, f"{path}/failed", "csv")
    spark = good.sparkSession
    counts = spark.read.format(kind).schema(good.schema).load(f"{path}/rows").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("outcome"), "n")
    summary = counts.unionByName(failed.groupBy(F.coalesce("error", F.lit("-")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")))
    write_table(summary.coalesce(1), f"{path}/summary", "json")
    return spark.read.schema(summary.schema).json(f"{path}/summary")


def refresh_table(spark: SparkSession, source: str, path: str, build: Callable[[], DataFrame]) -> bool:
    """Builds the table at `path` anew if the files of `source` are others than those it was last built from; whether it was."""
    mark = fingerprint(spark, source)
    jvm = spark.sparkContext._jvm
    note = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.source")
    fs = note.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(note):
        stream = fs.open(note)
        try:
            if str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) == mark:
                return False
        finally:
            stream.close()
    write_table(build(), path)
    out = fs.create(note, True)
    out.write(bytearray(mark.encode()))
    out.close()
    return True


def process_rest(rows: DataFrame, key: str, path: str, handle: Callable[[DataFrame], DataFrame]) -> int:
    """A job that can be taken up again: rows whose key the results at `path` lack go through `handle`, and its results are added; results with
    an `error` do not count as done. The number of rows handled."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    rest = rows
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        done = spark.read.parquet(path)
        rest = rows.join((done.where("error is null") if "error" in done.columns else done).select(key).distinct(), key, "left_anti")
    rest = write_through(rest, "rest")
    n = rest.count()
    if n:
        write_table(handle(rest), path, mode="append")
    return n
