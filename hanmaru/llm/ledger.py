"""Duplicates hidden by formatting differences, kept as an incremental ledger of canonical keys.

The ledger is a folder of runs, each a set of Parquet buckets by a hash of the key, with a small manifest that names the runs and
the number of buckets. A batch is aggregated to one row per key (partial aggregation before its only shuffle). It is joined by a
full outer join, bucket by bucket, with the runs that are not much larger than itself, and becomes a run with them; larger runs
stay as they are. So a small batch does not rewrite a large ledger: every row is written again about as often as the ledger
doubles. Then the manifest is replaced. A lost executor costs a recomputation, a lost driver leaves the old manifest valid, and a
batch identifier met again changes nothing.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from hanmaru.llm.pairing import look_up

LEDGER = StructType(
    [StructField("key", StringType()), StructField("copies", LongType()), StructField("kept", StringType()), StructField("bucket", IntegerType())]
)


@pandas_udf(StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def canonical_key(text: Column) -> Column:
    """Digest of the sorted parts of a text; parts stand between commas, semicolons, slashes, bars, brackets and line breaks and
    count by letters and digits only, a point between two digits included. Compatibility forms (full-width letters, signs and
    digits) are mapped first. A text without any letter or digit gives the key of the empty list; null gives null."""
    plain = F.when(text.rlike(r"^[\x00-\x7F가-힣]*$"), text).otherwise(_composed(text))
    parts = F.split(F.lower(plain), r"[,;/|()\[\]{}<>、､〈〉《》「」『』【】〔〕\r\n\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}\p{M}.]|(?<!\p{Nd})\.|\.(?!\p{Nd})", ""))
    sorted_parts = F.array_sort(F.filter(bare, lambda p: p != ""))
    return F.md5(F.array_join(sorted_parts, "\n"))


#: A run is merged with a new one of at least its rows divided by this.
MERGE_RATIO = 3
#: Keys with more copies than this are looked up apart from the others.
HOT_COPIES = 10_000


class CopyLedger:
    """Counts of canonical keys with the earliest representative, kept in `path` over any number of batches.

    The number of buckets is fixed by the first batch and stands in the manifest; opening the ledger with another number raises
    ValueError, as keys would be looked for in the wrong buckets. Without a number the manifest's counts (16 for a new ledger).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        kept = self.manifest()["buckets"]
        if kept and buckets and kept != buckets:
            raise ValueError(f"the ledger has {kept} buckets, not {buckets}")
        self.buckets = kept or buckets or 16

    def _fs(self) -> tuple:
        jvm = self.spark.sparkContext._jvm
        manifest = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")
        return jvm, manifest.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), manifest

    def manifest(self) -> dict:
        """{"batches": applied batch ids, "buckets": their number, "runs": [{"name", "rows"}] largest first, "stale": runs replaced by the last batch}"""
        jvm, fs, manifest = self._fs()
        old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json.old")
        for path in (manifest, old):
            if fs.exists(path):
                stream = fs.open(path)
                try:
                    return json.loads(str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return {"batches": [], "buckets": 0, "runs": [], "stale": []}

    def _replace_manifest(self, content: dict) -> None:
        jvm, fs, manifest = self._fs()
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json.{x}") for x in ("new", "old"))
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.delete(old, False)
        if fs.exists(manifest):
            fs.rename(manifest, old)
        fs.rename(new, manifest)

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """The whole ledger: key, copies, kept, bucket. It may be read until the second batch after."""
        runs = self.manifest()["runs"]
        if not runs:
            return self.spark.createDataFrame([], LEDGER)
        out = self._run(runs[0]["name"])
        for run in runs[1:]:
            out = out.unionByName(self._run(run["name"]))
        if len(runs) == 1:
            return out
        return out.groupBy("bucket", "key").agg(F.sum("copies").alias("copies"), F.min("kept").alias("kept")).select("key", "copies", "kept", "bucket")

    def _remove(self, names: list[str]) -> None:
        jvm, fs, _ = self._fs()
        for name in names:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def apply(self, batch: DataFrame, batch_id: str) -> None:
        """Adds a batch of (record_id, key) rows; null keys are no records. A batch id already applied is skipped."""
        content = self.manifest()
        if batch_id in content["batches"]:
            return
        number = len(content["batches"])
        new = (
            batch.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.col("record_id").cast("string")).alias("kept"))
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        )
        keys = self._write(new, f"run-{number:06d}-0")
        runs, stale = list(content["runs"]), []
        name = f"run-{number:06d}-0"
        while runs and runs[-1]["rows"] <= MERGE_RATIO * keys:
            old = runs.pop()
            merged = self._run(old["name"]).alias("o").join(self._run(name).alias("n"), ["bucket", "key"], "full_outer").select(
                "key",
                (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
                F.least("o.kept", "n.kept").alias("kept"),
                "bucket",
            )
            stale += [old["name"], name]
            name = f"run-{number:06d}-{len(stale)}"
            keys = self._write(merged, name)
        self._replace_manifest({"batches": [*content["batches"], batch_id], "buckets": self.buckets, "runs": [*runs, {"name": name, "rows": keys}], "stale": stale})
        self._remove(content["stale"])

    def _write(self, rows: DataFrame, name: str) -> int:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return self._run(name).count()


def surplus_copies(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """(kept, copy): every record that is not the kept one of its key. Keys with more than `HOT_COPIES` copies are looked up apart,
    by broadcast or salted, so that no task of the shuffled join holds such a key."""
    several = ledger.where(F.col("copies") > 1)
    keyed = records.where(F.col("key").isNotNull()).select(F.col("record_id").cast("string").alias("copy"), "key")
    hot = several.where(F.col("copies") > HOT_COPIES).select("key", F.col("kept").alias("hot_kept"))
    marked = look_up(keyed, hot, ["key"], F.col("copy"))
    out = marked.where(F.col("hot_kept").isNotNull()).select(F.col("hot_kept").alias("kept"), "copy")
    rest = marked.where(F.col("hot_kept").isNull()).select("copy", "key").join(several.where(F.col("copies") <= HOT_COPIES).select("key", "kept"), "key")
    return out.unionByName(rest.select("kept", "copy")).where("kept <> copy").distinct()


def batches_by_time(df: DataFrame, time: str, batches: int) -> list[DataFrame]:
    """The rows in `batches` stretches of equal time, earliest first; rows without a time belong to the first."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None or low == high:
        return [df]
    part = F.floor((at - low) * batches / (high - low + 1))
    numbered = F.coalesce(part, F.lit(0)).cast("int")
    return [df.where(numbered == i) for i in range(batches)]
