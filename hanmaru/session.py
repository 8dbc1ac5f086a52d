"""Session construction and the shared working folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What the engine wants of a session; a cluster's own settings win over these.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "hanmaru", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the engine's settings; on a cluster, spark-submit's own settings are used instead."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one is made only where that is unset and the session is local,
    as in tests; a cluster without the setting is an error, as its executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="hanmaru-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder below the shared one that holds what this application leaves there; it goes when the driver ends."""
    root = f"{shared_dir(spark)}/hanmaru/{spark.sparkContext.applicationId}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.mkdirs(target):
        fs.deleteOnExit(target)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Makes Spark remove a query's shuffle files when the query has ended, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """For queries whose result is written: nothing reads their shuffle files again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)


def write_through(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder once and read from there, so that a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    with shuffles_freed(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the paths with the lengths and times of the files below them: another one whenever a file is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        for status in sorted(([target, fs.getFileStatus(target)], *([s.getPath(), s] for s in fs.listStatus(target))), key=lambda x: x[0].toString()):
            parts.append(f"{status[0].toString()}:{status[1].getLen()}:{status[1].getModificationTime()}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()


def kept_for(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A result computed once for the files it is made of: kept in the application's scratch folder under the name and the sources'
    fingerprint, computed anew when one of them is another file. Vectors of a model are kept the same way, with the model's name in `name`."""
    path = f"{scratch_root(spark)}/{name}-{fingerprint(spark, *sources)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df = build()
        with shuffles_freed(spark):
            df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Removes at once what `write_through` and the ledgers of queries left in the shared folder; results read from it are gone afterwards."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
