"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cairnlake", master: str | None = None, **conf: str) -> SparkSession:
    """Build or get a session: UTC, AQE with skewed joins split, bounded input splits.

    ``master`` stays unset on a cluster, where spark-submit gives it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            cores = master.partition("[")[2].rstrip("]")
            builder = builder.config("spark.sql.shuffle.partitions", str(os.cpu_count() if cores in ("", "*") else int(cores)))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its
    own, as in tests; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        for folder in {os.path.dirname(p) for p in table.inputFiles()}:
            fs, path = pafs.FileSystem.from_uri(folder)
            fs.delete_dir(path)


#: Rows and bytes that a Python worker gets at once where it works on texts.
BATCH_ROWS, BATCH_BYTES = 512, "4MB"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of texts. The setting stays: it bounds memory and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables, by the name of its Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
