"""Session helpers: sane defaults for a cluster, tables of a directory, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults that hold on a laptop and on a large cluster; a session that was made elsewhere is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.files.maxPartitionBytes": "64m",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by conf (underscores stand for dots)."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table name of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, local mode gets a temporary one.

    A cluster without it is an error: what one machine's temporary folder holds, others can't read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("PAGEMILL_SHARED_DIR")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialised(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: cuts the lineage and survives lost executors.

    The columns' statistics then let Catalyst choose join strategies by true sizes. The driver deletes the folder when
    it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer partitions than those (few large files); otherwise unchanged.

    For stages that compute much per row. Tables of a cluster's size have more splits than cores and aren't shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
