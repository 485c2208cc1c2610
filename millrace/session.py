"""Session settings and the two runtime services every operator shares: scratch tables and row positions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group in tables that stages and scratch tables hold texts in. A task holds one row group when it writes and
#: all of one column's chunk when it reads; at the default of 128 MB eight tasks of a stage that does both fill a heap of 1 GB.
ROW_GROUP = 16 << 20


def builder(app: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """A session builder with the settings the engine relies on (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (local tests) a folder of our own is made, and set as checkpoint folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"millrace-{os.getuid()}-{spark.sparkContext.applicationId}")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, in a folder of this application."""
    return f"{scratch_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Frames that read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/millrace-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_groups(df: DataFrame, path: str) -> None:
    """Write df as Parquet in row groups of ROW_GROUP bytes, so that neither its writers nor its readers need a large heap."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    The copy survives the loss of any executor, unlike a local checkpoint or a cached block."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write_groups(df, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete the files of tables that materialize() made, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
