"""Session, shared folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own session does as well."""
    b = SparkSession.builder.master(master).appName("strandloom")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only where that is unset and the session is local, as in tests, a folder of our own is made; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def materialize(df: DataFrame, label: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    The lineage is cut and the table survives the loss of executors. The
    table goes with the JVM (deleteOnExit) or with :func:`discard`.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"strandloom-{label}-{uuid.uuid4().hex}")
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    return out


def materialize_counting(df: DataFrame, label: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize`, with aggregates over the rows taken while they are written: no second job."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that no result reads any more."""
    for t in tables:
        path = getattr(t, "_strandloom_path", None)
        if path:
            spark = t.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
