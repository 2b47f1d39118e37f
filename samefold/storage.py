"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        found = _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="samefold-"))
    return f"{found.rstrip('/')}/{sc.applicationId}"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again. Long projections end there: a
    filter on a normalised key would otherwise be pushed through them and repeat them whole. The shuffle
    files behind the table go at once; else they stay until the driver happens to collect its garbage."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.persisted_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind what persisted() gave, when nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.persisted_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores (a small file), dealt out over them before costly
    columns are made; any other as it is. For plain scans: it looks at the plan's partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
