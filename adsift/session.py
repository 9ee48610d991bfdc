"""Session settings and the shared scratch folder."""

from __future__ import annotations

import hashlib
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results or plans depend on; everything else stays as the cluster set it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # What travels to Python at once is bounded in bytes too, as texts may be long.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    # Session windows: merge inside map tasks first, so that a busy key travels as few rows.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


def spread(df: DataFrame, most: int = 32) -> DataFrame:
    """Deal a table of very few file splits out to the cores; a table with enough splits is left as it is.

    Text work costs far more than moving a small table once. The check reads the plan only, and `most` keeps the
    exchange away from anything large: such a table has more splits than that.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, most)
    return df.repartition(wanted) if df.rdd.getNumPartitions() * 2 <= wanted else df


def ship(module: str) -> None:
    """Send functions of this module to the executors by value, so that these need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the session names; a local one only where all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="adsift-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/adsift/{name}-{uuid.uuid4().hex}"


def shared(spark: SparkSession, name: str, *of: str) -> str:
    """A path in the same folder that stays the same for these names within an application."""
    base = scratch(spark, name).rpartition("/")[0]
    key = hashlib.md5("|".join((spark.sparkContext.applicationId, *of)).encode()).hexdigest()
    return f"{base}/{name}-{key}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, wherever the session keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def count_files(spark: SparkSession, path: str) -> int:
    """How many files of data a folder of own intermediate data holds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sum(f.isFile() and not f.getPath().getName().startswith(("_", ".")) for f in found)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of own intermediate data, wherever the session keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. Rows that differ in the last
    column `by`, of which there are few, go to folders of their own, so that those with one value are read alone."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
