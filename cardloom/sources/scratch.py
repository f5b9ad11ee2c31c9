"""Tables written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Tables still there, by path; what a returned DataFrame still reads goes when the driver ends.
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Without one, a temporary folder serves as long as driver and tasks are one
    process (tests); on a cluster that is an error, as no other machine could read the files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/cardloom-{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_drop_all)
    _kept[path] = spark
    return path


def cut(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there, and a lost executor
    costs a re-read instead of a recomputation. ``partition_by`` lays it out in a folder for each value."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cardloom_path = path
    return table


def drop_path(path: str) -> None:
    """Delete a path from :func:`scratch_path`."""
    spark = _kept.pop(path, None)
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more; other DataFrames are left alone."""
    drop_path(getattr(df, "cardloom_path", ""))


def _drop_all() -> None:
    for path, spark in list(_kept.items()):
        if spark.sparkContext._jsc is not None:
            drop_path(path)
