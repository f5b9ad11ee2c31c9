"""Session settings, shared scratch tables and the learn/held-out split used by all operators here."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop_path, drop_table, scratch_path, shared_dir

__all__ = ["cut", "drop_path", "drop_table", "give_back", "held_out", "read", "sample_order", "scratch_path", "shared_dir", "ship", "tune", "without"]

#: Most rows, and bytes, in one Arrow batch handed to Python. Texts may be long, so batches stay small.
ARROW_ROWS = 512
ARROW_BYTES = "4m"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"  # read by the driver, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, and shuffle files that go away when the action that wrote them ends."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def give_back(spark: SparkSession) -> None:
    """Collect the driver's garbage between the jobs of a long run: Spark drops the broadcasts, shuffle records and generated
    classes of ended jobs only then, and a driver with room in its heap would put that off. What Python and the driver's JVM
    have freed outside that heap goes back to the system as well, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # a JVM without that command keeps what it has
        _trim_java(spark)


def _trim_java(spark: SparkSession) -> str:
    """What ``jcmd System.trim_native_heap`` does: the compiler's freed memory, which the C library would keep for each of
    the driver's hundreds of threads, goes back to the system."""
    new, java = spark.sparkContext._gateway.new_array, spark._jvm.java.lang

    def array(kind: object, items: tuple = ()) -> object:
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    bean = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds = [java.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, tuple(kinds)))
    command = array(java.Object, (bean, "systemTrimNativeHeap", array(java.Object), array(java.String)))
    return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), command)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns whose names clash with ``names`` (case does not count)."""
    taken = {n.lower() for n in names}
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from (NULL ids count as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_order(doc_id: str = "doc_id") -> list[Column]:
    """A fixed pseudo-random order for bounded training samples."""
    return [F.xxhash64(F.lit("sample"), F.col(doc_id)), F.col(doc_id)]
