"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, and rows that a scan decodes at once.  Texts can be long; a batch is held as a whole.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 2000, 4 << 20, 512
#: A name is hot when it has more than one in so many of all rows; there cannot be more hot names than this.
HOT_SHARE = 1000


def tune(spark: SparkSession) -> None:
    """Keep the batches of scans and of Arrow small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def _release() -> None:
    """Give memory that is free, but kept by an allocator, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the Python worker keeps no memory but what it needs: idle workers of earlier stages stay alive."""

    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which every executor sees.

    Only where the setting is unset and the master is local, so that there is one machine, a folder there is taken; on a cluster
    that is an error.  What is left of the folder when the application has ended can be deleted.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return os.path.join(found, f"paperloom-{sc.applicationId}")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), uuid.uuid4().hex)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``frames``, which nothing lazy may depend on any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _trimmed(spark: SparkSession) -> bool:
    """Let the driver's JVM give memory outside its heap that is free, but kept by the allocator, back to the machine, as ``_release``
    does; with hundreds of threads that adds up.  It is a management command of the JVM; false if this one doesn't have it."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, *values):
        out = array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        of = jvm.java.lang.Class.forName
        types = filled(jvm.java.lang.Class, *(of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values = filled(jvm.java.lang.Object, name, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0))
        of("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def swept(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and compiled plans of rounds that are over; it does so when the driver's garbage is
    collected, which may else not happen for long.  What that leaves free outside the heap goes back to the machine."""
    spark.sparkContext._jvm.System.gc()
    _trimmed(spark)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The columns an operator reads (old=new name) and no others, whatever they are called."""
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in columns.items()))


def joined_by(rows: DataFrame, one: DataFrame, names: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``one`` (stored; a row for each of ``names``, and ``count``, how many rows have them) on ``names``.

    A hot name's rows do not meet in one task: the rows of ``one`` whose names hold more than a HOT_SHARE-th of all rows, at
    most HOT_SHARE by their definition, are broadcast to where the rows lie; only the others are shuffled by name.
    """
    total, most = one.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(1, total // HOT_SHARE)
    if most <= limit:
        return rows.join(one, names)
    few, many = F.broadcast(one.where(F.col(count) > limit)), one.where(F.col(count) <= limit)
    return rows.join(few, names).unionByName(rows.join(F.broadcast(few.select(*names)), names, "left_anti").join(many, names))
