"""What the operators share: tables cut off from their lineage, a bitmap filter and running sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words is these six characters; anything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the membership bitmap: 2 MB however many keys there are.
BITS = 24
#: Rows an Arrow batch may hold; the operators cut batches further by text size.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one, in local mode only: there is one machine then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, label: str, *, by: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """Writes df to a new Parquet table in the shared folder and reads it back, which cuts its lineage.

    The table outlives lost executors. by: columns that become folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = (df.write.partitionBy(*by) if by else df.write).option("compression", compression)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes tables that save() wrote, once nothing that is still to run reads them."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers get at most so many rows at once, as texts may be long. Never raised again: a plan reads it when it runs, after others were made."""
    held = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, held) if held > 0 else rows))


def give_back(collect: bool = True) -> None:
    """At a task's end, or between its batches: hands freed memory back to the system, as the worker process lives on beside the executor's heap and serves other tasks."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def driver_gives_back(spark: SparkSession) -> None:
    """Between the rounds of a long operator: the driver's heap is collected, so that Spark's cleaner lets go of shuffles and broadcasts that no
    plan holds any more, and what the JVM has freed goes back to the system. Plans of many short jobs else fill heap and malloc's arenas to their limits."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with contextlib.suppress(Exception):  # a command of newer JVMs under Linux; without it only the heap shrinks
        kinds = array(jvm.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(name)
        values = array(jvm.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by reflection, as the class of the server is not public
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def bitmap_of(keys: DataFrame, *cols: str, bits: int = BITS) -> DataFrame:
    """A one-hash Bloom filter of the keys, as rows of (bucket, bitmap); its size doesn't depend on the keys' number."""
    at = F.pmod(F.xxhash64(*cols), F.lit(1 << bits))
    return keys.select(at.alias("at")).distinct().groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bitmap"))


def with_hit(df: DataFrame, bitmap: DataFrame, *cols: str, bits: int = BITS) -> DataFrame:
    """df with a boolean _hit: false only where the row's key isn't among the bitmap's. The bitmap is of fixed size, so it is broadcast."""
    at = F.pmod(F.xxhash64(*cols), F.lit(1 << bits))
    held = df.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at")).withColumn("_pos", F.bitmap_bit_position("_at"))
    bit = F.expr("shiftright(cast(conv(hex(substring(_bitmap, cast(_pos div 8 as int) + 1, 1)), 16, 10) as int), cast(_pos % 8 as int)) & 1")
    return held.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_hit", F.coalesce(bit == 1, F.lit(False))).drop("_at", "_bucket", "_pos", "_bitmap")


def running_start(df: DataFrame, group: list[str], bucket: Column, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds the sum of weight over the rows of the group that come before a row.

    bucket must rise with order; a group's rows are summed by bucket first, and rows meet only within one bucket, so no task
    gets a whole group. Ties in order share no place: the order must be total.
    """
    b = df.withColumn("_b", bucket)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = b.groupBy(*group, "_b").agg(F.sum(weight).alias("_w")).select(*group, "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(base, [*group, "_b"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("_b", "_base")
