"""What the operators share: table access, shared-folder tables, bounded broadcasts, slots."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The most rows a table may have to be broadcast; at under 100 bytes a row that is a few megabytes.
SMALL_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="geosieve-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(taken: list[str], *names: str) -> list[str]:
    """`names`, each with underscores before it until no column of `taken` is called so (in any case)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage, and lost executors don't cost the work again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint if `df` has at most `most` rows (counted here); else `df`, which Spark then joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_offsets(df: DataFrame, group: list[str], bucket: str, order: list, amount: str | None, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` (rows, if None) over the rows before this one in its group.

    Rows stand in order of `bucket`, then `order`. Each (group, bucket) is summed by itself; a window over
    those few sums gives where each begins. No task holds more than one bucket of a group.
    """
    value = F.lit(1) if amount is None else F.col(amount)
    key = [*group, bucket]
    sums = df.groupBy(*key).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if group else before
    begins = sums.select(*(F.col(c).alias(f"_{c}") for c in key), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = [inner[c].eqNullSafe(begins[f"_{c}"]) for c in key]
    return inner.join(if_small(begins), on, "left").withColumn(name, (F.col("_within") + F.col("_begin")).cast("long")).drop("_within", "_begin", *(f"_{c}" for c in key))


def lean() -> None:
    """In a Python worker: freed memory goes back to the system at once, as two workers and a JVM share an executor."""
    import ctypes
    import contextlib

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: larger blocks are mapped and unmapped
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-8, 1)  # M_ARENA_MAX
