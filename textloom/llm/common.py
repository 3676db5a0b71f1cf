"""Shared helpers: tables, scratch storage and plain column idioms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch handed to Python: texts may be long, so rows alone are no bound.
ARROW_BYTES = 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(col, UPPER, LOWER)


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode (tests, a laptop) is a folder of our own
    under /tmp used; it is recorded in the session so that later calls agree. On a cluster no
    local folder would do, so there the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textloom.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file:///tmp/textloom-scratch-{uuid.uuid4().hex[:8]}"
        spark.conf.set("textloom.scratch.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/textloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._textloom_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table made by ``stored`` that no later plan reads."""
    path = getattr(df, "_textloom_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound what one Arrow batch of whole texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def numbered(df: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """Add ``row_number_global`` (0-based, in ``order``) without a single-task window.

    Rows are range-partitioned and sorted; each partition numbers its own rows and
    only one count per partition comes to the driver. Ties in ``order`` are broken
    by position, so pass enough columns that tied rows are interchangeable.
    """
    spark = df.sparkSession
    # the last range column is the row's place in the input: a run of equal keys can be cut anywhere
    ranged = (
        df.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_place")
        .sortWithinPartitions(*order, "_place")
        .drop("_place")
        .withColumn("_m", F.monotonically_increasing_id())
    )
    kept = stored(ranged, label)
    counts = sorted((r["p"], r["n"]) for r in kept.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    place = spark.createDataFrame(offsets or [(0, 0)], "_p long, _offset long")  # one row per partition
    out = (
        kept.withColumn("_p", F.shiftright("_m", 33))
        .join(F.broadcast(place), "_p")
        .withColumn("row_number_global", F.col("_offset") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_m", "_offset")
    )
    return out, total


#: Rows of a narrow table (an id or two) that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a broadcast hint if it is counted to be within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tidied(function):
    """A mapInArrow function that, at its partition's end, gives freed memory back to the system.

    Python workers are reused, and what one stage has freed would otherwise stay with the
    process while the next one needs memory of its own.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
