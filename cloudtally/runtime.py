"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even when that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a task's share has a bound of its own, whatever the input: Spark's 64 and 128 MB hold millions of rows in a hash table
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are written for."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
INPUT_PER_PART = 16 << 20  # bytes of the input folder for each partition of a shuffle


def partitions_for(size: int, least: int) -> int:
    return max(least, -(-size // INPUT_PER_PART))


def size_shuffles(spark: SparkSession, folder: str | None) -> None:
    """Let shuffles begin with partitions in proportion to the input, so that a task's share does not grow with it.

    Adaptive execution coalesces the small ones. Never fewer than ``spark.sql.shuffle.partitions``, which stays as it
    is; without a folder that number holds again.
    """
    if folder is None:
        spark.conf.unset(INITIAL)
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    spark.conf.set(INITIAL, str(partitions_for(size, int(spark.conf.get("spark.sql.shuffle.partitions")))))


FINER = 4  # partitions for each one that a shuffle begins with, where a step keeps its whole share in memory
STREAMED = "spark.shuffle.sort.bypassMergeThreshold"  # up to so many partitions a task writes its rows as they come


def dealt(df: DataFrame, *keys: str, scanned: bool = False) -> DataFrame:
    """Rows of equal ``keys`` together, for sums of keys that are nearly as many as the rows.

    Such a sum keeps its whole share in memory and gains nothing by summing before the shuffle, where the share would be
    a row group of a file. A large input gets ``FINER`` partitions for each one that ``size_shuffles`` has set;
    otherwise adaptive execution coalesces them.

    Rows that come ``scanned`` from files go through a shuffle of at most ``STREAMED`` partitions first: to more of them a task
    writes its rows from memory, and its rows may be a row group that holds the whole file.
    """
    conf = df.sparkSession.conf
    least = int(conf.get("spark.sql.shuffle.partitions"))
    first = int(conf.get(INITIAL, str(least)))
    large = first > least
    parts = FINER * first if large else first
    streamed = int(df.sparkSession.sparkContext.getConf().get(STREAMED, "200"))
    if scanned and parts > streamed > 0:
        # renamed in between: Spark drops the first of two shuffles that follow each other
        df = df.withColumnRenamed(keys[0], "_dealt").repartition(streamed, "_dealt", *keys[1:]).withColumnRenamed("_dealt", keys[0])
    return df.repartition(parts, *keys) if large else df.repartition(*keys)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Only a session whose tasks all run in the driver's process may do without the setting: it gets
    a fresh temporary folder. On a cluster each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_FOLDERS: set[str] = set()


def new_folder(spark: SparkSession) -> str:
    """A path under the shared folder that nothing uses yet; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/cloudtally-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every intermediate folder this driver has made so far; results must be consumed by then."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


_STORED: WeakSet[DataFrame] = WeakSet()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors, and pins results that must be seen
    identically by several consumers (for example range-partition numbers). A table that is
    durable already comes back as it is.
    """
    if df in _STORED:
        return df
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED.add(stored)
    return stored
