"""Session helpers: a local session for tests and bench, lineage cutting, scratch paths."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# A table of up to so many bytes of numbers is sent to every worker where a wide row would be shuffled else.
BROADCAST_BYTES = 200_000_000
# So many narrow rows are sorted or summed in one task where the number of parts follows the rows.
ROWS_PER_PART = 1_000_000


def local_session(cpus: int = 8, app: str = "revloom", memory: str = "8g") -> SparkSession:
    """A ``local[cpus]`` session for tests and the benchmark. On a cluster, pass your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session names, or a temporary one in local mode.

    A machine-local folder would be lost with its executor, so on a cluster an unset
    ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # "local-cluster" has executors of its own; only "local" and "local[…]" share the driver's disk.
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="revloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def pin(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    This cuts the lineage: used where recomputation could change the answer (sampled range
    bounds) or where a loop would let the plan grow. A table, other than a checkpoint, also tells
    the optimiser its true size; checkpoints keep the estimate of the plan they replace, which
    multiplies with every join of a loop.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_workers(spark: SparkSession, rows: int, row_bytes: int) -> bool:
    """Whether a table of so many rows may be sent to every worker: never if the session forbids broadcasts."""
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().startswith("-"):
        return False
    return rows * row_bytes <= BROADCAST_BYTES


def parts_of(spark: SparkSession, rows: int, per_part: int = ROWS_PER_PART) -> int | None:
    """Number of parts of at most so many rows; none where the session's exchanges leave no more than that in a task."""
    parts = -(-rows // per_part)
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts if parts > usual else None


def deal(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """Rows in so many parts by their columns ``by``; as they are where no number is given."""
    return df.repartition(parts, *by) if parts else df


def free_shuffles(spark: SparkSession) -> None:
    """Ask for the end of shuffle files that nothing refers to: they stay until the driver collects its garbage,
    which a driver that holds little does not do for hours."""
    gc.collect()
    spark._jvm.System.gc()


def unpin(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete pinned tables that nothing reads any more (a loop's earlier rounds)."""
    jvm = spark._jvm
    for table in tables:
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
