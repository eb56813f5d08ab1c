"""Session helpers: tables, checkpoints, parallelism and joins on hot keys."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task may hold, and the share of all rows above which a key is hot (so there are at most HOT of them).
ROWS, HOT = 10_000, 1_000
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Where none is set a local session gets a temporary one; on a cluster that would be lost with the machine, so it is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again.

    Survives the loss of executors, keeps only the named columns' bytes on disk and lets
    later stages prune columns, which a checkpoint cannot. clear() deletes it.
    """
    spark = df.sparkSession
    folder = os.path.join(checkpoint_root(spark), f"codeweft-{uuid.uuid4().hex}")
    path = os.path.join(folder, name)
    df.write.parquet(path)
    _STAGED.append(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_in = folder
    return out


def forget(df: DataFrame) -> None:
    """Delete the staged table that a later round of a loop has replaced; nothing that is still read may come from it."""
    folder = getattr(df, "_staged_in", None)
    if folder in _STAGED:
        _STAGED.remove(folder)
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables of the results that were written; results still to be read need them. Gives their number."""
    gone = 0
    while _STAGED:
        gone += _delete(spark, _STAGED.pop())
    return gone


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _STAGED else None
    if spark is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001 - the session may end before the interpreter
            pass


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage between steps: shuffle files stay on disk as long as the plans of steps that are over do.

    Twice, as some of it is only held by what the first round collects.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition rows of heavy per-row work when the scan offers fewer tasks than cores.

    The test looks at the planned scan only; with keys the rows are always clustered by them.
    """
    sc = df.sparkSession.sparkContext
    want = max(2 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if keys:
        return df.repartition(want, *keys)
    return df if df.rdd.getNumPartitions() >= sc.defaultParallelism else df.repartition(want)


def unskewed(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left joined with right, whose key is unique and whose column rows counts the rows of left by key.

    Keys of more than one HOTth of all rows cannot be more than HOT: that part of right is broadcast, so their rows of
    left are never brought to one task. The other keys are joined by a shuffle. right should be checkpointed.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = right.filter(F.col(rows) > max(ROWS, total // HOT))
    if hot.isEmpty():
        return left.join(right, key)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(rows) <= max(ROWS, total // HOT)), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)
