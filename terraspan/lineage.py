"""Cutting lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset
    in local mode (tests) a temporary one is made.  On a cluster it has to be
    set."""
    global _own_dir
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="terraspan-")
    return "file://" + _own_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def spread(spark: SparkSession) -> int:
    """The number of tasks for rows that are small now and cost much later;
    given as a number, adaptive execution doesn't join them up by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Unlike a checkpoint, later reads load only the columns they need, and the
    planner knows the table's size; loops need that, since the size estimate
    of a checkpoint of joins grows with every turn.  The folder is removed by
    ``drop_tables`` or when the driver exits.
    """
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._terraspan_path = path
    return table


def drop_tables(*tables: DataFrame | None) -> None:
    """Removes tables that ``as_table`` has written and nobody reads again."""
    for t in tables:
        if t is not None and (path := getattr(t, "_terraspan_path", None)):
            _remove(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes what lies at an ``own_path`` and nobody reads again."""
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
        return  # the session has ended
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at the driver's end the JVM may be gone already
        pass
