"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: of intermediate tables: they are read a few times only, so what they take on disk counts more than the time to unpack them
CODEC = "zstd"
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", name: str = "estatelake") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    n = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, below the folder named by ``spark.checkpoint.dir``.

    Only a single-machine session may do without that setting: executors of a cluster
    cannot read a folder that exists on the driver alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="estatelake-")
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the working folder and read back.

    Later passes do not repeat its plan, a lost executor loses nothing, and the planner knows
    the true size: a small table is broadcast, a large one is not.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the working area through Spark's own file system access."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``keep(df, name)`` stores like ``stored``; all of it is removed when the block ends.

    For jobs whose results are complete by then, above all those that repeat for ever.
    """
    root = work_dir(spark, purpose)

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}"
        df.write.option("compression", CODEC).parquet(path)
        return spark.read.parquet(path)

    try:
        yield keep
    finally:
        remove_folder(spark, root)
