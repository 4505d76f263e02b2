"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quirefold", cores: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where it is unset.

    On a cluster the setting names storage that every executor reaches, so what
    is written there outlives a lost executor.  A session on one machine without the
    setting is a test, where a temporary folder will do; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


_MADE: list[tuple[SparkSession, str]] = []


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; it is removed when the driver ends, or by ``clean``."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _MADE.append((spark, path))
    return path


def read_folder(path: str, columns: list[str]):
    """A folder of parquet files as an Arrow table, read by a worker from any file system; None if there is none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    return ds.dataset(inner, filesystem=system, format="parquet", exclude_invalid_files=True).to_table(columns=columns)


def clean() -> None:
    """Removes what ``scratch`` and ``cut`` have written; results that were not read yet go with it."""
    while _MADE:
        try:
            remove(*_MADE.pop())
        except Exception:  # the JVM has ended already
            return


atexit.register(clean)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan that would run in fewer tasks than there are cores, spread over them; any other as it is.

    Only a table of a few row groups is moved, so the cost has a bound; at scale
    the scan's own splits keep all cores busy and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
