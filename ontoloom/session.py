"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    all runs on one machine, as in tests, a temporary folder is made."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ontoloom-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there:
    the lineage ends, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables ``written`` has made and ``settled`` may delete.
_MADE: list[DataFrame] = []


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back: like
    ``cut``, but smaller on disk and read by column. It is deleted when the driver
    ends, or by ``discard`` before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _MADE.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_written", None):
            place, files = _files(table.sparkSession, path)
            files.delete(place, True)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written; the tables it wrote on the way are deleted, and
    so are the shuffle files that nothing refers to any more."""
    mark = len(_MADE)
    out = written(build())
    discard(*_MADE[mark:-1])
    _MADE[mark:] = [out]
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``rows`` rows; beyond that
    the join stays a shuffle join. ``df`` should be cheap to count."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
