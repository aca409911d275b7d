"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "palisade") -> SparkSession:
    """Session for tests and the bench.  On a cluster use your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Capturing a Python call site per Column call triples the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own, once.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="palisade-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: what is large, or is read
    again by a few of its columns, takes less room so than in a checkpoint."""
    return stored_in(df)[0]


def stored_in(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as it is ``stored``, and its folder, which ``remove_table`` frees when nothing reads it any more."""
    folder = f"{shared_folder(df.sparkSession)}/table-{os.urandom(8).hex()}"
    if _OWNED:
        _OWNED[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def remove_table(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of the tables that were stored inside each open ``owned_tables``.
_OWNED: list[list[str]] = []


@contextmanager
def lasting_tables() -> Iterator[None]:
    """Tables that are ``stored`` inside outlive the open ``owned_tables``."""
    _OWNED.append([])
    try:
        yield
    finally:
        _OWNED.pop()


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` inside are removed at the end: for work that leaves nothing lazy behind."""
    _OWNED.append([])
    try:
        yield
    finally:
        for folder in _OWNED.pop():
            remove_table(spark, folder)
