"""Session helpers: tables, the shared checkpoint folder, partition sizing."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``checkpoint()``.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only where
    that is unset and all tasks run in this process (``local[n]``, as in tests)
    a temporary folder is used; on a cluster each machine would write its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"quirewell-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read back.

    Cuts the lineage as ``cut`` does; the columnar file is several times
    smaller than a checkpoint of the same narrow rows. The table goes when the
    program ends.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *cols: str, factor: int = 1) -> DataFrame:
    """Repartition by hash so that every core of the cluster has work.

    Used before CPU-heavy Python stages over few input splits; the number of
    partitions follows the cluster's parallelism, never the data of a test.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism * factor, 2)
    return df.repartition(n, *cols) if cols else df.repartition(n)
