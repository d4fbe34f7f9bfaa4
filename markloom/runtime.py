"""Session helpers: shared folder, lineage cuts, table reading."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all executors are
    threads of this process (tests, a single machine) a folder of our own is made, set as the
    checkpoint folder and deleted at the end of the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        made = tempfile.mkdtemp(prefix="markloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        own = "file://" + made
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted at the end of the process if Spark still runs then."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; nothing happens where it or the session is gone."""
    context = spark.sparkContext
    with contextlib.suppress(Exception):
        if context._jsc is not None and not context._jsc.sc().isStopped():
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def strip_blanks(col):
    """Trim every kind of blank, not only U+0020."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")
