"""The folder that driver and executors share, and what this program puts there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs in one process,
    as in tests, a local one that is set then; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="spillway-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_roots: list[str] = []


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of one's own in the shared one, until ``clear``."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _roots.append(root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables of this program. Results of operators read them, so write those first."""
    while _roots:
        remove(spark, _roots.pop())
