"""The shared folder for intermediate tables, and reading the tables of a data set."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where none is set, a temporary one, and only if all run on one machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    path = sc.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tarnwright-")
    if not known.isDefined():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, within the present scope's own folder."""
    return f"{_SCOPE.get() or shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, in whatever store that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """While it lasts, scratch tables go to a folder of their own; at its end this is deleted.  What is computed from them
    must be written elsewhere before."""
    path = scratch_path(spark, name)
    token = _SCOPE.set(path)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        dropped(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
