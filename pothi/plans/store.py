"""Tables written between the stages of a plan.

A stage that several later stages read is written once as parquet and read
back, which cuts lineage and survives the loss of executors.  The folder is
the one the cluster names in ``spark.checkpoint.dir``.  Where that is unset, a
temporary folder of this machine serves a local master; on a cluster it is an
error, because each executor would write to a disk of its own.

Tables are removed when the driver ends, also after its session was stopped, or
earlier by ``release``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
#: Paths with what removes them: the JVM view and the Hadoop configuration of their session, which outlive the session.
_written: dict[str, tuple[Any, Any]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="pothi-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return "file://" + _local


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pothi/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def release(kept: frozenset[str] = frozenset()) -> None:
    """Remove the tables written so far, but for the ``kept`` paths; plans that read them can run no more."""
    for path in [p for p in _written if p not in kept]:
        jvm, configuration = _written.pop(path)
        try:
            if SparkContext._gateway is not None:
                hadoop = jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(configuration).delete(hadoop, True)
        except Exception:  # noqa: BLE001, S110 - the gateway may be gone already
            pass


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are removed when the block ends; what it returns must have been written elsewhere by then."""
    before = frozenset(_written)
    try:
        yield
    finally:
        release(before)
