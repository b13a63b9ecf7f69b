"""Intermediate tables in the shared folder that the cluster names.

``spark.checkpoint.dir`` is read from the session. Only where it is unset and the executors run inside the driver
(tests, a laptop) is a local folder made and set; a cluster must name one. Tables written here cut the lineage: an executor that is lost
later costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset; with master {master} it must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody else uses; removed when the driver ends."""
    path = f"{shared_root(spark)}/quillspark-{uuid.uuid4().hex}-{name}"
    _PATHS[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back; its plan then is a scan."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def tables() -> set[str]:
    """Paths of the intermediate tables that are there now."""
    return set(_PATHS)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing will read again."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        remove(path)


def remove(path: str) -> None:
    spark = _PATHS.pop(path, None)
    if spark is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_PATHS):
        try:
            remove(path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return
