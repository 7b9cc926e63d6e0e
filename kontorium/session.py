"""Sessions, and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, set[str]] = {}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kontorium")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder of its own; on a cluster it is an error,
    since every host would write to its own disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all hosts share in spark.checkpoint.dir")
    key = spark.sparkContext.applicationId
    if key not in _OWN_FOLDERS:
        _OWN_FOLDERS[key] = tempfile.mkdtemp(prefix="kontorium-")
        atexit.register(_remove_local, _OWN_FOLDERS[key])
    return _OWN_FOLDERS[key]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application, so they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kontorium-code-")  # on the driver, which serves it to the executors
    atexit.register(_remove_local, folder)
    path = os.path.join(folder, "kontorium.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Lineage ends at the written table, so a lost executor costs only the tasks it ran. Columns keep
    their order, names and types.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kontorium-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kontorium_path = path  # for drop()
    return out


def written(spark: SparkSession, path: str) -> None:
    """Have a folder deleted with the tables that ``cut`` writes."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a ``cut`` result that nothing reads any more."""
    path = getattr(df, "_kontorium_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application; results not yet used up need theirs."""
    for path in list(_WRITTEN.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


@atexit.register
def _clear_at_exit() -> None:
    """What a process wrote is of no use after it; on a shared file system the JVM deletes it."""
    from pyspark import SparkContext

    for paths in _WRITTEN.values():
        for path in paths:
            url = urlparse(path)
            try:
                if url.scheme in ("", "file"):
                    _remove_local(url.path)
                else:
                    jvm = SparkContext._gateway.jvm
                    p = jvm.org.apache.hadoop.fs.Path(path)
                    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
            except Exception:  # noqa: BLE001 - nothing can be done about it any more
                pass


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a shuffle gets in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
