"""Files on any file system that Spark reaches.

The driver lists, deletes and joins files through Hadoop's file systems, so a folder may be a path or any URI
that the session knows. Executors open an input file by its path, or through pyarrow where it has another scheme.
"""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of a path or URI; local files without their checksum layer, which leaves files beside them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), p


def bare_path(uri: str) -> str:
    """A local file's URI as a path; other URIs and paths as they are."""
    return uri if not uri.startswith("file:") else "/" + uri[5:].lstrip("/")


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    """True where two paths or URIs name one folder, links between local ones followed."""
    import os

    full = [fs.makeQualified(p).toString() for fs, p in (_at(spark, x) for x in (a, b))]
    return full[0] == full[1] or os.path.realpath(bare_path(full[0])) == os.path.realpath(bare_path(full[1]))


def list_files(spark: SparkSession, folder: str, end: str = "") -> list[tuple[str, int]]:
    """(path or URI, bytes) of the files in a folder whose name ends so, not below it, by name."""
    fs, p = _at(spark, folder)
    found = [(s.getPath().getName(), bare_path(s.getPath().toString()), s.getLen()) for s in fs.listStatus(p) if s.isFile()]
    return [(path, size) for name, path, size in sorted(found) if name.endswith(end)]


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens where there is none."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def join_parts(spark: SparkSession, head: bytes, parts: str, path: str, size: int) -> None:
    """The file ``path``: ``head`` and the part files of a written folder, in order; their bytes never enter Python.

    Fails where the parts do not hold ``size`` bytes, as when some lie on other hosts' disks.
    """
    found = [(f, n) for f, n in list_files(spark, parts) if f.rsplit("/", 1)[-1].startswith("part-")]
    held = sum(n for _, n in found)
    if held != size:
        raise RuntimeError(f"{parts} holds {held} bytes of the {size} written; is it on a file system that all hosts share?")
    fs, p = _at(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    out = fs.create(p, True)
    try:
        out.write(bytearray(head))
        for f, _ in found:
            part, at = _at(spark, f)
            data = part.open(at)
            try:
                hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)
            finally:
                data.close()
    finally:
        out.close()


def open_input(path: str) -> BinaryIO:
    """A file's bytes, on an executor."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_stream(inner)
