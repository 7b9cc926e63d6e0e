"""Writing contacts as one CSV with CRLF line ends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_escape
from . import files

# The format of the output's file name.
NAME_FORMAT = "%Y%m%d_%H%M%S"
NAME_END = "_google_reimport.csv"


def output_name(now: datetime) -> str:
    """File name of a run that began at ``now``."""
    return now.strftime(NAME_FORMAT) + NAME_END


def csv_line(columns: list) -> F.Column:
    """The cells of a record, escaped and joined by commas."""
    return F.concat_ws(",", *[csv_escape(c) for c in columns])


def escape_text(v: str) -> str:
    """``csv_escape`` for a header cell."""
    return '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"\r\n') else v


def header_line(header: list[str]) -> str:
    """The header record."""
    return ",".join(escape_text(h) for h in header)


def write_csv(df: DataFrame, header: list[str], columns: list, order: str, path: str) -> None:
    """Write ``columns`` of ``df`` by ``order`` to the file ``path`` (a path or URI), after a header record.

    Executors write sorted parts beside the file, which the file system then joins, so no task or process
    holds the whole output. The parts must hold the bytes that were written, else it fails.
    """
    parts, seen = path + ".parts", Observation()
    lines = df.select(F.col(order).alias("_o"), csv_line(columns).alias("value")).orderBy("_o").select("value")
    lines = lines.observe(seen, F.sum(F.octet_length("value") + 2).alias("bytes"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(parts)
    files.join_parts(df.sparkSession, (header_line(header) + "\r\n").encode(), parts, path, seen.get["bytes"] or 0)
    files.delete(df.sparkSession, parts)


def clear_outputs(spark: SparkSession, folder: str) -> None:
    """Make the folder and delete the *.csv files in it, ignoring those that resist."""
    files.make_folder(spark, folder)
    for f, _ in files.list_files(spark, folder, ".csv"):
        try:
            files.delete(spark, f)
        except Exception:  # noqa: BLE001 - whatever the file system says
            pass
