"""The batch run: exports in, one import-ready CSV out. ``python -m kontorium.plans.pipeline [root] [output]``."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.clusters import capped_clusters
from ..operators.contacts import ContactTable, from_table, without_spam
from ..operators.merge import Merged, merged_contacts, output_columns, slot_widths, stats
from ..session import cut, ship
from ..sources.exports import list_exports, read_contacts
from ..sources.files import is_folder, same_place
from ..sources.sink import clear_outputs, output_name, write_csv


@dataclass(frozen=True)
class RunReport:
    """What a run did; ``output`` is None where there was no input."""

    output: str | None
    source_rows: int = 0
    contacts: int = 0
    merged_clusters: int = 0
    files: int = 0
    message: str = ""


def resolve(t: ContactTable) -> Merged:
    """Cluster the rows of a table and merge each cluster."""
    c = capped_clusters(t)
    return merged_contacts(without_spam(t), cut(c.members, "members"), c.phones)


def export(contacts: ContactTable | DataFrame, path: str) -> RunReport:
    """Resolve a table and write it to the CSV file ``path`` (a path or URI); an existing file is replaced.

    ``contacts`` is a ContactTable or a table with the columns of contact_rows. An empty table gives a file
    with its header only.
    """
    t = contacts if isinstance(contacts, ContactTable) else from_table(contacts)
    ship(t.df.sparkSession)
    m = resolve(t)
    m = Merged(cut(m.df, "merged"), m.header, m.scalars)
    header, columns = output_columns(m, slot_widths(m))
    write_csv(m.df, header, columns, "cluster_id", path)
    s = stats(t.df, m).first()
    return RunReport(path, s["source_rows"], s["contacts"], s["merged_clusters"])


def run(spark: SparkSession, input_dir: str, output_dir: str, clock: Callable[[], datetime] = datetime.now) -> RunReport:
    """Clear the output folder, then read, resolve and write; a missing or empty input only reports.

    The output folder must not be the input folder, whose files the clearing would delete.
    """
    if same_place(spark, input_dir, output_dir):
        raise ValueError("the output folder is the input folder")
    ship(spark)
    clear_outputs(spark, output_dir)
    if not is_folder(spark, input_dir):
        return RunReport(None, message=f"no input folder: {input_dir}")
    files = list_exports(spark, input_dir)
    if not files:
        return RunReport(None, message=f"no CSV files in {input_dir}")
    t = read_contacts(spark, input_dir)
    done = export(t.with_df(cut(t.df, "rows")), output_dir.rstrip("/") + "/" + output_name(clock()))
    return replace(done, files=len(files))


def main(args: list[str]) -> None:
    """Entry point: ``root`` (default .) holds ``input``; output goes to ``output`` under it unless named."""
    from ..session import local_session

    root = args[0] if args else "."
    report = run(local_session(), os.path.join(root, "input"), args[1] if len(args) > 1 else os.path.join(root, "output"))
    if report.output is None:
        print(report.message)
        return
    print(f"{report.source_rows} rows of {report.files} files -> {report.contacts} contacts, {report.merged_clusters} merged")
    print(report.output)


if __name__ == "__main__":
    main(sys.argv[1:])
