"""Phone parsing over a stream of contact rows; stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contacts import TABLE_HEADERS, ContactTable, explode_phones, without_spam


def stream_contacts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Contact rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_phones(rows: DataFrame) -> DataFrame:
    """The phones of a stream (or table) of contact rows, blocklisted rows left out.

    Same columns and rules as ``explode_phones``; clustering depends on all rows at once and is not
    offered over streams.
    """
    have = [c for c in TABLE_HEADERS if c in rows.columns]
    df = rows.select("row_id", "source_file", F.col("source_row_number").alias("source_row"), *[F.coalesce(c, F.lit("")).alias(c) for c in have])
    return explode_phones(without_spam(ContactTable(df, [TABLE_HEADERS[c] for c in have], have)))
