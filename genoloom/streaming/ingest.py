"""Variant files that arrive over time.

A stream watches a folder and adds the calls of each new file to a cohort's stored
calls; ``plans.build.update_relations`` then brings sites, carriers and what follows from
them up to date on the contigs that they touch.  A batch writes a folder named after its number, so one that
is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.vcf import carrier_calls, parse_records


def store_batch(lines: DataFrame, batch: int, path: str, allele_aware: bool = True) -> None:
    """Write the calls of one batch of lines ``(file, line)`` under ``path``, beside the
    calls ``construct`` stores as batch 0.  Records are numbered over all batches when they
    are read."""
    carrier_calls(parse_records(lines), allele_aware).write.mode("overwrite").parquet(f"{path}/calls/batch={batch + 1}")


def ingest_files(spark: SparkSession, folder: str, path: str, checkpoint: str, *,
                 allele_aware: bool = True, available_now: bool = True) -> StreamingQuery:
    """Start adding the VCF files of ``folder`` to the calls of the cohort at ``path``.

    With ``available_now`` the query takes what is there and ends; otherwise it keeps
    watching.  ``checkpoint`` remembers which files were taken.
    """
    lines = spark.readStream.format("text").load(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: store_batch(df, n, path, allele_aware))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
