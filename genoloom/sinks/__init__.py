"""Text writers: variant TSV, sequences, sample lists, DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variant_lines(listed: DataFrame) -> DataFrame:
    """``Pos  Ref  Alt  Samples`` rows of nested variants ``(…, samples)``; every sample is
    followed by a blank."""
    samples = F.array_join(F.transform("samples", lambda e: F.concat(
        e["sample"], F.lit("("), e["phasing"], F.lit(") "))), "")
    return listed.withColumn("samples", samples)


def write_variants(listed: DataFrame, path: str, pos: str = "pos") -> None:
    """Variant TSV with its header, one folder for all regions of the batch.

    A variant's samples come in parts, a line each with its ``Part``; rows in sample
    coordinates have both positions.
    """
    both = [F.col("sample_pos").alias("SamplePos")] if "sample_pos" in listed.columns else []
    variant_lines(listed).orderBy("region_id", pos, "ref", "alt", "part").select(
        "region_id", F.col(pos).alias("Pos"), *both, F.col("ref").alias("Ref"), F.col("alt").alias("Alt"),
        F.col("samples").alias("Samples"), F.col("part").alias("Part"),
    ).write.mode("overwrite").csv(
        path, sep="\t", header=True, quote="", emptyValue="", ignoreTrailingWhiteSpace=False,
        ignoreLeadingWhiteSpace=False)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """``region_id  sequence`` lines in region order."""
    sequences.orderBy("region_id").select(
        F.concat_ws("\t", F.col("region_id").cast("string"), "sequence").alias("value")
    ).write.mode("overwrite").text(path)


def write_path(pieces: DataFrame, path: str) -> None:
    """A whole sequence, a line per grid cell; the part files in name order spell it."""
    pieces.orderBy("cell").select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def write_samples(found: DataFrame, path: str) -> None:
    """``query_id  name phasing`` lines, one carrier a line."""
    found.orderBy("query_id", "sample_id").select(
        F.concat(F.col("query_id").cast("string"), F.lit("\t"), "name", F.lit(" "), "phasing")
        .alias("value")
    ).write.mode("overwrite").text(path)


def write_dot(lines: DataFrame, path: str) -> None:
    """DOT lines of one root; the part files in name order make the DOT file."""
    lines.orderBy("root", "section", "a", "b").select(F.col("line").alias("value")).write.mode(
        "overwrite").text(path)
