"""FASTA text as reference chunks, without a whole contig in one row or task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import DEFAULT_WIDTH, cell_of, cell_start
from .bgzf import SPLIT_BYTES, is_blocked, listed, read_blocked_lines

# Fixed value: letters a stored reference may hold.
STORED_BASES = "^[ACGTN]*$"


def read_lines(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Text lines with the file block they came from and their order inside it.

    Block-gzipped files are read by many tasks each, other ``.gz`` files by one.
    """
    files = listed(spark, path)
    blocked = [f for f in files if f[0].endswith((".gz", ".bgz", ".bgzf")) and is_blocked(f[0])]
    if not blocked:
        return _plain_lines(spark.read.text(path))
    parts = read_blocked_lines(spark, blocked, split_bytes=split_bytes)
    others = [u for u, _ in files if u not in {b for b, _ in blocked}]
    if not others:
        return parts
    return _plain_lines(spark.read.text(others)).drop("line_no").unionByName(parts.drop("line_no")).select(
        "file", "block", F.monotonically_increasing_id().alias("line_no"), "line")


def _plain_lines(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def fasta_chunks(lines: DataFrame, width: int = DEFAULT_WIDTH, uppercase: bool = True) -> DataFrame:
    """Reference chunks of FASTA lines ``(file, block, line_no, line)``.

    A line's place in its contig is the running length of the lines before it:
    summed inside each file block, then over the blocks of a file.  The contig
    name is the header text up to the first space.
    """
    text = F.trim("line")
    header = text.startswith(">")
    seq = F.upper(text) if uppercase else text
    rows = lines.select(
        "file", "block", "line_no",
        F.when(header, F.split(F.substring(text, 2, 1 << 30), " ").getItem(0)).alias("name"),
        F.when(header, "").otherwise(seq).alias("seq"))
    rows = rows.withColumn("n", F.length("seq").cast("long"))
    keys = ["file", "block"]
    part = rows.repartition(*keys)
    order = Window.partitionBy(*keys).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = part.withColumn("end", F.sum("n").over(upto))
    opened = F.when(F.col("name").isNotNull(), F.struct("name", "end"))
    inside = inside.withColumn("opened", F.last(opened, ignorenulls=True).over(upto))
    # One row per file block.
    blocks = inside.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.max_by("opened", "line_no").alias("last_opened"))
    across = Window.partitionBy("file").orderBy("block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    carried = F.when(F.col("last_opened").isNotNull(), F.struct(
        F.col("last_opened.name").alias("name"),
        (F.col("base") + F.col("last_opened.end")).alias("end")))
    blocks = blocks.withColumn("entering", F.last(carried, ignorenulls=True).over(before))
    here = F.struct(F.col("opened.name").alias("name"),
                    (F.col("base") + F.col("opened.end")).alias("end"))
    placed = (
        inside.join(blocks.select(*keys, "base", "entering"), keys)
        .where(F.col("n") > 0)
        .select("seq", F.when(F.col("opened").isNotNull(), here).otherwise(
            F.col("entering")).alias("contig"),
            (F.col("base") + F.col("end") - F.col("n") + 1).alias("at"))
        .select(F.col("contig.name").alias("chrom"), "seq",
                (F.col("at") - F.col("contig.end")).alias("start"))
    )
    spread = placed.withColumn("cell", F.explode(F.sequence(
        cell_of("start", width), cell_of(F.col("start") + F.length("seq") - 1, width))))
    first = cell_start("cell", width)
    a = F.greatest(first, F.col("start"))
    b = F.least(first + width - 1, F.col("start") + F.length("seq") - 1)
    cut = spread.select(
        "chrom", "cell", a.alias("at"),
        F.substring(F.col("seq"), (a - F.col("start") + 1).cast("int"),
                    (b - a + 1).cast("int")).alias("bases"))
    joined = cut.groupBy("chrom", "cell").agg(
        F.sort_array(F.collect_list(F.struct("at", "bases"))).alias("p"))
    text = F.array_join(F.transform("p", lambda e: e["bases"]), "")
    last = F.element_at("p", -1)
    span = last["at"] + F.length(last["bases"]) - F.element_at("p", 1)["at"]
    # Pieces of one record never overlap; those of two records of one name do.
    twice = F.raise_error(F.concat(F.lit("two FASTA records are named "), F.col("chrom")))
    return joined.select(
        "chrom", "cell", cell_start("cell", width).alias("start"),
        F.when(F.length(text) == span, text).otherwise(twice.cast("string")).alias("bases"))


def read_fasta(spark: SparkSession, path: str, width: int = DEFAULT_WIDTH,
               uppercase: bool = True) -> DataFrame:
    """Reference chunks of one FASTA file or a folder of them."""
    return fasta_chunks(read_lines(spark, path), width, uppercase)


def contigs_of(ref_chunk: DataFrame) -> DataFrame:
    """``(chrom, length)`` of stored chunks."""
    return ref_chunk.groupBy("chrom").agg(
        F.max(F.col("start") + F.length("bases") - 1).alias("length"))


def unusable_chunks(ref_chunk: DataFrame) -> DataFrame:
    """Chunks with letters outside the stored alphabet."""
    return ref_chunk.where(~F.col("bases").rlike(STORED_BASES))


def subsequences(ref_chunk: DataFrame, windows: DataFrame,
                 width: int = DEFAULT_WIDTH) -> DataFrame:
    """Reference bases of windows ``(region_id, chrom, x, y)``, ends clipped to the contig."""
    cells = windows.where(F.col("x") < F.col("y")).withColumn("cell", F.explode(F.sequence(
        cell_of("x", width), cell_of(F.col("y") - 1, width))))
    a = F.greatest(F.col("start"), F.col("x"))
    b = F.least(F.col("start") + width - 1, F.col("y") - 1)
    pieces = cells.join(ref_chunk, ["chrom", "cell"]).select(
        "region_id", "chrom", "cell",
        F.substring(F.col("bases"), (a - F.col("start") + 1).cast("int"),
                    (b - a + 1).cast("int")).alias("text"))
    return pieces.groupBy("region_id", "chrom").agg(
        F.sort_array(F.collect_list(F.struct("cell", "text"))).alias("p")).select(
        "region_id", "chrom", F.array_join(F.transform("p", lambda e: e["text"]), "").alias("bases"))
