"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the digest of its text.  The ledger keeps, for
each pair of blob and rule version that was scanned, the findings, an empty list included.
A scan reads the text of blobs whose pair is not in the ledger, one version per blob, adds
their findings as a new batch and joins the ledger back to all paths.  All of it is plain
DataFrame work.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.session import cut_lineage

@dataclass(frozen=True)
class ScanRule:
    """Leftmost non-overlapping matches of ``pattern``, which has no groups; kept if group 1
    of ``value`` on a match, or the match where there is none, has ``least`` characters.
    ``hint`` is a pattern that every text with a kept match contains."""

    kind: str
    pattern: str
    least: int
    value: str | None = None
    hint: str | None = None


_KEY = "(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    ScanRule("assign", f"{_SIGN}{_VALUE}+", 6, f"^{_SIGN}({_VALUE}+)", f"{_SIGN}{_VALUE}{{6}}"),
    ScanRule("access", "AKIA[A-Z0-9]+", 20, None, "AKIA[A-Z0-9]{16}"),
    ScanRule("hex", "[0-9a-f]{24,}", 24),
)
# Beside the base kinds: heads of private key blocks.
RULES = (*BASE, ScanRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 26))


def findings(texts: DataFrame, rules: tuple[ScanRule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs among ``texts`` (blob, text) that have kept matches.

    ``spans`` is an array of (start, place, end, kind) in that order, in code points, ends
    exclusive; ``place`` is the rule's.  A text is cut at a rule's matches: gaps and
    matches take turns, so running sums of their lengths are the places.
    """
    text = F.col("text")
    cuts = []
    for k, r in enumerate(rules):
        found = F.regexp_extract_all(text, F.lit(f"({r.pattern})"), F.lit(1))
        kept = (lambda r: lambda m: F.length(m if r.value is None else F.regexp_extract(m, r.value, 1)) >= r.least)(r)
        cut = F.struct(
            F.lit(k).alias("place"), F.transform(F.split(text, r.pattern, -1), F.length).alias("gaps"),
            F.transform(found, F.length).alias("sizes"), F.transform(found, kept).alias("kept"))
        cuts.append(F.when(text.rlike(r.hint or r.pattern), cut))
    hit = texts.select("blob", F.array_compact(F.array(*cuts)).alias("cuts")).where(F.size("cuts") > 0)
    one = hit.groupBy("blob").agg(F.first("cuts").alias("cuts"))  # equal blobs have equal cuts
    rows = one.select("blob", F.explode("cuts").alias("c")).select(
        "blob", "c.place", F.posexplode(F.arrays_zip(
            F.slice("c.gaps", F.lit(1), F.size("c.sizes")).alias("gap"), F.col("c.sizes").alias("size"), F.col("c.kept").alias("kept"))).alias("at", "x"))
    upto = F.sum(F.col("x.gap") + F.col("x.size")).over(Window.partitionBy("blob", "place").orderBy("at")).cast("bigint")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("place") + 1)
    spans = rows.select("blob", "x.kept", F.struct(
        (upto - F.col("x.size")).alias("start"), "place", upto.alias("end"), kind.alias("kind")).alias("span")).where("kept")
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))


class Ledger:
    """What was scanned and found, as tables below one folder, a batch per scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str, version: str) -> DataFrame:
        """A table's batches that were committed; an empty one if there are none."""
        spans = f"batch string, version string, {schema}"
        try:
            committed = self.spark.read.schema("batch string, version string").parquet(f"{self.folder}/commits")
            rows = self.spark.read.schema(spans).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], spans).drop("batch", "version")
        return rows.where(F.col("version") == version).join(committed, ["batch", "version"], "left_semi").drop("batch", "version")

    def scanned(self, version: str) -> DataFrame:
        return self._read("scanned", "blob string", version)

    def found(self, version: str) -> DataFrame:
        return self._read("found", f"blob string, spans {SPANS}", version)

    def add(self, scanned: DataFrame, found: DataFrame, version: str) -> None:
        """Appends a batch; it counts once its commit row, written last, is there."""
        batch = uuid.uuid4().hex
        for name, rows in (("scanned", scanned), ("found", found)):
            rows.select(F.lit(batch).alias("batch"), F.lit(version).alias("version"), "*").write.mode("append").parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(batch, version)], "batch string, version string").coalesce(1).write.mode("append").parquet(
            f"{self.folder}/commits")


SPANS = "array<struct<start: bigint, place: int, end: bigint, kind: string>>"


def scan(versions: DataFrame, ledger: Ledger, *, rules: tuple[ScanRule, ...] = RULES, rule_version: str = "1",
         path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Findings of every version: ``path_cols``, ``blob`` and ``spans`` for each row.

    ``versions`` has a row per path and version.  Blobs that the ledger has for this rule
    version are not scanned again; of the others one version each is.  A null text counts
    as empty; rows without findings have empty spans; repeated rows come out repeated.  Of
    the other columns none is read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = versions.select(*path_cols, text.alias("text"))
    # ``at`` names a path in one column that may be null in none.
    at = F.xxhash64(*path_cols).alias("at")
    paths = cut_lineage(texts.select(*path_cols, at, F.sha2(F.col("text").cast("binary"), 256).alias("blob")))
    unseen = cut_lineage(paths.groupBy("blob").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).join(
        ledger.scanned(rule_version), "blob", "left_anti"))
    # The thin side is hashed, so that texts are moved once and not sorted; each version
    # meets its own blob alone, and the versions of one path spread over their blobs.
    # No digest is null; said so, lest each is made once more to check it.
    own = texts.select(at, F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("blob"), "text")
    chosen = own.join(unseen.hint("shuffle_hash"), ["at", "blob"])
    # The text depends on the unseen side's row, so no pattern is tried ahead of the join on
    # texts that need no scan.
    due = chosen.select("blob", F.when(F.col("n") > 0, F.col("text")).alias("text"))
    ledger.add(unseen.select("blob"), findings(due, rules), rule_version)
    back = paths.join(ledger.found(rule_version), "blob", "left")
    return back.select(*path_cols, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
