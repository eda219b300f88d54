"""Allele typing, trimming and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: only alleles spelled with these letters take part.
PLAIN_ALT = "^[ACTG]+$"


def same_contig(name: Column, chrom: Column) -> Column:
    """Equal names, or equal once a three-letter prefix such as ``chr`` is dropped."""
    return (name == chrom) | (F.substring(name, 4, 1 << 30) == chrom)


def is_plain_alt(alt: Column) -> Column:
    return alt.rlike(PLAIN_ALT)


def classify(ref: Column, alt: Column) -> Column:
    """SUB for equal lengths, DEL when REF is the longer one, INS otherwise."""
    n, m = F.length(ref), F.length(alt)
    return F.when(n == m, "SUB").when(n > m, "DEL").otherwise("INS")


def mutation_name(kind: Column) -> Column:
    """Long name of a kind; a complex replacement is a substitution of unequal lengths."""
    # Fixed values.
    return (
        F.when(kind == "INS", "INSERTION").when(kind == "DEL", "DELETION")
        .otherwise("SUBSTITUTION")
    )


def shares_prefix(ref: Column, alt: Column) -> Column:
    """Whether the shorter allele is a prefix of the longer one."""
    n, m = F.length(ref), F.length(alt)
    return F.when(n < m, F.startswith(alt, ref)).otherwise(F.startswith(ref, alt))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """Canonical ``struct(pos, kind, ref, alt, delta)`` of a raw VCF allele.

    An insertion keeps the bases after REF and is placed on the last REF base, a
    deletion keeps the bases after ALT and is placed on the first lost base.  When
    the shorter allele is no prefix of the longer one both are kept whole as CPX.
    Alleles that arrive trimmed (an empty side) pass through.
    """
    n, m = F.length(ref), F.length(alt)
    raw = classify(ref, alt)
    kind = F.when((n != m) & ~shares_prefix(ref, alt), "CPX").otherwise(raw)
    already = (n == 0) | (m == 0)
    new_pos = (
        F.when((kind == "INS") & ~already, pos + n - 1)
        .when((kind == "DEL") & ~already, pos + m)
        .otherwise(pos)
    )
    new_ref = F.when(kind == "INS", "").when(
        kind == "DEL", F.substring(ref, m + 1, n)).otherwise(ref)
    new_alt = F.when(kind == "DEL", "").when(
        kind == "INS", F.substring(alt, n + 1, m)).otherwise(alt)
    return F.struct(
        new_pos.cast("long").alias("pos"), kind.alias("kind"), new_ref.alias("ref"),
        new_alt.alias("alt"), (m - n).cast("long").alias("delta"),
    )


def first_base(kind: Column, pos: Column) -> Column:
    """First reference base a site touches; for an insertion the base it precedes."""
    return F.when(kind == "INS", pos + 1).otherwise(pos)


def last_base(kind: Column, pos: Column, ref: Column) -> Column:
    """Last reference base a site touches; an insertion ends where it began."""
    return F.when(kind == "INS", pos).otherwise(pos + F.length(ref) - 1)


def edit_key(kind: Column, pos: Column) -> Column:
    """Place of a site in path order: by first base, an insertion ahead of the rest."""
    return first_base(kind, pos) * 2 + F.when(kind == "INS", 0).otherwise(1)
