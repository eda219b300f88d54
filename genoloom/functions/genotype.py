"""Genotype strings: decoding, carriers, phasing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one or two allele numbers, '.' for missing, '|' phased or '/' unphased.
GENOTYPE = r"^([0-9]+|\.)(?:([|/])([0-9]+|\.))?$"


def decode_genotype(gt: Column) -> Column:
    """``struct(a, b, phase)``: allele numbers (null when missing or absent) and phasing."""
    first = F.regexp_extract(gt, GENOTYPE, 1)
    mark = F.regexp_extract(gt, GENOTYPE, 2)
    second = F.regexp_extract(gt, GENOTYPE, 3)
    return F.struct(
        first.try_cast("int").alias("a"),
        second.try_cast("int").alias("b"),
        (mark == "|").alias("phase"),
    )


def carried_alleles(gt: Column, ordinal: Column, allele_aware: bool = True) -> Column:
    """``struct(phase, gt1, gt2)`` of a genotype towards the ALT with this ordinal.

    Allele aware, a chromosome carries the ALT it names.  Otherwise any non-zero
    allele number counts for every ALT of the record, and only genotypes of one
    or three characters are read.
    """
    g = decode_genotype(gt)
    a, b, phase = g.getField("a"), g.getField("b"), g.getField("phase")
    if allele_aware:
        one, two = a == ordinal, b == ordinal
    else:
        readable = F.length(gt).isin(1, 3)
        one, two = readable & (a > 0), readable & (b > 0)
    return F.struct(
        phase.alias("phase"),
        F.coalesce(one, F.lit(False)).alias("gt1"),
        F.coalesce(two, F.lit(False)).alias("gt2"),
    )


def phasing(phase: Column, gt1: Column, gt2: Column) -> Column:
    """``0|1`` style text; a haploid call reads ``1/0``."""
    digit = lambda g: F.when(g.cast("int") == 1, "1").otherwise("0")
    return F.concat(digit(gt1), F.when(phase.cast("int") == 1, "|").otherwise("/"), digit(gt2))


def _alleles(gt: Column) -> Column:
    return F.split(gt, "[|/]")


def ploidy(gt: Column) -> Column:
    return F.size(_alleles(gt))


def is_hom(gt: Column) -> Column:
    """All allele numbers equal."""
    parts = _alleles(gt)
    return F.forall(parts, lambda p: p == F.element_at(parts, 1))


def is_het(gt: Column) -> Column:
    return ~is_hom(gt)


def is_missing(gt: Column) -> Column:
    """Some allele number is missing."""
    return F.exists(_alleles(gt), lambda p: p == ".")


def is_hom_ref(gt: Column) -> Column:
    """All allele numbers 0."""
    return F.forall(_alleles(gt), lambda p: p == "0")


def is_hom_non_ref(gt: Column) -> Column:
    """All allele numbers equal and neither 0 nor missing."""
    return is_hom(gt) & ~is_hom_ref(gt) & ~is_missing(gt)


def has_non_ref(gt: Column) -> Column:
    """Some allele number other than 0; a missing one counts for nothing."""
    return F.exists(_alleles(gt), lambda p: (p != "0") & (p != "."))
