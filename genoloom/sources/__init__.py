"""Readers: FASTA, VCF, region lists, and the variant view of the benchmark tables."""
