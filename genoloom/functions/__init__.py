"""Column expressions: bases, alleles, genotypes."""

from .alleles import (
    classify, edit_key, first_base, is_plain_alt, last_base, mutation_name, same_contig,
    shares_prefix, trimmed,
)
from .bases import base_char, base_code
from .genotype import (
    carried_alleles, decode_genotype, has_non_ref, is_het, is_hom, is_hom_non_ref, is_hom_ref, is_missing, phasing, ploidy,
)

__all__ = [
    "base_char", "base_code", "carried_alleles", "classify", "decode_genotype", "edit_key",
    "first_base", "has_non_ref", "is_het", "is_hom", "is_hom_non_ref", "is_hom_ref", "is_missing", "is_plain_alt", "last_base",
    "mutation_name", "phasing", "ploidy", "same_contig", "shares_prefix", "trimmed",
]
