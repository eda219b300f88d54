"""Column layout of the stored relations."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SAMPLE = _struct(("sample_id", _L), ("name", _S))
CONTIG = _struct(("chrom", _S), ("length", _L))
REF_CHUNK = _struct(("chrom", _S), ("cell", _L), ("start", _L), ("bases", _S))

# pos: first replaced base (SUB, CPX), first deleted base (DEL), or the base
# before the insertion (INS).  The site touches reference bases lo..hi; an
# insertion touches none and has lo = pos + 1, hi = pos.
SITE = _struct(
    ("chrom", _S), ("site_id", _L), ("pos", _L), ("kind", _S), ("ref", _S), ("alt", _S),
    ("delta", _L), ("lo", _L), ("hi", _L), ("edit_key", _L),
)
CARRIER = _struct(
    ("chrom", _S), ("site_id", _L), ("pos", _L), ("edit_key", _L), ("sample_id", _L),
    ("phase", _B), ("gt1", _B), ("gt2", _B),
)
COORD = _struct(
    ("chrom", _S), ("sample_id", _L), ("site_id", _L), ("pos", _L), ("kind", _S), ("ref", _S),
    ("alt", _S), ("delta", _L), ("lo", _L), ("hi", _L), ("edit_key", _L),
    ("on_path", _B), ("shift", _L), ("sample_pos", _L),
)
SEGMENT = _struct(
    ("chrom", _S), ("seg_id", _L), ("kind", _S), ("ref_start", _L), ("ref_end", _L),
    ("length", _L), ("seq", _S), ("site_id", _L),
)
EDGE = _struct(("chrom", _S), ("src", _L), ("dst", _L))

RELATIONS = {
    "sample": SAMPLE, "contig": CONTIG, "ref_chunk": REF_CHUNK, "site": SITE,
    "carrier": CARRIER, "coord": COORD, "segment": SEGMENT, "edge": EDGE,
}

REGION = _struct(("region_id", _L), ("chrom", _S), ("x", _L), ("y", _L))
