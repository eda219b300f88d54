import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from genoloom.session import get_session  # noqa: E402

# The toy contig and records, with the answers worked out by hand.
TOY_REF = "CAAATAAGGCTTGGAAATTTTCTGGAGTTCTATTATATTCCAACTCTCTGGTTCCTGGTGCTATGTGTAACTAGTAATGG"
TOY_RECORDS = [
    (9, "G", "A", "1|0"), (10, "C", "T", "1|0"), (10, "C", "A", "1|0"), (10, "C", "CAAA", "1|0"),
    (25, "G", "GT", "0|1"), (26, "A", "AA", "0|1"), (38, "TT", "T", "0|1"), (40, "CC", "C", "0|1"),
    (54, "CC", "C", "1|1"),
]
TOY_PATH = "CAAATAAGATAAATTGGAAATTTTCTGGTAAGTTCTATTATATCAACTCTCTGGTTCTGGTGCTATGTGTAACTAGTAATGG"


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def vcf_text(records, samples=("1",), chrom="x"):
    head = ["##fileformat=VCFv4.1", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
            "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    body = ["\t".join([chrom, str(pos), ".", ref, alt, "99", ".", "NS=1", "GT", *gts])
            for pos, ref, alt, *gts in records]
    return "\n".join(head + body) + "\n"


def fasta_text(seq, name="x", line=23):
    rows = [seq[i:i + line] for i in range(0, len(seq), line)]
    return f">{name} toy contig\n" + "\n".join(rows) + "\n"


@pytest.fixture(scope="session")
def toy(spark, tmp_path_factory):
    from genoloom.plans.cohort import Cohort

    base = tmp_path_factory.mktemp("toy")
    (base / "x.fa").write_text(fasta_text(TOY_REF))
    (base / "x.vcf").write_text(vcf_text(TOY_RECORDS))
    # Cells of 16 bases, so that the 80 bases span five of them.
    return Cohort.from_files(spark, str(base / "x.fa"), str(base / "x.vcf"), str(base / "out"), width=16)
