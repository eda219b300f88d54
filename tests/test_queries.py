"""Every registered query against its SQL, and the command line end to end."""

import pytest
from compare import compare, connect
from conftest import TOY_PATH, TOY_RECORDS, TOY_REF, fasta_text, vcf_text

import __spark_entry__ as entry
from genoloom import cli

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.core_queries()))
def test_query_matches_sql(spark, duck, name):
    ok, text = compare(spark, duck, SF, name, entry.core_queries()[name], entry.core_sql()[name])
    assert ok, text


def test_every_query_has_sql():
    assert set(entry.core_queries()) == set(entry.core_sql())


def test_a_missing_dependency_of_an_optional_module_costs_its_queries_only(tmp_path, monkeypatch):
    (tmp_path / "needs_more.py").write_text("import surely_not_installed\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(entry, "_OPTIONAL", ("needs_more", "genoloom.not_there"))
    with pytest.warns(UserWarning, match="surely_not_installed"):
        assert entry.queries() == entry.core_queries()
    with pytest.warns(UserWarning, match="needs_more"):
        assert entry.oracle_sql() == entry.core_sql()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["region_id", "pos", "kind", "ref", "alt", "part", "n_samples", "samples"]
    assert df.count() > 0


def read(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF))
    (tmp_path / "x.vcf").write_text(vcf_text(TOY_RECORDS))
    store, out = str(tmp_path / "ser"), tmp_path / "o"

    def run(*args):
        assert cli.main(list(args), spark=spark, width=16) == 0
        return capsys.readouterr().out

    assert "alleles left out: 0" in run("construct", "-r", str(tmp_path / "x.fa"), "-v", str(tmp_path / "x.vcf"), "-p", store)
    run("query", "-p", store, "-t", "variants-ref", "-r", "25:27", "-o", str(out / "v"))
    assert [t for t in read(out / "v") if not t.startswith("region_id")] == ["0\t25\t\tT\t1(0|1) \t0", "0\t26\t\tA\t1(0|1) \t0"]
    run("query", "-p", store, "-t", "sequence-sample", "-r", "1:83", "-s", "1", "-m", "1", "-o", str(out / "s"))
    assert read(out / "s") == ["0\t" + TOY_PATH]
    run("query", "-p", store, "-t", "samples", "-r", "39:0,10", "-b", "T,C", "-a", ",T", "-o", str(out / "n"))
    assert read(out / "n") == ["0\t1 0|1", "1\t1 1|0"]
    assert "26" in run("query", "-p", store, "-t", "closest", "-r", "30")
    run("query", "-p", store, "-t", "variants-sample-ref", "-r", "38:42", "-s", "1", "-o", str(out / "w"))
    assert len(read(out / "w")) == 3
    shown = run("query", "-p", store, "-t", "variants-sample-sample", "-r", "28:31,2:3", "-s", "1")
    assert "region 0: 0 variants" in shown and "region 1: 2 variants" in shown and "1\t25\t28\t\tT\t0\t1(0|1)" in shown
    with pytest.raises(SystemExit):
        run("query", "-p", store, "-t", "sequence-ref", "-r", "1:5")
    with pytest.raises(SystemExit):
        run("query", "-p", store, "-t", "variants-ref", "-r", "5")
    with pytest.raises(ValueError):
        run("query", "-p", store, "-t", "sequence-ref", "-r", "1:5", "-s", "nobody")
    run("draw", "-p", store, "-r", "10", "-n", "3")
    drawn = read(tmp_path / "ser" / "graph.dot")
    assert drawn[0] == "digraph {" and drawn[-1] == "}"


def test_command_line_updates_and_prints_whole_paths(spark, tmp_path, capsys):
    (tmp_path / "x.fa").write_text(fasta_text(TOY_REF))
    (tmp_path / "a.vcf").write_text(vcf_text(TOY_RECORDS[:3], ["p"]))
    (tmp_path / "b.vcf").write_text(vcf_text(TOY_RECORDS[3:], ["p"]))
    store, out = str(tmp_path / "ser"), tmp_path / "o"

    def run(*args):
        assert cli.main(list(args), spark=spark, width=16) == 0
        return capsys.readouterr().out

    run("construct", "-r", str(tmp_path / "x.fa"), "-v", str(tmp_path / "a.vcf"), "-p", store)
    assert "version 2 -> 3" in run("update", "-v", str(tmp_path / "b.vcf"), "-p", store)
    run("query", "-p", store, "-t", "sample-path", "-s", "p", "-o", str(out))
    assert "".join(read(out)) == TOY_PATH
    shown = run("query", "-p", store, "-t", "sample-path", "-s", "p")
    assert "".join(line.partition("\t")[2] for line in shown.splitlines() if "\t" in line) == TOY_PATH
    with pytest.raises(SystemExit, match="sample name"):
        run("query", "-p", store, "-t", "sample-path")
    with pytest.raises(SystemExit, match="regions"):
        run("query", "-p", store, "-t", "variants-ref")
