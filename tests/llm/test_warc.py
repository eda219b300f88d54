"""The archive writer: records, revisits, files that are the same each time."""

import gzip
import hashlib

from pyspark.sql import functions as F

from genoloom.llm.warc import Settings, _shard, read, record_plan, write

SCHEMA = "page_id long, url string, html string"


def expected(rows, least=1000):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and page is not None:
            first[raw] = max(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(raw)
        to = None if to == page or page is None else to
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip_and_same_bytes(spark, tmp_path):
    big, other = "é" * 600, "x" * 1500
    rows = [(i, f"http://h/{i} a", [big, other, "small", None, "", f"{i}" * 900][i % 6]) for i in range(200)]
    rows += [(500, None, big), (500, "u", big), (501, "u\nX: y", "z" * 400_000), (7, "again", other), (7, "again", other)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS shard")
    s = Settings(shard_bytes=50_000, file_bytes=2_000)
    sums = []
    for k in range(2):
        folder = str(tmp_path / f"w{k}")
        files = write(pages.repartition(3 + 4 * k), folder, s)
        got = read(files, folder).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
        assert {r.payload.decode() for r in got if r.page_id == 501} == {"z" * 400_000}
        listed = sorted(tuple(f) for f in files.collect())
        assert sum(f[2] for f in listed) == len(rows) and len(listed) > 5
        for name, size, _, sha in listed:
            raw = (tmp_path / f"w{k}" / name).read_bytes()
            assert len(raw) == size and hashlib.sha1(raw).hexdigest() == sha and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        assert not [p for p in (tmp_path / f"w{k}").iterdir() if ".warc.gz." in p.name]
        sums.append(listed)
    assert sums[0] == sums[1]


def test_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(None, None, None), (None, "u", "y" * 2000), (3, "v", "y" * 2000)]
    folder = str(tmp_path / "w")
    got = read(write(spark.createDataFrame(rows, SCHEMA), folder), folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type) for r in got), key=str) == sorted(
        [(None, 0, "response"), (None, 2000, "response"), (3, 2000, "response")], key=str)
    empty = str(tmp_path / "e")
    assert read(write(spark.createDataFrame([], SCHEMA), empty), empty).collect() == []
    assert record_plan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_third_null_ids_spread_over_ranges_and_a_second_attempt(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"u{i}", f"{i} " * 300) for i in range(600)]
    pages = spark.createDataFrame(rows, SCHEMA)
    s = Settings(shard_bytes=20_000, file_bytes=5_000)
    plan = record_plan(pages, s)
    shard, n = _shard(plan, s)
    sizes = plan.withColumn("shard", shard).groupBy("shard").sum("size").collect()
    assert len(sizes) > 20 and max(r.shard for r in sizes) < n and max(r[1] for r in sizes) < 60_000
    folder = str(tmp_path / "w")
    first = sorted(tuple(f) for f in write(pages, folder, s).collect())
    again = sorted(tuple(f) for f in write(pages, folder, s).collect())  # files and manifests are there
    assert first == again
    got = read(write(pages, folder, s), folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)


def test_one_range_is_one_task(spark):
    df = spark.range(64).withColumn("k", F.col("id").cast("int") % 16).repartitionById(16, "k")
    assert df.select("k", F.spark_partition_id().alias("p")).where("k <> p").count() == 0
