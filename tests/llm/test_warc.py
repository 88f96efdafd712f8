"""Round trips through archives."""
import gzip

from pyspark.sql import functions as F

from sparkgauge.llm import warc
from sparkgauge.llm.common import scratch

PAGES = [(1, "http://a/1", "<p>one</p>", 0), (2, "http://a/2", "<p>one</p>", 0), (3, "http://b/\r\nx", None, 0), (4, None, "", 0), (5, "http://c", "é" * 300_000, 0),
         (5, "http://c", "é" * 300_000, 0), (None, "http://d", "<p>one</p>", 0), (7, "http://e", "<html>\r\n\r\nblank\r\n\r\n</html>", 0), (8, "http://f", "<p>one</p>", 0)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, same int").repartition(3)
    path = scratch(spark, "warc-test")
    warc.write_pages(pages, path)
    got = warc.read_archives(spark, path, verify=True).collect()
    assert len(got) == len(PAGES)
    for i, html in ((r[0], r[2]) for r in PAGES):
        mine = [r for r in got if r["record_id"] == f"urn:page:{'none' if i is None else i}"]
        want = (html or "").encode()
        for r in mine:
            assert r["payload_bytes"] == len(want) and r["payload_digest"] == warc.sha1_base32(want)
            assert r["record_type"] == "revisit" or bytes(r["payload"]) == want
    kinds = {(r["record_id"], r["record_type"], r["refers_to"]) for r in got}
    assert ("urn:page:1", "revisit", "urn:page:8") in kinds and ("urn:page:8", "response", None) in kinds
    assert ("urn:page:3", "revisit", "urn:page:4") in kinds and ("urn:page:none", "response", None) in kinds
    assert sum(r["record_type"] == "response" and r["record_id"] == "urn:page:5" for r in got) == 2


def test_predicates_reach_the_reader(spark):
    path = scratch(spark, "warc-test")
    warc.write_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string, same int"), path)
    records = warc.read_archives(spark, path, payload=False)
    some = records.filter((F.col("record_type") == "revisit") & F.col("refers_to").isin("urn:page:8"))
    assert sorted(r["record_id"] for r in some.collect()) == ["urn:page:1", "urn:page:2"]
    reader = warc.WarcReader(records.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("x",)), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"response"}, "target_uri": {"x"}}


def test_plain_gzip_members_without_sizes(spark, tmp_path):
    records = [warc.record(f"urn:page:{i}", "response", "http://x", None, b"z" * n, "1970-01-01T00:00:00Z") for i, n in enumerate((0, 5, 50_000))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read_archives(spark, str(tmp_path), verify=True).collect()
    assert sorted(len(r["payload"]) for r in got) == [0, 5, 50_000]
    assert warc.read_archives(spark, str(tmp_path), payload=False).count() == 3


def test_files_roll_and_empty_table(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, same int").coalesce(1)
    path = scratch(spark, "warc-test")
    rows = pages.select(F.concat(F.lit("urn:page:"), F.col("page_id")).alias("record_id"), F.lit("response").alias("record_type"),
                        F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("refers_to"), F.col("html").cast("binary").alias("payload"))
    spark.dataSource.register(warc.WarcSource)
    rows.write.format("warc").option("file_bytes", "100").mode("append").save(path)
    frame = warc.read_archives(spark, path)
    assert frame.rdd.getNumPartitions() > 3 and frame.count() == len(PAGES)
    path = scratch(spark, "warc-test")
    warc.write_pages(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0
