import pytest
from compare import connect, differences

from siteloom.plans import catalog, pipeline


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    assert differences(catalog.queries()[name](spark, data), connect(data), catalog.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0


def test_pipeline(spark, data, tmp_path):
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    sites = read("sites")
    asked = sites.selectExpr("site", "site AS qid", "'what are the hours?' AS query")
    out = pipeline.run(read("crawl_archive"), sites, asked)
    meta = out["run_meta"].collect()
    assert len(meta) == sites.count() and out["nap_report"].count() == 7 * len(meta) and out["answer"].count() == len(meta)
    written = pipeline.write_site(out, meta[0].site, str(tmp_path))
    assert set(written) == {"audit", "nap_report", "answer", "run_meta"}


def test_stream(spark, data, tmp_path):
    from siteloom.operators import audit
    from siteloom.streaming.incremental import stream_findings

    table = spark.read.parquet(f"{data}/crawl_archive.parquet")
    (tmp_path / "in").mkdir()
    table.write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in" / "*"))
    query = stream_findings(stream).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    batch = audit.page_findings(audit.audited(table)).filter("metric NOT IN ('http_error_status', 'fetch_error')")
    assert spark.table("found").groupBy("metric").count().orderBy("metric").collect() == batch.groupBy("metric").count().orderBy("metric").collect()
