"""Incremental runs: batches add up, and a re-run changes nothing."""

from pyspark.sql import functions as F

from filingmill import schemas
from filingmill.plans import flows
from filingmill.streaming import incremental


def land_items(spark, folder, items):
    fields = [f.split(" ", 1) for f in schemas.DISCOVERED_ITEMS.split(", ")]
    rows = spark.createDataFrame(items, "arrival bigint, original_url string, title string")
    rows = rows.withColumns({"company_id": F.lit("c"), "source_type": F.lit("news")})
    rows.select(
        *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    ).coalesce(1).write.mode("append").parquet(folder)


def run_items(spark, base):
    incremental.stream_items(spark, f"{base}/in", f"{base}/out", f"{base}/cp").awaitTermination()
    return sorted(r.arrival for r in spark.read.parquet(f"{base}/out").collect())


def test_items(spark, tmp_path):
    base = str(tmp_path)
    land_items(spark, f"{base}/in", [(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2")])
    assert run_items(spark, base) == [1, 3]
    assert run_items(spark, base) == [1, 3]
    land_items(spark, f"{base}/in", [(1, "u1", "t1"), (4, "u9", " T1"), (5, "u5", "t5")])
    assert run_items(spark, base) == [1, 3, 5]


def test_items_with_a_new_progress_folder(spark, tmp_path):
    base = str(tmp_path)
    land_items(spark, f"{base}/in", [(1, "u1", "t1"), (2, "u2", "t2")])
    assert run_items(spark, base) == [1, 2]
    land_items(spark, f"{base}/in", [(3, "u2", "t9"), (4, "u4", "t4")])
    incremental.stream_items(spark, f"{base}/in", f"{base}/out", f"{base}/other").awaitTermination()
    rows = spark.read.parquet(f"{base}/out").collect()
    assert sorted(r.arrival for r in rows) == [1, 2, 4]
    land_items(spark, f"{base}/in", [(5, "u5", "t5"), (6, "u4", "t7")])
    assert run_items(spark, base) == [1, 2, 4, 5]


def land_metrics(spark, folder, values):
    fields = [f.split(" ", 1) for f in schemas.INCOMING_METRICS.split(", ")]
    rows = spark.createDataFrame(values, "arrival bigint, metric_name string, metric_value double")
    rows = rows.withColumns(
        {
            "company_id": F.lit("c"), "entity_name": F.lit("E"), "reporting_period": F.lit("FY24"),
            "accounting_basis": F.lit("STANDALONE"), "source_name": F.lit("s"), "source_tier": F.lit(1),
        }
    )
    rows.select(
        *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    ).coalesce(1).write.mode("append").parquet(folder)


def test_metrics(spark, tmp_path):
    base = str(tmp_path)

    def run():
        incremental.stream_metrics(spark, f"{base}/in", f"{base}/store", f"{base}/cp").awaitTermination()
        rows = incremental.current_metrics(spark, f"{base}/store").collect()
        return {r.metric_name: (r.metric_value, r.data_quality_status) for r in rows}

    land_metrics(spark, f"{base}/in", [(1, "pat", 10.0), (2, "pat", 10.0), (3, "nonsense", 1.0)])
    assert run() == {"pat": (10.0, "UNVERIFIED")}
    land_metrics(spark, f"{base}/in", [(4, "pat", 12.0), (5, "capex", 1.0)])
    want = {"pat": (10.0, "CONFLICTING"), "capex": (1.0, "UNVERIFIED")}
    assert run() == want
    assert run() == want
    log = spark.read.parquet(f"{base}/store/data_quality").collect()
    assert [(r.value_a, r.value_b) for r in log] == [(10.0, 12.0)]


def test_discover_flow(spark):
    schema = "company_id string, http_status int, payload string"
    news = spark.createDataFrame(
        [("c", 200, "<item><title>Profit up</title><link>u1</link></item><item><title>Dull</title><link>u2</link></item>")], schema
    )
    filings = spark.createDataFrame([("c", 200, '{"Table":[{"NEWSID":"1","NEWSSUB":"Dividend"},{"NEWSID":"1","NEWSSUB":"DIVIDEND "}]}')], schema)
    when = F.lit("2025-01-01").cast("timestamp")
    items = flows.discover(filings.withColumn("fetched_at", when), news.withColumn("fetched_at", when))
    kept = flows.keep_new(items)
    assert [(r.title, r.source_type) for r in kept.orderBy("arrival").collect()] == [("Profit up", "news"), ("Dividend", "filing")]
    assert flows.news_rows(kept).collect()[0].category == "General"
    assert flows.document_rows(kept).collect()[0].source_tier == 2
    stored = spark.createDataFrame([("c", "u1", "x")], "company_id string, source_url string, headline string")
    assert flows.keep_new(items, news=stored).where("source_type = 'news'").count() == 0
