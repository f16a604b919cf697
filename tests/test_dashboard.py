from datetime import date

from pyspark.sql import functions as F

from tidemark.plans.dashboard import dashboard, write_dashboard

from .test_dedupe_graph import items
from .test_match_score import RULES


def test_dashboard_tables_are_written(spark, tmp_path):
    health = spark.createDataFrame([(date(2026, 7, 1), "arXiv", True, 1, True), (date(2026, 7, 4), "arXiv", False, 0, True)], "scan_date date, source string, ok boolean, item_count bigint, required boolean")
    counters = ("fetched", "deduplicated", "out_of_domain", "suppressed", "below_threshold", "published", "pinned")
    funnels = spark.createDataFrame([(date(2026, 7, 4),)], "scan_date date").withColumns({c: F.lit(2).cast("bigint") for c in counters})
    tables = dashboard(items(spark), health, funnels, RULES)
    write_dashboard({k: tables[k] for k in ("days", "totals", "funnel", "graph_nodes")}, str(tmp_path))
    days = {str(r["scan_date"]): (r["item_count"], r["sources_ok"], r["sources_total"]) for r in spark.read.parquet(f"{tmp_path}/days").collect()}
    assert days == {"2026-07-01": (1, 1, 1), "2026-07-02": (1, 0, 0), "2026-07-04": (2, 0, 1)}
    assert spark.read.parquet(f"{tmp_path}/totals").first()["items"] == 4
    assert spark.read.parquet(f"{tmp_path}/funnel").first()["published"] == 2
