"""Queries of documents read their whole texts."""

from pyspark.sql import functions as F

from ferrule.operators import documents
from ferrule.plans import text_queries


def test_filings_hold_the_whole_text(spark):
    rows = [(6, "x " * 400 + "We repurchased 5 shares. " + "y " * 400)]
    filings = documents.sample_filings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert filings.first().text == f"{rows[0][1]} {documents.PHRASES[6]}"
    assert documents.classify(filings).first().rule_id == "share_repurchase_activity"


def test_titles_that_part_late_are_two_events(spark, tmp_path):
    start, a, b = "word " * 20, "alpha " * 30, "omega " * 30
    rows = [(i, f"{start}{x}\nrest", "en", "s") for i, x in enumerate((a, b))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = text_queries.fuzzy_event_graph(spark, str(tmp_path)).select("event_id", F.col("exact")).collect()
    assert {r.event_id for r in found} == {0, 1}
