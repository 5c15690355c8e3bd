"""The event graph on a stream equals the batch form, over batches and restarts, while titles of past spans go."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ferrule.operators import graph
from ferrule.streaming import events

NOW = datetime(2026, 7, 12, 16)
TITLES = ["Acme wins big order", "Acme wins big order today", "Correction: Acme wins big order", "Other news of 10 ships", "Other news of 12 ships"]
SCHEMA = "issuer string, source_id string, record_id string, tier string, url string, title string, published_at timestamp_ntz, arrival long"


def observed(spark, count, hours):
    rows = [("XXY"[i % 3], f"s{i}", "1", "discovery", f"https://e{i % 17}.org/", TITLES[i * 7 % 5], NOW + timedelta(hours=i * hours - (i % 4) * 9), i) for i in range(count)]
    return graph.observations(spark.createDataFrame(rows, SCHEMA))


def land(seen, tmp_path, parts, of):
    for part in parts:
        seen.where(F.floor(F.col("arrival") / of) == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part:02}"))


def run(spark, seen, tmp_path, lateness):
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = events.graph_stream(stream, lateness).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query = out.outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return {r.arrival: tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_batches_and_a_restart_equal_the_batch_form(spark, tmp_path):
    seen = observed(spark, 40, 11)
    want = {r.arrival: tuple(r) for r in graph.near_events(seen).collect()}
    land(seen, tmp_path, (0, 1), 10)
    found = run(spark, seen, tmp_path, "3 days")
    assert found == {k: v for k, v in want.items() if k < 20}
    land(seen, tmp_path, (2, 3), 10)
    assert run(spark, seen, tmp_path, "3 days") == want
    state = spark.read.format("statestore").option("stateVarName", "sizes").load(str(tmp_path / "c"))
    spans = {r[0] for r in state.selectExpr("key.issuer as issuer", "user_map_key.span as span").select("span").collect()}
    first, last = (graph.span_of(t) for t in (NOW, NOW + timedelta(hours=39 * 11)))
    assert spans and min(spans) > first and max(spans) <= last
    keys = spark.read.format("statestore").option("stateVarName", "keys").load(str(tmp_path / "c"))
    assert keys.count() == len({(v[0], v[2]) for v in want.values()})
