"""Metrics of real runs, batch and stream, against a query of the same rows; broken pages in linear time."""

import json
import time

from pyspark.sql import functions as F

from quern.sources.html import read_page
from quern.streaming import observed


def requests(df):
    return df.select("user_id", (F.col("event_type") == "error").alias("failed"), (F.col("value") / 1000).alias("seconds"))


def test_batch_metrics_are_the_querys(spark, sf):
    events = requests(spark.read.parquet(f"{sf}/events.parquet"))
    passed, seen = observed.observed_requests(events)
    passed.write.format("noop").mode("overwrite").save()
    assert seen.get == observed.request_metrics(events).first().asDict() and seen.get["requests"] == events.count()
    empty, none = observed.observed_requests(events.limit(0))
    empty.collect()
    assert none.get == {"requests": 0, "errors": 0, "avg_latency_ms": 0.0}


def test_stream_lines_add_up_to_the_query(spark, sf, tmp_path):
    lines = []
    listener = observed.StreamLog(observed.JsonLog(lines.append))
    spark.streams.addListener(listener)
    rows = requests(spark.read.parquet(f"{sf}/events.parquet"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream, _ = observed.observed_requests(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    try:
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        until = time.monotonic() + 30
        while not any('"ended"' in x for x in list(lines)) and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    told = [json.loads(x) for x in lines]
    batches = [x["observed"]["requests"] for x in told if x["msg"] == "batch" and x["rows"]]
    want = observed.request_metrics(rows).first()
    assert len(batches) == 3 and sum(b["requests"] for b in batches) == want["requests"] and sum(b["errors"] for b in batches) == want["errors"]
    assert [x["msg"] for x in told][0] == "started" and told[-1]["level"] == "INFO" and all({"ts", "logger", "request_id"} <= set(x) for x in told)


def test_deep_pages_take_linear_time():
    began = time.process_time()
    for html in ("<div>x" * 60_000, "<b>x</i>" * 60_000, "<nav>" * 60_000 + "x", "<table><tr><td>x" * 20_000):
        read_page(html).text()
    assert time.process_time() - began < 20
    assert read_page("<div>" * 60_000 + "deep").text() == "deep"
    within = "<table><tr><td>a</td><td><nav><table><tr><td>menu</td></tr></table></nav>b</td></tr><tr><td>c</td><td>d</td></tr></table>after"
    assert read_page(f"<body>{within}</body>").text() == "| a | b |\n| --- | --- |\n| c | d |\nafter"
