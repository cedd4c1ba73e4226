"""Sessions as a stream against the same as a table, with late and repeated messages; requests good and bad."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import sessions


def test_stream_of_conversations_is_the_table(spark, sf, tmp_path):
    """The given conversations, a minute a turn, in five files with repeats and with turns that come two files late."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id < 40").collect()
    rng = random.Random(1)
    files = [[] for _ in range(7)]
    for r in rows:
        message = (str(r["conv_id"]), 1_700_000_000 + 60 * r["turn"], r["role"], r["text"])
        at = min(4, r["turn"] // 2)
        files[at + (2 if rng.random() < 0.1 else 0)].append(message)
        if rng.random() < 0.1:
            files[min(6, at + 1)].append(message)
    schema = "session string, s long, role string, text string"
    table = spark.createDataFrame([m for f in files for m in f], schema).withColumn("t", F.timestamp_seconds("s")).drop("s")
    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).withColumn("t", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema("session string, role string, text string, t timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = "histories_" + tmp_path.name.replace("-", "_")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = sessions.session_histories(stream, late="2 hours").writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = spark.table(name).where("NOT ended")
    final = {}
    for r in out.collect():  # the last row of a session has the most of it
        if r["session"] not in final or (r["at"], r["messages"], r["recent"]) >= final[r["session"]]:
            final[r["session"]] = (r["at"], r["messages"], r["recent"])
    want = {r["session"]: (r["at"], r["messages"], r["recent"]) for r in sessions.recent_messages(table).collect()}
    assert set(final) == set(want) and {s: v[:2] for s, v in final.items()} == {s: v[:2] for s, v in want.items()}
    seen = {(r["session"], r["recent"]) for r in out.collect()}
    assert all((s, v[2]) in seen for s, v in want.items())


def test_an_idle_session_begins_anew(spark):
    rows = [("a", 0, "user", "one"), ("a", 10, "assistant", "two"), ("a", 5_000, "user", "three"), ("b", 0, "user", "x"), ("b", 3_600, "user", "y")]
    table = spark.createDataFrame(rows, "session string, s long, role string, text string").withColumn("t", F.timestamp_seconds("s"))
    got = {r["session"]: (r["messages"], r["recent"]) for r in sessions.recent_messages(table).collect()}
    assert got == {"a": (1, "user: three"), "b": (2, "user: x\nuser: y")}


@pytest.mark.parametrize(
    "body, status, question",
    [
        (json.dumps({"question": "What?", "session_id": "s"}), None, "What?"), (json.dumps({"question": "Што?"}), None, "Што?"), (json.dumps({"question": "a", "more": [1]}), None, "a"),
        ("{", 422, None), ("", 422, None), (None, 422, None), ("[]", 422, None), (json.dumps({"session_id": "s"}), 422, None), (json.dumps({"question": ""}), 422, None), (json.dumps({"question": "q" * 2001}), 422, None),
        (json.dumps({"question": "q", "session_id": "s" * 65}), 422, None), (json.dumps({"question": "q", "pad": "x" * 70_000}), 413, None),
    ],
)
def test_requests(spark, body, status, question):
    r = sessions.parsed_requests(spark.createDataFrame([(body, 1)], "value string, id int")).first()
    assert (r["rejected"], r["question"], r["id"]) == (status, question, 1)
