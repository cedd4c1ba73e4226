import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import state
from quern.streaming import serving

T0 = dt.datetime(2024, 1, 1)


def log(spark, times, key="k"):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=t), key) for i, t in enumerate(times)], "event_id long, ts timestamp_ntz, user_id string")


TIMES = [0, 10, 20, 60, 60.5, 71]


def test_sliding(spark):
    got = state.rate_limit_sliding(log(spark, TIMES), limit=2).orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True]


def test_fixed(spark):
    got = state.rate_limit_fixed(log(spark, TIMES), limit=2).orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True, False]


def test_cache(spark):
    got = state.cache_hits(log(spark, [0, 900, 900.1]), "user_id", ttl_s=900).orderBy("event_id").collect()
    assert [r["hit"] for r in got] == [False, True, False]
    assert tuple(state.cache_stats(log(spark, []).selectExpr("true as hit")).first()) == (0, 0, 0.0)


def test_sessions_end_after_more_than_the_limit(spark):
    got = state.sessions(log(spark, [0, 3600, 7200.5])).orderBy("event_id").collect()
    assert [r["session_no"] for r in got] == [1, 1, 2]


def test_history(spark):
    df = spark.createDataFrame([(1, i, "user", str(i)) for i in range(1, 15)], "conv_id int, turn int, role string, text string")
    assert [(r["turn"], r["position"]) for r in state.last_messages(df).orderBy("turn").collect()] == [(t, t - 9) for t in range(9, 15)]


def test_denied_by_the_inner_limiter_uses_the_outer_one(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), "ip", "a" if i < 2 else "b") for i in range(4)], "event_id long, ts timestamp_ntz, ip string, session string")
    got = state.guard_chain(df, "ip", "session", outer_limit=3, inner_limit=1).orderBy("event_id").collect()
    assert [r["verdict"] for r in got] == [200, 429, 200, 429]


@pytest.mark.parametrize("seed", [1, 2])
def test_never_more_than_the_limit_in_a_window(spark, seed):
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, 600) for _ in range(200))
    admitted = [times[r["event_id"]] for r in state.rate_limit_sliding(log(spark, times), limit=5).where("allowed").collect()]
    assert all(sum(t <= x <= t + 60 for x in admitted) <= 5 for t in admitted)


def test_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((round(rng.uniform(0, 300), 3), rng.choice("ab")) for _ in range(80))
    data = [(k, i, float(t)) for i, (t, k) in enumerate(rows)]
    for n in range(2):
        spark.createDataFrame(data[n * 40 : n * 40 + 40], "key string, id long, t double").coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    source = spark.readStream.schema("key string, id long, t double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = serving.stream_limiter(source, "key", limit=3, window_s=60, forever=False)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["id"]: r["allowed"] for r in spark.table("limited").collect()}
    want = {}
    for key in "ab":
        machine = state.SlidingLimiter(3, 60)
        want |= {i: machine.allow(t) for k, i, t in data if k == key}
    assert got == want


def test_questions_are_served_by_the_batch_operators(spark, tmp_path):
    spark.createDataFrame([(1, "hi"), (2, "how long is the second course of study")], "id long, question string").write.parquet(f"{tmp_path}/q")
    source = spark.readStream.schema("id long, question string").parquet(f"{tmp_path}/q")
    seen = []
    q = serving.serve(source, lambda routed: routed.select("id", "route"), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/c")
    assert q.awaitTermination(120)
    assert sorted((r["id"], r["route"]) for r in seen) == [(1, "greeting"), (2, "retrieve")]


def test_stream_history(spark, tmp_path):
    rows = [("s", float(t), "user", str(i)) for i, t in enumerate([0, 1, 2, 5000])]
    spark.createDataFrame(rows, "session string, t double, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/m")
    source = spark.readStream.schema("session string, t double, role string, text string").parquet(f"{tmp_path}/m")
    q = serving.stream_history(source, turns=2, forever=False).writeStream.format("memory").queryName("hist").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r["recent"] for r in spark.table("hist").orderBy("t").collect()] == ["user: 0", "user: 0\nuser: 1", "user: 1\nuser: 2", "user: 3"]


@pytest.mark.parametrize("make", [lambda: state.SlidingLimiter(3, 60), lambda: state.FixedLimiter(3, 60), lambda: state.TtlCache(60)])
def test_stretches_change_nothing(spark, make):
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([0.5, 1, 20, 59.999999, 60, 60.000001, 61, 119, 120, 121, 4000])
        rows.append((i, T0 + dt.timedelta(microseconds=round(t * 1e6)), rng.choice(["a", "a", "b", None])))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, k string")
    got = {r["event_id"]: r["allowed"] for r in state.limited(df, "k", "ts", "event_id", make, 60).collect()}
    want, machines = {}, {}
    for i, ts, k in rows:
        want[i] = machines.setdefault(k or "", make()).allow((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(seconds=1))
    assert got == want
    times = df.select(F.coalesce("k", F.lit("")).alias("_key"), state.seconds(F.col("ts")).alias("_t"))
    assert state.stretches(times, 60).select("_key", "_part").distinct().count() > 40


def test_requests_without_a_time_or_any_at_all(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, None, "k"), (3, T0, "k")], "event_id long, ts timestamp_ntz, user_id string")
    got = {r["event_id"]: r["allowed"] for r in state.rate_limit_sliding(df, limit=1).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert state.rate_limit_sliding(df.limit(0)).count() == 0


def test_reads_that_do_not_renew(spark):
    df = log(spark, [0, 3000, 4000, 4100, 8000]).withColumn("read", F.col("event_id").isin(1, 2))
    number = lambda **kw: [r["session_no"] for r in state.sessions(df, **kw).orderBy("event_id").collect()]
    assert number() == [1, 1, 1, 1, 2]
    assert number(renews=~F.col("read")) == [1, 1, None, 2, 3]
