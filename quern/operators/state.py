"""Keyed state over logs: limiters, caches, sessions and metrics, as batch replays in event order.

The streaming versions (streaming.serving) run the same small state machines.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS


class SlidingLimiter:
    """At most ``limit`` admitted requests in any window; denied ones don't count."""

    def __init__(self, limit: int, window_s: float, admitted: list[float] | None = None):
        self.limit, self.window, self.admitted = limit, window_s, deque(admitted or [])

    def allow(self, now: float) -> bool:
        while self.admitted and now - self.admitted[0] > self.window:
            self.admitted.popleft()
        if len(self.admitted) >= self.limit:
            return False
        self.admitted.append(now)
        return True


class FixedLimiter:
    """At most ``limit`` requests in a window that opens at a key's first request after the last window; denied ones count."""

    def __init__(self, limit: int, window_s: float, opened: float | None = None, count: int = 0):
        self.limit, self.window, self.opened, self.count = limit, window_s, opened, count

    def allow(self, now: float) -> bool:
        if self.opened is None or now >= self.opened + self.window:
            self.opened, self.count = now, 0
        self.count += 1
        return self.count <= self.limit


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _replay(make):
    """A replay of one stretch of a key after the other, of a partition sorted by key, stretch and time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for frame in frames:
            out = []
            for k, part, t in zip(frame["_key"].tolist(), frame["_part"].tolist(), frame["_t"].tolist(), strict=True):
                if machine is None or (k, part) != key:
                    key, machine = (k, part), make()
                out.append(machine.allow(t))
            frame["allowed"] = out
            yield frame.drop(columns=["_key", "_part", "_t"])

    return run


def stretches(rows: DataFrame, idle_s: float) -> DataFrame:
    """``rows`` (_key, _t) with ``_part``: a number for each stretch of a key's requests, parted where it was surely idle for more than ``idle_s``.

    Time is cut into cells of ``idle_s``; after an empty cell a new stretch begins.  Only the distinct cells of
    a key are put in order, not its requests.
    """
    wide = F.lit(max(int(idle_s * 1e6), 1))
    celled = rows.withColumn("_cell", F.coalesce(F.floor(F.round(F.col("_t") * 1e6).cast("long") / wide), F.lit(-(1 << 62))))
    at = Window.partitionBy("_key").orderBy("_cell")
    begins = F.when(F.coalesce(F.col("_cell") - F.lag("_cell").over(at) > 1, F.lit(True)), F.col("_cell"))
    parts = celled.select("_key", "_cell").distinct().withColumn("_begins", begins).select("_key", "_cell", F.max("_begins").over(at).alias("_part"))
    return celled.join(parts, ["_key", "_cell"]).drop("_cell")


def limited(log: DataFrame, key: str, ts: str, order: str, make, idle_s: float) -> DataFrame:
    """``log`` with ``allowed``: each key's requests through a limiter of its own, in order of time.

    A limiter forgets all after ``idle_s`` without a request, so a key's log is replayed in stretches between
    such gaps, each in whatever task; one stretch is serial, and streams through a partition.  Requests
    without a key share one limiter, as those of unknown senders do; those without a time are a stretch of their own.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    rows = log.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_t": seconds(F.col(ts))})
    parted = stretches(rows, idle_s).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_t", order)
    return parted.select(*[F.col(f"`{c}`") for c in log.columns], "_key", "_part", "_t").mapInPandas(_replay(make), f"{fields}, allowed boolean")


def rate_limit_sliding(log: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", limit: int = SETTINGS.rate_limit, window_s: float = SETTINGS.rate_window_s) -> DataFrame:
    return limited(log, key, ts, order, lambda: SlidingLimiter(limit, window_s), window_s)


def rate_limit_fixed(log: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", limit: int = SETTINGS.rate_limit, window_s: float = SETTINGS.rate_window_s) -> DataFrame:
    return limited(log, key, ts, order, lambda: FixedLimiter(limit, window_s), window_s)


def guard_chain(log: DataFrame, outer: str, inner: str, ts: str = "ts", order: str = "event_id", outer_limit: int = SETTINGS.rate_limit_ip, inner_limit: int = SETTINGS.rate_limit, window_s: float = SETTINGS.rate_window_s, key_ok: Column | None = None) -> DataFrame:
    """``log`` with ``verdict``: 401 without a valid key, 429 by the outer then by the inner limiter, or 200.

    A request that the inner limiter denies has used up its place in the outer one; one that the
    outer limiter denies never reaches the inner one.
    """
    keyed = log.withColumn("_ok", F.coalesce(key_ok, F.lit(False)) if key_ok is not None else F.lit(True))
    checked = limited(keyed.where("_ok"), outer, ts, order, lambda: SlidingLimiter(outer_limit, window_s), window_s).withColumnRenamed("allowed", "_outer")
    passed = limited(checked.where("_outer"), inner, ts, order, lambda: SlidingLimiter(inner_limit, window_s), window_s).withColumn("verdict", F.when(F.col("allowed"), 200).otherwise(429))
    denied = checked.where("NOT _outer").withColumn("verdict", F.lit(429))
    refused = keyed.where("NOT _ok").withColumn("verdict", F.lit(401))
    cols = [*log.columns, "verdict"]
    return passed.select(cols).unionByName(denied.select(cols)).unionByName(refused.select(cols))


class TtlCache:
    """Whether a key's answer is cached: a miss stores it, a hit doesn't renew it."""

    def __init__(self, ttl_s: float):
        self.ttl, self.stored = ttl_s, None

    def allow(self, now: float) -> bool:
        if self.stored is not None and now - self.stored <= self.ttl:
            return True
        self.stored = now
        return False


def cache_hits(log: DataFrame, key: str, ts: str = "ts", order: str = "event_id", ttl_s: float = SETTINGS.cache_ttl_s) -> DataFrame:
    """``log`` with ``hit``: whether the key's answer was stored at most ``ttl_s`` before."""
    return limited(log, key, ts, order, lambda: TtlCache(ttl_s), ttl_s).withColumnRenamed("allowed", "hit")


def cache_stats(hits: DataFrame) -> DataFrame:
    """One row: hits, misses and the rate of hits, 0 where there were none."""
    n = F.count_if("hit")
    return hits.agg(n.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.round(n / F.nullif(F.count("hit"), F.lit(0)), 3), F.lit(0.0)).alias("hit_rate"))


def sessions(log: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", ttl_s: float = SETTINGS.history_ttl_s, renews: Column | None = None) -> DataFrame:
    """``log`` with ``session_no``: a key's session ends when it is idle for more than ``ttl_s``.

    Every row renews a session, or only those where ``renews`` holds (messages appended, not reads); another row
    belongs to the session that is still alive, or to none (null).
    """
    at = Window.partitionBy(key).orderBy(ts, order)
    own = F.coalesce(renews, F.lit(False)) if renews is not None else F.lit(True)
    before = F.last(F.when(F.col("_renews"), seconds(F.col(ts))), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    over = before.isNull() | (seconds(F.col(ts)) - before > ttl_s)
    marked = log.withColumn("_renews", own).withColumn("_over", over)
    number = F.sum(F.when(F.col("_renews") & F.col("_over"), 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return marked.withColumn("session_no", F.when(F.col("_renews") | ~F.col("_over"), number)).drop("_renews", "_over")


def last_messages(turns: DataFrame, session: str = "conv_id", turn: str = "turn", n: int = SETTINGS.history_turns) -> DataFrame:
    """The last ``n`` messages of every session, numbered from 0 in their own order."""
    back = Window.partitionBy(session).orderBy(F.desc(turn))
    ahead = Window.partitionBy(session).orderBy(turn)
    return turns.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n").withColumn("position", F.row_number().over(ahead) - 1)


def request_metrics(log: DataFrame, error: Column, latency_ms: Column) -> DataFrame:
    """One row: requests, errors, and the average latency to a tenth of a millisecond."""
    return log.agg(F.count(F.lit(1)).alias("requests"), F.count_if(error).alias("errors"), F.round(F.avg(latency_ms), 1).alias("avg_latency_ms"))
