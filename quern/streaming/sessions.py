"""Sessions as a stream: requests as JSON with a schema, histories as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import SETTINGS
from ..operators.routing import valid_request

#: A request's fields; more are ignored.
REQUEST = "question string, session_id string"
#: Bytes of a request, at most.
MAX_BODY_BYTES = 64 << 10


def parsed_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` (a stream or not) with question, session_id and ``rejected``: null, or the status of what is no request.

    413: longer than MAX_BODY_BYTES; 422: no JSON object of a text ``question`` of 1 to 2000 characters and a
    ``session_id`` of 64 at most, if any.  Every line comes out once, good or bad.
    """
    body = F.col(column)
    read = F.from_json(body, f"{REQUEST}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("_r", read)
    texts = F.coalesce(F.get_json_object(body, "$.question"), F.lit("")) == F.coalesce(F.col("_r.question"), F.lit(""))
    fits = F.col("_r").isNotNull() & F.col("_r._bad").isNull() & texts & valid_request(F.col("_r.question"), F.col("_r.session_id"))
    status: Column = F.when(F.octet_length(body) > MAX_BODY_BYTES, 413).when(~F.coalesce(fits, F.lit(False)), 422)
    good = status.isNull()
    return out.select(*lines.columns, F.when(good, F.col("_r.question")).alias("question"), F.when(good, F.col("_r.session_id")).alias("session_id"), status.alias("rejected"))


class _History(StatefulProcessor):
    """The last messages of a session: a list in order of time, dropped by a timer when the session was idle for ``ttl_s`` of event time."""

    def __init__(self, keep: int, recent: int, ttl_s: float):
        self.keep, self.recent, self.ttl_ms = keep, recent, int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "at long, role string, text string")

    def _cleared(self) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.turns.get()]
        for frame in rows:
            at = frame["t"].astype("datetime64[ms]").astype("int64")
            held += zip(at.tolist(), frame["role"].fillna("").tolist(), frame["text"].fillna("").tolist(), strict=True)
        ordered = sorted(set(held))  # a message that comes twice is one; one that comes late takes its place
        start = 0
        for i in range(1, len(ordered)):
            if ordered[i][0] - ordered[i - 1][0] > self.ttl_ms:
                start = i  # the session was idle for too long before it
        ordered = ordered[start:][-self.keep :]
        self.turns.put(ordered)
        self._cleared()
        self.handle.registerTimer(ordered[-1][0] + self.ttl_ms + 1)
        recent = [f"{role}: {text}" for _, role, text in ordered[-self.recent :]]
        yield pd.DataFrame({"session": [key[0]], "at": [ordered[-1][0]], "messages": [len(ordered)], "recent": ["\n".join(recent)], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        yield pd.DataFrame({"session": [key[0]], "at": [expiredTimerInfo.getExpiryTimeInMs()], "messages": [0], "recent": [""], "ended": [True]})

    def close(self) -> None:
        pass


def session_histories(messages: DataFrame, late: str = "10 minutes", turns: int = SETTINGS.history_turns, ttl_s: float = SETTINGS.history_ttl_s) -> DataFrame:
    """(session, at, messages, recent, ended) of a stream of messages (session string, t timestamp, role, text).

    A row for each session that a batch has messages of: when the last was, how many are held (twice ``turns`` at most), and the last
    ``turns``; and a row with ``ended`` when the watermark (``late`` behind the newest message) passes a session's end,
    which also frees its state.  Messages that repeat count once; late ones, if not later than ``late``, are put where they belong.
    """
    rows = messages.select(F.col("session").cast("string").alias("session"), "t", "role", "text").withWatermark("t", late)
    schema = "session string, at long, messages long, recent string, ended boolean"
    return rows.groupBy("session").transformWithStateInPandas(_History(2 * turns, turns, ttl_s), schema, "Update", "EventTime")


def recent_messages(messages: DataFrame, turns: int = SETTINGS.history_turns, ttl_s: float = SETTINGS.history_ttl_s) -> DataFrame:
    """(session, at, messages, recent) at the end of a table of messages: what the stream's last row of every session says."""
    from pyspark.sql import Window

    own = Window.partitionBy("session").orderBy("at", "role", "text")
    at = F.unix_millis(F.col("t").cast("timestamp"))
    rows = messages.select(F.col("session").cast("string").alias("session"), at.alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    gap = F.coalesce((F.col("at") - F.lag("at").over(own) > int(ttl_s * 1000)).cast("int"), F.lit(0))
    parted = rows.withColumn("gap", gap).withColumn("visit", F.sum("gap").over(own))
    last = Window.partitionBy("session").orderBy(F.desc("at"), F.desc("role"), F.desc("text"))
    newest = parted.withColumns({"n": F.row_number().over(last), "now": F.first("visit").over(last)}).where((F.col("visit") == F.col("now")) & (F.col("n") <= 2 * turns))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= turns, F.struct((-F.col("n")).alias("n"), F.concat("role", F.lit(": "), "text").alias("line"))))), lambda x: x["line"])
    return newest.groupBy("session").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("messages"), F.array_join(lines, "\n").alias("recent"))
