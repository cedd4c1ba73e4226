"""Live versions: limiters, sessions and questions as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SETTINGS
from ..operators.routing import route
from ..operators.state import SlidingLimiter


def _timeout(forever: bool) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if forever else GroupStateTimeout.NoTimeout


def stream_limiter(requests: DataFrame, key: str, limit: int = SETTINGS.rate_limit, window_s: float = SETTINGS.rate_window_s, forever: bool = True) -> DataFrame:
    """(key, id, t, allowed) of a stream of requests (key, id, t in seconds), each key by a sliding limiter.

    The state is the times of admitted requests of the last window, ``limit`` at most; it ends
    when a key is idle for a window.  With such timeouts Spark runs batches without end, new rows or not; a stream that is to end
    with what is there (``availableNow``) takes ``forever=False``, and keeps its state.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = SlidingLimiter(limit, window_s, list(state.get[0]) if state.exists else [])
        for frame in frames:
            frame = frame.sort_values(["t", "id"])
            allowed = [machine.allow(t) for t in frame["t"].tolist()]
            yield pd.DataFrame({"key": [str(keys[0])] * len(frame), "id": frame["id"], "t": frame["t"], "allowed": allowed})
        state.update((list(machine.admitted),))
        if forever:
            state.setTimeoutDuration(int(window_s * 1000) or 1)

    rows = requests.selectExpr(f"cast(`{key}` as string) as key", "id", "t")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, id long, t double, allowed boolean", "times array<double>", "append", _timeout(forever))


def stream_history(messages: DataFrame, turns: int = SETTINGS.history_turns, ttl_s: float = SETTINGS.history_ttl_s, forever: bool = True) -> DataFrame:
    """(session, t, recent) of a stream of messages (session, t, role, text): the last ``turns`` messages, from an empty history after an idle ``ttl_s``.

    ``forever`` as in ``stream_limiter``.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        for frame in frames:
            frame = frame.sort_values("t")
            out = []
            for t, role, text in zip(frame["t"], frame["role"], frame["text"], strict=True):
                held = [] if last is not None and t - last > ttl_s else held
                held, last = [*held, f"{role}: {text}"][-2 * turns :], t
                out.append((keys[0], t, "\n".join(held[-turns:])))
            yield pd.DataFrame(out, columns=["session", "t", "recent"])
        state.update((held, last))
        if forever:
            state.setTimeoutDuration(int(ttl_s * 1000) or 1)

    return messages.groupBy("session").applyInPandasWithState(step, "session string, t double, recent string", "held array<string>, last double", "append", _timeout(forever))


def serve(questions: DataFrame, respond: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Answers a stream of questions: every micro-batch goes through the batch operators.

    ``respond`` takes the routed questions of a batch and gives their answers; ``sink`` writes
    them and should be idempotent by batch number.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(respond(route(batch)), number)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
