"""Answers token by token: each token goes to a sink as the model makes it, before the next one is asked for.

A task pulls the model's tokens and hands on every event at once; what the job returns is the whole answer,
or what failed.  An event's place is its batch, question and number, so that a retried task says the same again in
the same place, and histories and caches, which are written from the job's result, never see half an answer.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class TokenSink(Protocol):
    """Where events go: made once a task, by a function that is shipped to it."""

    def begin(self, batch: int, question: str) -> None:
        """Events of this question follow; those of an earlier attempt are void."""

    def event(self, batch: int, question: str, seq: int, event: str) -> None: ...


class FileSink:
    """A file of events a question, in a folder that tasks and readers share; a new attempt begins it anew."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, batch: int, question: str) -> str:
        return f"{self.folder}/{batch}-{question.encode().hex()}.sse"

    def begin(self, batch: int, question: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        open(self._path(batch, question), "w").close()

    def event(self, batch: int, question: str, seq: int, event: str) -> None:
        with open(self._path(batch, question), "a", encoding="utf-8") as f:
            f.write(event)


def _event(**fields) -> str:
    return f"data: {json.dumps(fields, ensure_ascii=False, separators=(',', ':'))}\n\n"


#: (question, context, language) to the answer's tokens, one by one.
TokenModel = Callable[[str, str, str], Iterable[str]]


def answer_by_tokens(questions: DataFrame, batch: int, load: Callable[[], TokenModel], sink: Callable[[], TokenSink]) -> DataFrame:
    """(question_id, answer, failed) of ``questions`` (question_id, question, context, lang), whose events go to the sink meanwhile.

    Events are tokens and then ``done``, or an ``error`` where the model failed, of which no answer is left.  A null context is
    no failure: the model isn't asked, and the answer is null.  The result must be written, or read once: each reading asks the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = None, None
        for rows in batches:
            for r in rows.to_pylist():
                model, out = model or load(), out or sink()
                key = str(r["question_id"])
                if r["context"] is None:
                    answer, failed = None, None
                else:
                    said: list[str] = []
                    out.begin(batch, key)
                    try:
                        for token in model(r["question"] or "", r["context"], r["lang"] or ""):
                            out.event(batch, key, len(said), _event(type="token", token=token))
                            said.append(token)
                        answer, failed = "".join(said), None
                        last = _event(type="done")
                    except Exception as e:  # one question's failure is its own
                        answer, failed = None, "generation"
                        last = _event(type="error", message=str(e) or type(e).__name__)
                    out.event(batch, key, len(said), last)
                yield pa.RecordBatch.from_arrays([pa.array([r["question_id"]], rows.schema.field("question_id").type), pa.array([answer], pa.string()), pa.array([failed], pa.string())], ["question_id", "answer", "failed"])

    kind = questions.schema["question_id"].dataType.simpleString()
    return questions.select("question_id", "question", "context", "lang").mapInArrow(run, f"question_id {kind}, answer string, failed string")
