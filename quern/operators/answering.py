"""Hits to context, messages and answers; models are pluggable, offline defaults deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import patterns as P
from ..functions import text as T


class Generator(Protocol):
    def __call__(self, question: Column, context: Column, lang: Column) -> Column:
        """The answer, or null where the model failed."""


def context_block(rank: Column, title: Column, article: Column, text: Column, limit: int = SETTINGS.context_chars) -> Column:
    """A hit as a numbered element; its text is cut first and escaped then."""
    label = F.concat(F.coalesce(title, F.lit("?")), F.coalesce(F.concat(F.lit(" | "), F.nullif(article, F.lit(""))), F.lit("")))
    return F.concat(F.lit('<doc id="'), (rank + 1).cast("string"), F.lit('" source="'), label, F.lit('">\n'), T.escape_angles(F.substring(text, 1, limit)), F.lit("\n</doc>"))


def build_context(hits: DataFrame, group: str) -> DataFrame:
    """(group, context): the hits of every group as one block of numbered elements, in order of rank."""
    block = context_block(F.col("rank"), F.col("title"), F.col("article_no"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])
    return hits.groupBy(group).agg(F.concat(F.lit("<context>\n"), F.array_join(ordered, "\n"), F.lit("\n</context>")).alias("context"))


def messages(system: Column, history: Column, context: Column, question: Column, lang: Column) -> Column:
    """ARRAY<STRUCT<role, content>>: the system's message, the history, then context, question and directive."""
    user = F.concat(context, F.lit("\n\n"), question, F.lit("\n\n"), T.language_directive(lang))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), history, F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))))


def extractive_answer(question: Column, context: Column, lang: Column) -> Column:
    """The default generator: the first line of the first document in the context."""
    return F.coalesce(F.nullif(F.regexp_extract(context, r'<doc id="1"[^>]*>\n([^\n]*)', 1), F.lit("")), F.lit(P.NO_INFORMATION))


def model_generator(load: Callable[[], Callable[[str, str, str], str | None]]) -> Generator:
    """A generator of a model: ``load`` runs once a task and returns what answers a question from a context in a language; what it fails on is null."""

    @F.pandas_udf("string")
    def generate(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()

        def one(question: str | None, context: str | None, lang: str | None) -> str | None:
            try:
                return None if context is None else model(question or "", context, lang or "")
            except Exception:  # one question's failure is its own
                return None

        for question, context, lang in rows:
            yield pd.Series([one(*x) for x in zip(question, context, lang, strict=True)], dtype="object")

    return lambda question, context, lang: generate(question, context, lang)


def answer(routed: DataFrame, contexts: DataFrame, group: str, generator: Generator = extractive_answer) -> DataFrame:
    """``routed`` questions with ``answer``: the fixed reply, or the generator's, or, without a context, that there is no information.

    Where the generator failed (null), there is no answer, and ``failed`` says so; it is null elsewhere.
    """
    joined = routed.join(contexts, group, "left")
    asked = F.col("reply").isNull() & F.col("context").isNotNull()
    made = joined.withColumn("answer", F.when(asked, generator(F.col("clean"), F.col("context"), F.col("lang"))).otherwise(F.coalesce("reply", F.lit(P.NO_INFORMATION))))
    return made.withColumn("failed", F.when(asked & F.col("answer").isNull(), F.lit("generation")))


def sse_events(answers: DataFrame, key: str, text: str = "answer", sources: str | None = None, session: str | None = None, failed: str | None = None) -> DataFrame:
    """(key, seq, event): an answer as a stream of events: ``sources`` first (with the session's id), one event a token, and ``done`` at the end.

    ``sources`` (an array of structs), ``session`` and ``failed`` are columns.  Where ``failed`` has a message, an
    ``error`` event with it ends the stream instead of ``done``; a null answer has no tokens.
    """
    said = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=\s)"), lambda t: t != "")
    tokens = F.transform(said, lambda t: F.to_json(F.struct(F.lit("token").alias("type"), t.alias("token"))))
    start = F.struct(F.lit("sources").alias("type"), *([F.col(sources).alias("sources")] if sources else []), *([F.col(session).alias("session_id")] if session else []))
    first = F.array(F.to_json(start)) if sources or session else F.array().cast("array<string>")
    done = F.to_json(F.struct(F.lit("done").alias("type")))
    last = done if failed is None else F.when(F.col(failed).isNull(), done).otherwise(F.to_json(F.struct(F.lit("error").alias("type"), F.col(failed).alias("message"))))
    each = answers.select(key, F.posexplode(F.concat(first, tokens, F.array(last))).alias("seq", "payload"))
    return each.select(key, "seq", F.concat(F.lit("data: "), "payload", F.lit("\n\n")).alias("event"))


def reassemble(events: DataFrame, key: str) -> DataFrame:
    """(key, answer, complete, sources, session_id, error): what a client puts together from the events; ``sources`` as JSON."""
    body = F.regexp_extract("event", r"(?s)^data: (.*?)\n\n$", 1)
    each = events.withColumn("e", F.from_json(body, "type string, token string, message string, session_id string")).withColumn("sources", F.get_json_object(body, "$.sources"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("e.type") == "token", F.struct("seq", F.col("e.token").alias("token")))))
    text = F.array_join(F.transform(ordered, lambda x: x["token"]), "")
    return each.groupBy(key).agg(
        text.alias("answer"),
        F.max(F.col("e.type") == "done").alias("complete"),
        F.max("sources").alias("sources"),
        F.max("e.session_id").alias("session_id"),
        F.max_by("e.message", F.when(F.col("e.type") == "error", F.col("seq"))).alias("error"),
    )
