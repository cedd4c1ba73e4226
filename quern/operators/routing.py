"""Questions to routes: refusals and fixed replies before anything is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def refusal(code: Column) -> Column:
    """The refusal in a language, or in English."""
    by_code = F.create_map(*[F.lit(x) for pair in P.REFUSALS.items() for x in pair])
    return F.coalesce(by_code[code], F.lit(P.REFUSALS["en"]))


def valid_request(question: Column, session_id: Column) -> Column:
    """Whether lengths are in range: a question of 1 to 2000 characters, a session id of 64 at most."""
    return F.coalesce(F.length(question).between(1, 2000), F.lit(False)) & F.coalesce(F.length(session_id) <= 64, F.lit(True))


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with ``clean``, ``flagged``, ``lang``, ``route`` and ``reply`` (null where a search is due).

    Prompt requests and questions of authorship are told by the raw question, greetings by the
    sanitised one; the first that applies is the route.
    """
    raw = F.col(question)
    out = questions.withColumn("_q", T.sanitise_question(raw)).withColumns({"clean": F.col("_q.text"), "flagged": F.col("_q.flagged"), "lang": T.detect_language(raw)}).drop("_q")
    chosen = (
        F.when(F.col("clean") == "", "invalid")
        .when(T.asks_for_prompt(raw), "refusal")
        .when(T.asks_for_author(raw), "author")
        .when(T.is_greeting(F.col("clean")), "greeting")
        .otherwise("retrieve")
    )
    reply = F.when(F.col("route") == "refusal", refusal(F.col("lang"))).when(F.col("route") == "author", P.AUTHOR_REPLY).when(F.col("route") == "greeting", P.GREETING_REPLY)
    return out.withColumn("route", chosen).withColumn("reply", reply)
