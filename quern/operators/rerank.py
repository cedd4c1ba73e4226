"""Reranking of candidates by a pluggable scorer, the threshold and the final cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import sigmoid
from .lexical import terms, top_k


class Scorer(Protocol):
    def __call__(self, question: Column, passage: Column) -> Column:
        """A logit; null where the model failed."""


def overlap_logit(question: Column, passage: Column) -> Column:
    """The default scorer: the share of the question's distinct terms in the passage, from -4 for none to 4 for all."""
    asked = F.array_distinct(terms(question))
    shared = F.size(F.array_intersect(asked, F.array_distinct(terms(passage))))
    return F.when(F.size(asked) == 0, F.lit(-4.0)).otherwise(8.0 * shared / F.size(asked) - 4.0)


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer of a model: ``load`` runs once a task and returns what turns questions and passages into logits.

    A batch that the model fails on has null scores, and so keeps the search's order.
    """

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for question, passage in pairs:
            try:
                yield pd.Series(model(question.fillna("").tolist(), passage.fillna("").tolist()), dtype="float64")
            except Exception:  # a failed model filters nothing
                yield pd.Series([None] * len(question), dtype="float64")

    return lambda question, passage: score(question, passage)


def rerank(candidates: DataFrame, group: str, id_col: str, question: str = "question", passage: str = "passage", scorer: Scorer = overlap_logit, settings: Settings = SETTINGS) -> DataFrame:
    """The best ``top_k`` candidates of every group, by the sigmoid of the scorer's logit.

    Candidates below the threshold go; where the scorer gave null, the search's order stands and
    nothing is filtered.
    """
    scored = candidates.withColumn("rerank_score", F.round(sigmoid(scorer(F.col(question), F.col(passage))), 6))
    kept = scored.where(F.col("rerank_score").isNull() | (F.col("rerank_score") >= settings.rerank_threshold))
    order = F.struct(F.coalesce("rerank_score", F.lit(-1.0)).alias("r"), (-F.col("rank")).alias("n"))
    return top_k(kept.withColumn("_order", order).drop("rank"), group, "_order", id_col, settings.top_k).drop("_order")
