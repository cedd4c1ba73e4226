"""Ranked lists into one: reciprocal-rank fusion, merging of variants, sources without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import or_else
from .lexical import top_k


def reciprocal_rank(lists: list[DataFrame], group: str, id_col: str, k: int, rrf_k: int = SETTINGS.rrf_k) -> DataFrame:
    """(group, id, score, rank): the sum of 1 / (rrf_k + rank) over the lists, ranks from 0."""
    voted = reduce(DataFrame.unionByName, [x.select(group, id_col, (1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("vote")) for x in lists])
    fused = voted.groupBy(group, id_col).agg(F.round(F.sum("vote"), 9).alias("score"))
    return top_k(fused, group, "score", id_col, k)


def query_variants(question: Column, translated: Column, limit: int = SETTINGS.max_variants) -> Column:
    """ARRAY<STRING>: the question, and its translation if there is one that differs beyond case."""
    extra = F.when(translated.isNotNull() & (translated != "") & (F.lower(translated) != F.lower(question)), F.array(translated)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(F.array(question), extra), 1, limit)


def merge_variants(first: DataFrame, second: DataFrame, group: str, id_col: str, k: int = SETTINGS.candidate_k, exhaustive: bool = False) -> DataFrame:
    """Candidates of two variants: the best score of each id, the k best ids.

    The second variant only counts for groups where the first found fewer than ``k`` ids, unless
    ``exhaustive``.
    """
    if not exhaustive:
        done = first.groupBy(group).agg(F.countDistinct(id_col).alias("n")).where(F.col("n") >= k)
        second = second.join(done, group, "left_anti")
    cols = [group, id_col, "score"]
    best = first.select(cols).unionByName(second.select(cols)).groupBy(group, id_col).agg(F.max("score").alias("score"))
    return top_k(best, group, "score", id_col, k)


def distinct_sources(hits: DataFrame, group: str, rank: str = "rank") -> DataFrame:
    """The first hit of every source and article of a group, ranked anew from 0; the source of an unnamed one is ``?``."""
    same = Window.partitionBy(group, "source", "article_no").orderBy(rank)
    first = hits.withColumn("source", or_else(F.col("source"), F.lit("?"))).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(rank)) - 1)


def search_status(attempts: DataFrame, hits: DataFrame, group: str) -> DataFrame:
    """(group, status) of ``attempts`` (group, failed), a row a variant searched.

    ``unavailable`` where all variants failed; else ``found`` or, without hits, ``empty``: one variant that
    worked is enough.  An attempt without a word of failure worked.
    """
    tried = attempts.groupBy(group).agg(F.min(F.coalesce("failed", F.lit(False))).alias("_down"))
    held = hits.select(group).distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_down"), "unavailable").when(F.col("_hit"), "found").otherwise("empty")
    return tried.join(held, group, "left").select(group, status.alias("status"))
