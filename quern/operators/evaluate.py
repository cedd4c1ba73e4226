"""Quality of retrieval: hit rate against expected sources, and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS


def hit_rate(cases: DataFrame, hits: DataFrame, case_id: str = "case_id", pass_rate: float = SETTINGS.eval_pass_rate) -> DataFrame:
    """One row: cases, how many have a hit whose source or title holds ``expected_source`` (in any case of letters), the rate, and whether it passes.

    Without cases the rate is 0.
    """
    wanted = F.lower("expected_source")
    held = F.lower(F.coalesce("source", F.lit(""))).contains(wanted) | F.lower(F.coalesce("title", F.lit(""))).contains(wanted)
    found = cases.join(hits, case_id).where(held).select(case_id).distinct().withColumn("hit", F.lit(True))
    rate = F.coalesce(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    return (
        cases.join(found, case_id, "left")
        .agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hits"), F.round(rate, 6).alias("rate"))
        .withColumn("passed", F.col("rate") >= pass_rate)
    )


def diagnostics(hits: DataFrame, group: str) -> DataFrame:
    """What a person looks at: rank, score, source, title and the start of the text."""
    return hits.select(group, "rank", "score", "source", "title", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 90).alias("snippet"))
