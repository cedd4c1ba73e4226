"""From raw documents to a sharded training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  Decisions
that depend on a text alone travel by its digest, so rows that repeat an id are judged each by
its own text, and no text is shuffled where the decisions fit a bounded broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import decontamination, mixing, near_duplicates, quality, sharding
from quern.llm.spark_io import small_or_not, table, written

#: Shares of tokens by language: English is over-represented in what is there, the others are repeated to meet these.
TARGETS = {"en": 0.46, "de": 0.18, "es": 0.18, "fr": 0.18}
#: Every clean document stays, and comes at most four times; a language needs this share of the labelled rows to be a domain.
MIX = mixing.MixConfig(least=1.0, least_others=1.0, most=4.0)
LEAST_SHARE = 0.01


def _digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below its threshold)."""
    config = quality.QualityConfig()
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()), config)
    scored = quality.score(docs, model, config, keep=tuple(docs.columns))
    return scored.where(F.col("score") >= config.threshold).select(docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the least id, a null id last.

    Of rows that repeat both id and text one stays; an id with several texts counts as several documents.
    """
    known = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), _digest().alias("text"))
    rows = docs.withColumn("_id", known)
    kept = near_duplicates.near_duplicates(rows, id_col="_id", classes=True).where("kept").select("_id").distinct()
    once = Window.partitionBy("_id").orderBy("_id")
    return rows.join(kept, "_id", "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(docs.columns)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    texts = docs.select(_digest().alias("_text"), "text")
    found = decontamination.contamination(texts, table(spark, sf_dir, "benchmark"), id_col="_text")
    bad = small_or_not(written(found.where("contaminated").select("_text").distinct()))
    return docs.withColumn("_text", _digest()).join(bad, "_text", "left_anti").select(docs.columns)


def _same_document(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}._t1") == F.col(f"{right}._t1")) & (F.col(f"{left}._t2") == F.col(f"{right}._t2"))


def without_toxic(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (doc_id, _t1, _t2, text and more) but those likelier toxic than good, by soft membership learned from ``labels``."""
    marks = mixing.label_domains(labels).where("domain <> 'low'")
    told = mixing.domain_posteriors(keyed, marks, ["good", "toxic"], keep=("_t1", "_t2"))
    bad = written(told.where(F.element_at("posterior", 2) > F.element_at("posterior", 1)).select("doc_id", "_t1", "_t2").distinct())
    return keyed.alias("d").join(small_or_not(bad).alias("b"), _same_document("d", "b"), "left_anti")


def language_rates(clean: DataFrame, labels: DataFrame) -> DataFrame:
    """``mixing.mix`` of the rows by language, learned from labelled documents whose language is told: rates that meet TARGETS, of domains that the corpus has."""
    told = clean.join(labels.select("doc_id").distinct(), "doc_id").where(F.col("lang").isin(list(TARGETS))).select("doc_id", F.col("lang").alias("domain"))
    told = written(told)
    counts = {r["domain"]: r["count"] for r in told.groupBy("domain").count().collect()}  # TARGETS rows at most
    known = {d: share for d, share in TARGETS.items() if counts.get(d, 0) >= max(1, LEAST_SHARE * sum(counts.values()))} or {"en": 1.0}
    anchor = max(known, key=lambda d: (known[d], d))
    return mixing.mix(clean, told, known, anchor=anchor, config=MIX, keep=("_t1", "_t2"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents, and repeats others so that languages' expected tokens meet TARGETS.

    A document comes out as often as its rate says: the whole part, and once more by a hash of
    its id and text with the chance of the rest.
    """
    labels = table(spark, sf_dir, "labels")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text)})  # 128 bits of the text
    clean = without_toxic(keyed, labels)
    # rows of one id and text have one rate; a rate of 1, which most have, needs no row
    rates = written(language_rates(clean, labels).where("rate <> 1").groupBy("doc_id", "_t1", "_t2").agg(F.min("rate").alias("_rate")))
    chance = F.pmod(F.xxhash64("doc_id", "_t1"), F.lit(1 << 20)) / float(1 << 20)
    joined = clean.alias("d").join(small_or_not(rates).alias("r"), _same_document("d", "r"), "left").select("d.*", F.coalesce("_rate", F.lit(1.0)).alias("_rate"))
    copies = joined.withColumn("_copies", F.floor(F.col("_rate") + chance).cast("int")).where("_copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of every row of the mix."""
    return sharding.shard(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicate_filter", near_duplicate_filter),
    ("decontamination_filter", decontamination_filter),
    ("mix_to_targets", mix_to_targets),
    ("shard", shard),
]

#: The classifier, the forest and the mix are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
