"""Questions end to end: routes, variants, hybrid search, reranking, sources, context, answers.

A batch of questions flows through; live serving runs the same functions on micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions import text as T
from ..operators import answering, dense, fusion, lexical, rerank
from ..operators.routing import route, valid_request
from ..operators.store import written


def hybrid(questions: DataFrame, chunks: DataFrame, k: int, settings: Settings = SETTINGS, encoder: dense.Encoder = dense.hashed_encoder, vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, chunk_key, score, rank): lexical and dense lists of twice ``k``, fused.

    ``questions`` has a long ``question_id`` and ``text``, ``chunks`` a long ``chunk_key`` and ``text``; ``vectors`` are the questions', if they are known.
    """
    sparse = lexical.bm25(chunks, questions, 2 * k, settings, "chunk_key", "question_id")
    asked = encoder(questions, "question_id", dense.QUERY_PREFIX) if vectors is None else vectors.join(questions.select("question_id"), "question_id", "left_semi")
    near = dense.nearest(asked, encoder(chunks, "chunk_key", dense.PASSAGE_PREFIX), 2 * k)
    return fusion.reciprocal_rank([sparse, near.withColumnsRenamed({"query_id": "question_id", "id": "chunk_key"})], "question_id", "chunk_key", k, settings.rrf_k)


def _attempts(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, failed): whether the encoder gave a question with words no vector."""
    worded = questions.where(F.size(lexical.terms(F.col("text"))) > 0)
    return worded.join(vectors.select("question_id", F.lit(False).alias("failed")), "question_id", "left").select("question_id", F.coalesce("failed", F.lit(True)).alias("failed"))


def search_variants(questions: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS, use_hybrid: bool = True, exhaustive: bool = False, encoder: dense.Encoder = dense.hashed_encoder) -> tuple[DataFrame, DataFrame]:
    """(candidates, attempts): (question_id, chunk_key, score, rank), and (question_id, failed) with a row a variant searched.

    The second variant (``translated``) is searched only for questions of which the first found fewer than enough
    chunks, unless ``exhaustive``.  A variant that the encoder failed on finds nothing.
    """
    k = settings.candidate_k

    def search(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not use_hybrid:
            return written(lexical.bm25(chunks, asked, k, settings, "chunk_key", "question_id")), asked.select("question_id", F.lit(False).alias("failed"))
        vectors = written(encoder(asked, "question_id", dense.QUERY_PREFIX))
        tried = written(_attempts(asked, vectors))
        up = asked.join(tried.where("failed").select("question_id"), "question_id", "left_anti")
        return written(hybrid(up, chunks, k, settings, encoder, vectors)), tried

    found, tried = search(written(questions.select("question_id", "text")))
    if "translated" in questions.columns:
        variants = fusion.query_variants(F.col("text"), F.col("translated"), settings.max_variants)
        second = questions.select("question_id", F.get(variants, F.lit(1)).alias("text")).where("text IS NOT NULL")
        if not exhaustive:
            done = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            second = second.join(done, "question_id", "left_anti")
        more, again = search(written(second))
        found, tried = fusion.merge_variants(found, more, "question_id", "chunk_key", k, True), tried.unionByName(again)
    return found, tried


def reranked(questions: DataFrame, found: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS, scorer: rerank.Scorer = rerank.overlap_logit) -> DataFrame:
    """The candidates with their chunks' columns, reranked by the question itself, cut by the threshold, ``top_k`` at most."""
    candidates = found.join(questions.select("question_id", F.col("text").alias("question")), "question_id").join(chunks.withColumnRenamed("text", "passage"), "chunk_key")
    return rerank.rerank(candidates, "question_id", "chunk_key", scorer=scorer, settings=settings).withColumnRenamed("passage", "text")


def retrieve(questions: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS, use_hybrid: bool = True, exhaustive: bool = False, scorer: rerank.Scorer = rerank.overlap_logit, encoder: dense.Encoder = dense.hashed_encoder) -> DataFrame:
    """The best chunks of every question: (question_id, chunk_key, score, rerank_score, rank) with the chunk's columns.

    ``questions`` may have a ``translated`` text, searched as a second variant where the first
    found too little (or always, if ``exhaustive``).
    """
    found, _ = search_variants(questions, chunks, settings, use_hybrid, exhaustive, encoder)
    return reranked(questions, found, chunks, settings, scorer)


def answer_questions(questions: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS, generator: answering.Generator = answering.extractive_answer, attempts: DataFrame | None = None, **options) -> DataFrame:
    """``questions`` (question_id, question) with route, language, answer and sources.

    Only questions that no fixed reply settles, and whose lengths are in range, are searched.  ``status`` tells whether
    the search was up (``fusion.search_status``, of the search's own attempts or of ``attempts`` (question_id, failed), a
    row a variant searched).  ``failed`` names what went wrong, ``search`` or ``generation``; such a question has no answer.  ``cacheable``
    tells which answers may be cached: those made from chunks, for questions without a history, where nothing failed.
    """
    session = F.col("session_id") if "session_id" in questions.columns else F.lit(None).cast("string")
    routed = route(questions).withColumn("route", F.when(valid_request(F.col("question"), session), F.col("route")).otherwise("invalid"))
    asked = routed.where("route = 'retrieve'").select("question_id", F.col("clean").alias("text"), *[c for c in ("translated",) if c in questions.columns])
    scorer = options.pop("scorer", rerank.overlap_logit)
    found, tried = search_variants(asked, chunks, settings, **options)
    attempts = tried if attempts is None else attempts
    hits = written(reranked(asked, found, chunks, settings, scorer))
    known = set(chunks.columns)
    pick = lambda c: F.col(c) if c in known else F.lit(None).cast("string")
    hits = hits.select("question_id", "rank", "text", pick("source").alias("source"), T.or_else(pick("title"), pick("source")).alias("title"), pick("url").alias("url"), pick("article_no").alias("article_no"))
    answered = answering.answer(routed, answering.build_context(hits, "question_id"), "question_id", generator)
    cited = F.transform(F.array_sort(F.collect_list(F.struct("position", "title", "url", "article_no", "source"))), lambda x: x.dropFields("position"))
    sources = fusion.distinct_sources(hits, "question_id").groupBy("question_id").agg(cited.alias("sources"))
    out = answered.join(sources, "question_id", "left")
    history = F.coalesce(F.size("history") > 0, F.lit(False)) if "history" in questions.columns else F.lit(False)
    out = out.join(fusion.search_status(attempts, hits, "question_id"), "question_id", "left")
    down = (F.col("route") == "retrieve") & F.coalesce(F.col("status") == "unavailable", F.lit(False))
    out = out.withColumns({"answer": F.when(~down, F.col("answer")), "context": F.when(~down, F.col("context")), "failed": F.when(down, F.lit("search")).otherwise(F.col("failed"))})
    return out.withColumn("cacheable", (F.col("route") == "retrieve") & F.col("context").isNotNull() & F.col("failed").isNull() & ~history)


def history_rows(answered: DataFrame, fixed_routes: bool = False) -> DataFrame:
    """(question_id, role, text): the turns that a session remembers; those of fixed replies only if ``fixed_routes`` (as live streams do), and none of a question that failed."""
    kept = answered.where((F.lit(fixed_routes) | (F.col("route") == "retrieve")) & F.col("failed").isNull() & F.col("answer").isNotNull())
    pair: Column = F.array(F.struct(F.lit("user").alias("role"), F.col("clean").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return kept.select("question_id", F.posexplode(pair).alias("position", "m")).select("question_id", "position", "m.role", "m.text")
