"""Lexical search: postings, corpus statistics, BM25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from .lexical_blocks import in_blocks, in_question_blocks, scored
from .store import BROADCAST_BYTES, small_or_not, written

#: Pairs of a question's term and a posting that are scored as they are, at most; of more, only documents that can still be among the best.
DIRECT_ROWS = 50_000_000
#: A question's rarest terms are scored first: those with this many postings together, for each document wanted.
SEED_POSTINGS = 50
#: And of what they find, so many documents for each one wanted are scored in full.
SEED_DOCUMENTS = 4
#: What rounding and the order of sums may add to a score.
_SLACK = 1e-3
#: Blocks of documents of a file, at most: readers and writers hold a file's rows at once.
PART_BLOCKS = 4


def terms(c: Column) -> Column:
    """The lower-cased runs of letters and digits of a text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): how often each document has each of its terms, and its length."""
    each = docs.select(F.col(id_col), terms(F.col(text_col)).alias("t")).select(id_col, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy(id_col, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def idf_stats(posts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df, cf): in how many documents a term is, and how often in all."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents and their average length in terms."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(terms(F.col(text_col)))).alias("avgdl"))


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ranked from 0; equal scores in order of ``tie``."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(order) - 1).where(F.col(rank) < k)


def asked_terms(questions: DataFrame, question_id: str) -> DataFrame:
    """(question, term, qtf): how often each question has each of its terms."""
    return questions.select(question_id, F.explode(terms(F.col("text"))).alias("term")).groupBy(question_id, "term").agg(F.count(F.lit(1)).alias("qtf"))


def one_text_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id, text) without null ids, of an id's several rows the one of least text; texts are shuffled only if there are such ids."""
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    several = written(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col))
    if several.isEmpty():
        return docs
    several = small_or_not(several)
    return docs.join(several, id_col, "left_anti").unionByName(docs.join(several, id_col, "left_semi").groupBy(id_col).agg(F.min("text").alias("text")))


def document_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of ``docs`` in blocks of documents (``lexical_blocks``), written."""
    rows = one_text_each(docs, id_col, text_col)
    return written(in_blocks(rows.select(F.col(id_col).alias("id"), terms(F.col("text")).alias("terms"))), maxRecordsPerFile=PART_BLOCKS)


def bm25(docs: DataFrame, questions: DataFrame, k: int, settings: Settings = SETTINGS, id_col: str = "doc_id", question_id: str = "item_id") -> DataFrame:
    """(question, id, score, rank): the k best documents of every question, exactly.

    Documents are read once, into blocks that may be kept (``document_blocks``).
    """
    return search_blocks(document_blocks(docs, id_col), questions, k, settings, id_col, question_id)


def search_blocks(blocks: DataFrame, questions: DataFrame, k: int, settings: Settings = SETTINGS, id_col: str = "doc_id", question_id: str = "item_id", reach: DataFrame | None = None) -> DataFrame:
    """(question, id, score, rank): the k best documents of every question, exactly, of ``document_blocks``.

    A pair of a block of documents and a group of blocks of questions is scored by one task, which keeps k documents a question; only
    these are shuffled.  ``reach`` (question, term, tf, dl) are postings of a document of each question: documents that score less than
    it are not looked for, so that questions that expect a document are scored against few others.
    """
    asked = written(asked_terms(questions, question_id))
    n, words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    avgdl = words / n if n and words else 1.0
    vocabulary = small_or_not(written(asked.select("term").distinct()))
    counts = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).select(F.col("c.terms").alias("term"), F.col("c.counts").alias("df"))
    df = counts.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = written(asked.join(df, "term").select(question_id, "term", (F.col("qtf") * idf).alias("w")))
    if reach is None:
        floored = weighted.withColumn("floor", F.lit(None).cast("double"))
    else:
        part = F.col("tf") * (settings.bm25_k1 + 1) / (F.col("tf") + settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("dl") / F.lit(float(avgdl))))
        floors = weighted.join(reach, [question_id, "term"]).groupBy(question_id).agg(F.sum(F.col("w") * part).alias("floor"))
        floored = written(weighted.join(floors, question_id, "left"))
    q = written(in_question_blocks(floored, question_id), maxRecordsPerFile=PART_BLOCKS)
    groups, held = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json("asked"))), F.lit(0))).first()
    turns = max(1, min(groups, -(-held // max(1, BROADCAST_BYTES))))
    of_turn = lambda i: scored(blocks.join(F.broadcast(q.where(F.col("nth") % turns == i)), F.lit(True)), k, settings.bm25_k1, settings.bm25_b, float(avgdl), question_id, id_col)
    # more questions than may be broadcast meet all blocks in turns, and one turn's are held at a time
    scores = of_turn(0) if turns == 1 else reduce(DataFrame.unionByName, [written(of_turn(i)) for i in range(turns)])
    return top_k(scores, question_id, "score", id_col, k).select(question_id, id_col, "score", "rank")


def score_postings(posts: DataFrame, asked: DataFrame, n: int, words: int, k: int, settings: Settings = SETTINGS, id_col: str = "doc_id", question_id: str = "item_id", df: DataFrame | None = None) -> DataFrame:
    """(question, id, score, rank) of the postings (id, term, tf, dl; a written table) of the asked terms (question, term, qtf; written, too).

    ``n`` and ``words`` are the corpus's documents and terms, ``df`` (term, df) may be known.  Where scored postings are many, the
    best documents by each question's rarest terms are scored in full, and the k-th of these scores is a bound that its
    k-th best document reaches; terms that can't reach it together (by the greatest contribution of each) need not be looked
    up to find candidates, so what very frequent terms alone bring is never scored.
    """
    avgdl = words / n if n else 1.0
    hint = small_or_not
    tf = F.col("tf") * (settings.bm25_k1 + 1) / (F.col("tf") + settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("dl") / F.lit(float(avgdl or 1))))
    posts = posts.withColumn("part", tf)
    most = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    df = most if df is None else most.drop("df").join(df, "term")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = written(asked.join(df, "term").withColumn("w", F.col("qtf") * idf).select(question_id, "term", "w", "df", (F.col("w") * F.col("most")).alias("bound")))
    summed = lambda by: posts.join(hint(by.select(question_id, "term", "w")), "term").groupBy(question_id, id_col).agg(F.sum(F.col("w") * F.col("part")).alias("sum"))
    if (weighted.agg(F.sum("df")).first()[0] or 0) <= DIRECT_ROWS:
        scored = summed(weighted)
    else:
        rare = Window.partitionBy(question_id).orderBy("df", "term")
        seeds = weighted.withColumns({"upto": F.sum("df").over(rare), "nth": F.row_number().over(rare)}).where((F.col("nth") == 1) | (F.col("upto") <= SEED_POSTINGS * k))
        best = Window.partitionBy(question_id).orderBy(F.desc("sum"))
        first = summed(seeds).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= SEED_DOCUMENTS * k).select(question_id, id_col)
        whole = first.join(hint(weighted.select(question_id, "term", "w")), question_id).join(posts.select(id_col, "term", "part"), [id_col, "term"]).groupBy(question_id, id_col).agg(F.sum(F.col("w") * F.col("part")).alias("sum"))
        reached = whole.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select(question_id, (F.col("sum") - _SLACK).alias("reached"))
        low = Window.partitionBy(question_id).orderBy("bound", "term")
        split = weighted.join(reached, question_id, "left").withColumn("upto", F.sum("bound").over(low)).withColumn("idle", F.coalesce(F.col("upto") < F.col("reached"), F.lit(False)))
        split = written(split)
        left = split.groupBy(question_id).agg(F.max("reached").alias("reached"), F.coalesce(F.max(F.when(F.col("idle"), F.col("upto"))), F.lit(0.0)).alias("rest"))
        found = summed(split.where("NOT idle")).join(left, question_id).where(F.col("reached").isNull() | (F.col("sum") + F.col("rest") >= F.col("reached"))).select(question_id, id_col, "sum")
        found = written(found)
        more = found.select(question_id, id_col).join(hint(split.where("idle").select(question_id, "term", "w")), question_id).join(posts.select(id_col, "term", "part"), [id_col, "term"])
        more = more.groupBy(question_id, id_col).agg(F.sum(F.col("w") * F.col("part")).alias("more"))
        scored = found.join(more, [question_id, id_col], "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0.0)))
    scored = scored.select(question_id, id_col, F.round("sum", 4).alias("score"))
    return top_k(scored, question_id, "score", id_col, k).select(question_id, id_col, "score", "rank")
