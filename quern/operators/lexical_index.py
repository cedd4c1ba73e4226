"""A kept inverted index: postings on disk, so that a search reads the postings of its terms and no text.

The index is a list of segments, named by a log of commits (``snapshots``).  A segment holds documents
(id, length, terms), what it adds to or takes from each term's count of documents, the ids that it
takes from earlier segments, and postings: blocks of at most about BLOCK documents of a term, with
the greatest frequency and the least length in them, laid out by bucket of terms and sorted by term.
Upserts and deletes add a segment; ``compact`` makes one of all.  Readers keep the version that they opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from .lexical import asked_terms, score_postings, terms
from .snapshots import SnapshotLog
from .store import small_or_not, written

BLOCK = 1024
#: Terms that are looked up by value, so that Parquet skips pages without them, at most; more are joined.
LITERAL_TERMS = 1_000


class LexicalIndex:
    """An index in a folder; ids are of any one type, and a document has one text (of an id's several rows the least)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.log = SnapshotLog(spark, path)

    def commit(self, number: int | None = None) -> dict | None:
        return self.log.read(number)

    # -- writing

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Adds documents, in place of earlier ones of their ids.  Null ids are left out; a null text has no terms."""
        rows = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
        return self._add(rows.select("id", terms(F.col("text")).alias("terms")), rows.select("id"))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> dict:
        """Takes documents out; ids that the index doesn't have are ignored."""
        if self.commit() is None:
            raise ValueError(f"{self.path} has no version")
        none = ids.limit(0).select(F.col(id_col).alias("id"), F.array().cast("array<string>").alias("terms"))
        return self._add(none, ids.select(F.col(id_col).alias("id")).where("id is not null").distinct())

    def compact(self) -> dict:
        """One segment of all documents, without those that were taken out."""
        return self.log.change(lambda at, commit: self._segment(at, None, self.documents(commit).select("id", "terms"), None))

    def _add(self, docs: DataFrame, ids: DataFrame) -> dict:
        return self.log.change(lambda at, commit: self._segment(at, commit, docs, ids))

    def _segment(self, at: int, commit: dict | None, docs: DataFrame, ids: DataFrame | None) -> dict:
        folder = self.log.folder(at + 1)
        kind = docs.schema["id"].dataType.simpleString()
        docs.select("id", F.size("terms").alias("dl"), "terms").write.parquet(f"{folder}/documents")
        docs = self.spark.read.schema(f"id {kind}, dl int, terms array<string>").parquet(f"{folder}/documents")
        each = docs.select("id", "dl", F.explode("terms").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        each = written(each.withColumn("bucket", self._bucket(F.col("term"))))
        counts = written(each.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")))
        taken_n = taken_words = 0
        changes = counts
        if commit is not None and ids is not None:
            gone = written(self.documents(commit).join(ids, "id", "left_semi"))
            gone.select("id").write.parquet(f"{folder}/removed")
            taken_n, taken_words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            less = gone.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            changes = counts.unionByName(less.withColumn("bucket", self._bucket(F.col("term")))).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        self._lay(changes, ["bucket", "term"], f"{folder}/terms")
        # only terms of more than one block are looked up: a frequent term's postings are dealt by id
        hot = small_or_not(written(counts.where(F.col("df") > BLOCK).select("term", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks"))))
        dealt = each.join(hot, "term", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
        rows = dealt.groupBy("bucket", "term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("p"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
        self._lay(rows, ["bucket", "term", "block"], f"{folder}/postings")
        n, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        before = commit or {"segments": [], "n": 0, "words": 0, "id": kind, "buckets": self.buckets}
        name = folder.rsplit("/", 1)[1]
        return before | {"segments": [*before["segments"], {"data": name, "removed": taken_n}], "n": before["n"] + n - taken_n, "words": before["words"] + words - taken_words}

    def _lay(self, rows: DataFrame, order: list[str], folder: str) -> None:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(folder)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # -- reading

    def documents(self, commit: dict) -> DataFrame:
        """(id, dl, terms) of the documents that are there."""
        kind = commit["id"]
        held = [self.spark.read.schema(f"id {kind}, dl int, terms array<string>").parquet(f"{self.path}/{s['data']}/documents").withColumn("seg", F.lit(i)) for i, s in enumerate(commit["segments"])]
        return self._alive(reduce(DataFrame.unionByName, held), commit).drop("seg")

    def _alive(self, rows: DataFrame, commit: dict) -> DataFrame:
        """Rows (id, seg, ...) but those that a later segment took out."""
        out = [
            self.spark.read.schema(f"id {commit['id']}").parquet(f"{self.path}/{s['data']}/removed").select(F.col("id").alias("gone"), F.lit(i).alias("by"))
            for i, s in enumerate(commit["segments"]) if s["removed"]
        ]
        if not out:
            return rows
        last = small_or_not(written(reduce(DataFrame.unionByName, out).groupBy("gone").agg(F.max("by").alias("by"))))
        return rows.join(last, (F.col("id") == F.col("gone")) & (F.col("by") > F.col("seg")), "left_anti")

    def _looked_up(self, asked: DataFrame, commit: dict, part: str, schema: str) -> DataFrame:
        """A part's rows for the terms of ``asked``, of their buckets alone."""
        buckets = [r[0] for r in asked.select(self._bucket(F.col("term"))).distinct().collect()]  # as many as there are buckets, at most
        first = asked.select("term").limit(LITERAL_TERMS + 1).collect()
        own = [r[0] for r in first] if len(first) <= LITERAL_TERMS else None
        held = []
        for i, s in enumerate(commit["segments"]):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{s['data']}/{part}").where(F.col("bucket").isin(buckets))
            held.append((rows.where(F.col("term").isin(own)) if own is not None else rows).withColumn("seg", F.lit(i)))
        rows = reduce(DataFrame.unionByName, held)
        return rows if own is not None else rows.join(asked, "term", "left_semi")

    def postings(self, asked: DataFrame, commit: dict) -> DataFrame:
        """(id, term, tf, dl) of the terms of ``asked`` (term, each once; a written table, marked for broadcast if it is small)."""
        p = f"p array<struct<id: {commit['id']}, tf: int, dl: int>>"
        blocks = self._looked_up(asked, commit, "postings", f"bucket int, term string, block int, {p}, most_tf int, least_dl int")
        return self._alive(blocks.select("term", "seg", F.inline("p")), commit).select("id", "term", "tf", "dl")

    def frequencies(self, asked: DataFrame, commit: dict) -> DataFrame:
        """(term, df): in how many documents each asked term is."""
        return self._looked_up(asked, commit, "terms", "bucket int, term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, questions: DataFrame, k: int, settings: Settings = SETTINGS, id_col: str = "doc_id", question_id: str = "item_id") -> DataFrame:
        """(question, id, score, rank): the k best documents of every question, exactly as ``lexical.bm25`` finds them."""
        commit = self.commit()
        if commit is None:
            raise ValueError(f"{self.path} has no version")
        asked = written(asked_terms(questions, question_id))
        vocabulary = small_or_not(written(asked.select("term").distinct()))
        posts = written(self.postings(vocabulary, commit).withColumnRenamed("id", id_col))
        return score_postings(posts, asked, commit["n"], commit["words"], k, settings, id_col, question_id, self.frequencies(vocabulary, commit))
