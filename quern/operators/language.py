"""Language identification by character trigrams, learned from documents whose language is told.

A language's profile is how likely each trigram of its words is (a word begins and ends with a blank).  Learning reads a bounded
sample of documents a language; a text has the language under which its trigrams are likeliest.  Words are
cut once for all texts of a batch, and profiles are a small table, so that no trigram is shuffled to score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, small_or_not, written

#: Documents of a language that are learned from, and trigrams that profiles hold, at most.
SAMPLE, GRAMS = 2_000, 20_000
#: Languages that a text has a sum each for, at most.
MOST_LANGUAGES = 100


def _words(text: Column) -> Column:
    """The lower-cased runs of letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"), lambda w: w != "")


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def gram_counts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, gram, n): how often each key's texts have each trigram."""
    words = docs.select(key, F.explode(_words(F.col(text_col))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(key, "n", F.explode(_grams(F.col("word"))).alias("gram")).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, grams: int = GRAMS) -> DataFrame:
    """(lang, gram, weight): the log of a trigram's share in the language, of the ``grams`` most frequent trigrams, all languages with all of them.

    The sample is each language's ids with the least MD5 digests.  Null languages and ids are left out.
    """
    least = Window.partitionBy(lang_col).orderBy(F.md5(F.col(id_col).cast("string")), id_col)
    told = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = written(told.select(id_col, lang_col).withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= sample).drop("_n").distinct())
    counts = written(gram_counts(told.join(small_or_not(chosen), [id_col, lang_col], "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "lang"))
    common = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(grams).select("gram")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # languages x grams: bounded by the languages told
    every = totals.join(F.broadcast(written(common).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")
    return every.join(counts, ["lang", "gram"], "left").select("lang", "gram", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + grams)).alias("weight"))


def _likelihoods(keys: np.ndarray, weights: np.ndarray, names: list[str]):
    """Sums of ``weights`` (trigrams x languages; trigrams by ``keys``, ascending) over each text's words, and how many of its trigrams count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            sizes = np.diff(held.offsets.to_numpy())
            words = held.flatten().dictionary_encode()
            own, code = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy()
            chars = np.frombuffer((" " + " ".join(words.dictionary.to_pylist()) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
            blank = chars == 32
            middle = np.flatnonzero(~blank)  # a word has a trigram around each of its letters
            word = np.cumsum(blank)[middle] - 1
            grams = _key(chars[middle - 1], chars[middle], chars[middle + 1]) if len(middle) else middle
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            known = keys[at] == grams
            at, word = at[known], word[known]
            per_text = lambda of_word: np.bincount(own, of_word[code], minlength=len(sizes)).astype(np.float64)  # noqa: B023, E731
            in_all = lambda x: per_text(np.bincount(word, x, minlength=len(words.dictionary)))  # noqa: B023, E731
            sums = [in_all(weights[at, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(in_all(np.ones(len(at))).astype(np.int64)), *map(pa.array, sums)], ["id", "n", *names])

    return run


def _key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a << 42) | (b << 21) | c


def _best(scored: DataFrame, id_col: str) -> DataFrame:
    """(id, detected, margin) of ``scored`` (id, r): r are the languages and their scores, negated, the likeliest first."""
    return scored.select(id_col, F.col("r")[0]["lang"].alias("detected"), F.round(F.coalesce(F.get("r", F.lit(1))["dear"] - F.col("r")[0]["dear"], F.lit(0.0)), 6).alias("margin"))


def detected(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, detected, margin) of every id: the likeliest language and by how much a trigram it is likelier than the next, ``und`` without trigrams that a profile holds.

    ``known`` are ``profiles``, written.  Trigrams that no profile holds count for no language; of equally likely languages the
    first in order is taken.  Rows of one id are one text.  Small profiles travel to the tasks, which send on a sum for each
    language of a text; with larger ones, or where a language lacks trigrams, trigrams are joined.
    """
    dear = lambda of: (-F.round(of / F.col("n"), 6)).alias("dear")
    langs = [r[0] for r in known.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    rows, grams = known.agg(F.count(F.lit(1)), F.count_distinct("gram")).first()
    plain = known.where((F.char_length("gram") != 3) | F.col("lang").isNull() | F.col("weight").isNull()).isEmpty()
    if 0 < rows <= BROADCAST_ROWS and len(langs) <= MOST_LANGUAGES and rows == len(langs) * grams and plain:
        told = known.orderBy("gram", "lang").toArrow()
        chars = np.frombuffer("".join(told.column("gram").to_pylist()[:: len(langs)]).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
        keys, weights = _key(*chars.T), told.column("weight").to_numpy().reshape(-1, len(langs))
        order = np.argsort(keys)
        names = [f"s{i}" for i in range(len(langs))]
        kind = docs.schema[id_col].dataType.simpleString()
        sums = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words")).mapInArrow(_likelihoods(keys[order], weights[order], names), f"id {kind}, n long, {', '.join(f'{s} double' for s in names)}")
        whole = sums.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        scored = whole.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.array_sort(F.array(*[F.struct(dear(F.col(s)), F.lit(x).alias("lang")) for s, x in zip(names, langs, strict=True)]))).alias("r"))
        return _best(scored, id_col).select(id_col, F.coalesce("detected", F.lit("und")).alias("detected"), F.coalesce("margin", F.lit(0.0)).alias("margin"))
    counted = gram_counts(docs, id_col, text_col).join(small_or_not(known), "gram")
    scored = counted.groupBy(id_col, "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("sum"), F.sum("n").alias("n"))
    ranked = scored.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(dear(F.col("sum")), "lang"))).alias("r"))
    return docs.select(id_col).distinct().join(_best(ranked, id_col), id_col, "left").select(id_col, F.coalesce("detected", F.lit("und")).alias("detected"), F.coalesce("margin", F.lit(0.0)).alias("margin"))
