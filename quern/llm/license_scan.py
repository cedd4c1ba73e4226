"""License scans by diagonal voting, with DataFrame functions only.

All rolling three-word grams of every text are hashed, and those that occur in a set of license templates are
joined to their places there.  A match at document word p and template word t lies on the diagonal
p - t; matches vote for their diagonal, and neighbouring diagonals merge (so a copy with a few words
put in or left out still counts as one).  Spans are then verified: the template's words that the
matched grams align with, each counted once, must be enough of the template, and the grams that
decide between licenses and versions must be among them.  Of spans that overlap, the best
aligned stays.  Short phrases must match word for word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import PHRASES, TEMPLATES
from .spark_io import absent, table, written

GRAM = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ScanConfig:
    """``coverage``: the share of a template's words that a span must align with; ``gap``: how far
    apart, in words, neighbouring diagonals may be that merge; ``stretch``: how long a span may be, in lengths of the template."""

    coverage: float = 0.6
    gap: int = 3
    stretch: float = 1.5


def words_of(text):
    """The lower-cased words of a text; none of a null text."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(split, lambda w: w != "")


def _template_words() -> list[tuple[int, str, bool, list[str], set[int]]]:
    """(number, label, whether a phrase, words, the grams that decide) of phrases and templates."""
    words = lambda text: re.findall("[0-9a-z]+", text.lower())
    out = []
    for label, text, exact, decides in [*((v, k, True, ()) for k, v in PHRASES.items()), *((a, b, False, c) for a, b, c in TEMPLATES)]:
        ws = words(text)
        grams: set[int] = set()
        for phrase in decides:
            ps = words(phrase)
            at = next(i for i in range(len(ws)) if ws[i : i + len(ps)] == ps)
            grams |= set(range(at, at + len(ps) - GRAM + 1))
        out.append((len(out), label, exact, ws, grams))
    return out


_GRAMS = [
    (t, label, exact, len(ws) - GRAM + 1, len(ws), len(decides), p, p in decides, " ".join(ws[p : p + GRAM]))
    for t, label, exact, ws, decides in _template_words()
    for p in range(len(ws) - GRAM + 1)
]
_LONGEST = max(row[3] for row in _GRAMS)


def _template_grams(spark: SparkSession) -> DataFrame:
    """A row per gram and template: fixed values, as many for any input."""
    return spark.createDataFrame(_GRAMS, "t int, label string, exact boolean, n_grams int, n_words int, n_deciding int, place int, deciding boolean, gram string")


def _scan(docs: DataFrame, id_col: str, text_col: str, config: ScanConfig) -> tuple[DataFrame, DataFrame]:
    """(n, id, n_words) of every row, and (n, start, words, label, exact, score) of every span."""
    n, key, w = absent(docs, "n", "key", "w")
    grams = _template_grams(docs.sparkSession)
    hashes = [r[0] for r in grams.select(F.xxhash64(*[F.split("gram", " ")[i] for i in range(GRAM)])).distinct().collect()]  # of fixed values
    split = docs.select(F.monotonically_increasing_id().alias(n), F.col(id_col).alias(key), words_of(F.col(text_col)).alias(w))
    word = lambda i, j: F.get(w, i + j)
    places = F.when(F.size(w) >= GRAM, F.sequence(F.lit(0), F.size(w) - GRAM)).otherwise(F.array().cast("array<int>"))
    hit = F.filter(places, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).isin(hashes))
    # words are strings again only where a hash is one of the templates'
    shown = lambda i: F.struct(i.alias("at"), F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("gram"))
    found = split.select(F.col(n).alias("n"), F.col(key).alias("id"), F.col(w), hit.alias("hit"))
    found = written(found.select("n", "id", F.size(w).cast("long").alias("n_words"), F.transform("hit", shown).alias("hits")))
    votes = found.select("n", F.explode("hits").alias("h")).select("n", F.col("h.at").alias("at"), F.col("h.gram").alias("gram"))
    votes = votes.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    order = Window.partitionBy("n", "t").orderBy("diagonal", "at")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("exact"), 0).otherwise(config.gap)).cast("int"), F.lit(1))
    banded = votes.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a band that is too long for one copy is cut where the template's words don't go on
    limit = F.col("n_grams") * config.stretch + config.gap
    band = Window.partitionBy("n", "t", "band")
    along = band.orderBy("at", "place")
    too_long = ~F.col("exact") & (F.max("at").over(band) - F.min("at").over(band) > limit)
    cut = banded.withColumn("cut", F.coalesce((too_long & (F.col("place") <= F.lag("place").over(along))).cast("int"), F.lit(0)))
    cut = cut.withColumn("piece", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut.groupBy("n", "t", "label", "exact", "n_grams", "n_words", "n_deciding", "band", "piece").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("places"), F.size(F.collect_set(F.when(F.col("deciding"), F.col("place")))).alias("decided")
    )
    aligned = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (GRAM - 1))))))
    spans = spans.withColumn("aligned", aligned).withColumn("score", F.col("aligned") / F.col("n_words"))
    whole = F.size("places") == F.col("n_grams")
    verified = (F.col("score") >= config.coverage) & (F.col("hi") - F.col("lo") <= limit) & (F.col("decided") == F.col("n_deciding"))
    spans = spans.where(F.when(F.col("exact"), whole).otherwise(verified))
    # spans that overlap begin within the longest span of each other
    reach = int(_LONGEST * config.stretch) + config.gap + GRAM
    near = Window.partitionBy("n", "exact").orderBy("lo").rangeBetween(-reach, reach)
    rank = F.struct("aligned", "score", (-F.col("t")).alias("t"), "lo", "hi")
    best = spans.withColumn("rank", rank).withColumn("near", F.when(F.col("exact"), F.array().cast("array<struct<aligned: int, score: double, t: int, lo: int, hi: int>>")).otherwise(F.collect_list("rank").over(near)))
    better = F.exists("near", lambda o: (o["lo"] < F.col("hi") + GRAM) & (F.col("lo") < o["hi"] + GRAM) & (o > F.col("rank")))
    kept = best.where(~better)
    return found.select("n", "id", "n_words"), kept.select("n", F.col("lo").cast("long").alias("start"), (F.col("hi") - F.col("lo") + GRAM).cast("long").alias("words"), "label", "exact", "score")


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """One row per span: id, row (a number for each row of ``docs``), start, words, label, exact, score.

    ``start`` counts words from 0.  An exact span is a phrase, word for word, with score 1;
    another span's score is the share of its template's words that it aligns with.  Null and
    wordless texts have no spans; rows with equal ids are scanned each by itself; other columns are ignored.
    """
    rows, spans = _scan(docs, id_col, text_col, config)
    return rows.join(spans, "n").select(F.col("id").alias(id_col), F.col("n").alias("row"), "start", "words", "label", "exact", "score")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score: its spans in short.

    The base are the exact spans.  A row without spans has no labels (empty strings), null places and score 0; null
    and wordless texts have no words; rows with equal ids are scanned each by itself; other columns are ignored.
    """
    rows, spans = _scan(docs, id_col, text_col, config)
    base = F.when(F.col("exact"), F.col("start"))
    short = spans.groupBy("n").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("score").alias("score")
    )
    shown = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    return rows.join(short, "n", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", shown("base_labels"), shown("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same scan in SQL: grams, diagonals, bands, pieces, verified spans, the best of those that overlap."""
    c = ScanConfig()
    values = ", ".join(f"({t}, '{label}', {str(exact).lower()}, {n_grams}, {n_words}, {n_deciding}, {p}, {str(deciding).lower()}, '{gram}')" for t, label, exact, n_grams, n_words, n_deciding, p, deciding, gram in _GRAMS)
    limit = f"n_grams * {c.stretch} + {c.gap}"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tg AS (SELECT * FROM (VALUES {values}) AS v(t, label, exact, n_grams, n_words, n_deciding, place, deciding, gram)),
dg AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {GRAM}], ' ') AS gram
       FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {GRAM - 1}, 0))) AS pos FROM d)),
v AS (SELECT *, pos - place AS diagonal FROM dg JOIN tg USING (gram)),
f AS (SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal, pos) > CASE WHEN exact THEN 0 ELSE {c.gap} END AS INT), 1) AS fresh FROM v),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS band FROM f),
l AS (SELECT *, NOT exact AND max(pos) OVER (PARTITION BY doc_id, t, band) - min(pos) OVER (PARTITION BY doc_id, t, band) > {limit} AS long,
             place <= lag(place) OVER (PARTITION BY doc_id, t, band ORDER BY pos, place) AS back FROM b),
q AS (SELECT *, sum(CAST(coalesce(long AND back, false) AS INT)) OVER (PARTITION BY doc_id, t, band ORDER BY pos, place ROWS UNBOUNDED PRECEDING) AS piece FROM l),
s AS (SELECT doc_id, t, label, exact, n_grams, n_words, n_deciding, min(pos) AS lo, max(pos) AS hi, count(DISTINCT place) AS n_places, count(DISTINCT place) FILTER (deciding) AS decided,
             len(list_distinct(flatten(list([place, place + 1, place + 2])))) AS aligned
      FROM q GROUP BY doc_id, t, label, exact, n_grams, n_words, n_deciding, band, piece),
k AS (SELECT *, CAST(aligned AS DOUBLE) / n_words AS score FROM s
      WHERE CASE WHEN exact THEN n_places = n_grams ELSE CAST(aligned AS DOUBLE) / n_words >= {c.coverage} AND hi - lo <= {limit} AND decided = n_deciding END),
z AS (SELECT * FROM k AS m WHERE exact OR NOT EXISTS (SELECT 1 FROM k AS o WHERE o.doc_id = m.doc_id AND NOT o.exact AND o.lo < m.hi + {GRAM} AND m.lo < o.hi + {GRAM}
      AND (o.aligned, o.score, -o.t, o.lo, o.hi) > (m.aligned, m.score, -m.t, m.lo, m.hi))),
g AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(lo) FILTER (exact) AS first_word, max(lo) FILTER (exact) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM z GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = _oracle()
