"""Benchmark decontamination by winnowing.

Both sides keep the minimum 5-gram hash of every window of six 5-grams, so any ten
consecutive words that a document shares with a benchmark item share at least one kept
fingerprint (k + w - 1 = 10).  Fingerprints are joined, and each hit is extended word by
word in both directions; runs of ten words or more are contaminated spans.  Items of
fewer than ten words have one fingerprint, of all their words.

Documents' fingerprints first pass a bitmap of the benchmark's (of fixed size, so its
broadcast never grows); the join then decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import absent, small_or_not, table, written
from .words import NO_GRAM, Words, text_slices

GRAM = 5
SPAN = 10
BITS = 22
_SIDE = SPAN - GRAM


def winnowed(words: Words) -> np.ndarray:
    """Which words begin a kept fingerprint: the minima of windows of SPAN - GRAM + 1 grams."""
    g = words.grams(GRAM)
    n, w = len(g), _SIDE + 1
    kept = np.zeros(n, bool)
    if n < w:
        return kept
    low = g[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(low, g[j : n - w + 1 + j], out=low)
    full = words.left()[: n - w + 1] >= SPAN
    for j in range(w):
        kept[j : n - w + 1 + j] |= full & (g[j : n - w + 1 + j] == low)
    return kept


def _rows(words: Words, at: np.ndarray, hashes: np.ndarray, length: int) -> tuple[list, ...]:
    """Of fingerprints of ``length`` words at ``at``: document, place, hash, words before (nearest first), inside and after."""
    doc = np.searchsorted(words.first, at, "right") - 1
    before, inside, after = [], [], []
    for i, d in zip(at.tolist(), doc.tolist(), strict=True):
        lo, hi = int(words.first[d]), int(words.first[d + 1])
        side = _SIDE if length == GRAM else 0
        before.append(words.text(max(lo, i - side), i)[::-1])
        inside.append(words.text(i, i + length))
        after.append(words.text(i + length, min(hi, i + length + side)))
    return doc, at - words.first[doc], hashes[at].view(np.int64), before, inside, after


def _found(words: Words, lengths: list[int], bitmap: np.ndarray | None) -> Iterator[tuple[int, tuple]]:
    """Fingerprints by their number of words: winnowed GRAM-grams as ``0`` and whole short items' lengths."""
    for n in [0, *lengths]:
        g = words.grams(n or GRAM)
        mark = g != NO_GRAM
        if bitmap is not None:
            mark &= bitmap[n][(g & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        if n == 0:
            mark &= winnowed(words)
        at = np.flatnonzero(mark)
        if len(at):
            yield n, _rows(words, at, g, n or GRAM)


_PRINT = "kind int, fp long, place int, before array<string>, inside array<string>, after array<string>"


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, data, offs in text_slices(batch.column(1)):
            words = Words(data, offs)
            for n, (doc, place, fp, *texts) in _by_length(words):
                yield _batch([ids.take(pa.array(doc + lo)), pa.array(np.full(len(doc), n, np.int32)), pa.array(fp), pa.array(place.astype(np.int32)), *texts])


def _by_length(words: Words) -> Iterator[tuple[int, tuple]]:
    """An item of SPAN words or more is winnowed; a shorter one is a fingerprint as a whole."""
    long = _found(words, [], None)
    yield from long
    for n in np.unique(words.counts[(words.counts > 0) & (words.counts < SPAN)]).tolist():
        g = words.grams(n)
        at = words.first[:-1][words.counts == n]
        yield n, _rows(words, at, g, n)


def _batch(columns: list) -> pa.RecordBatch:
    names = ["id", "kind", "fp", "place", "before", "inside", "after"]
    kinds = [None, None, None, None, *[pa.list_(pa.string())] * 3]
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def item_fingerprints(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, kind, fp, place, before, inside, after) of every fingerprint of every item; a null or wordless text has none."""
    kind = benchmark.schema[id_col].dataType.simpleString()
    return benchmark.select(F.col(id_col), F.col(text_col)).mapInArrow(_item_prints, f"id {kind}, {_PRINT}")


def _document_prints(kinds: list[int], bitmaps: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = {k: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for k, b in zip(kinds, bitmaps, strict=True)}
        for batch in batches:
            row = batch.column(0)
            for lo, data, offs in text_slices(batch.column(1)):
                words = Words(data, offs)
                n = len(words.counts)
                none = pa.nulls(n, pa.list_(pa.string()))
                rows = row.slice(lo, n)
                yield pa.RecordBatch.from_arrays([rows, pa.array(words.counts.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), none, none, none], ["row", "n_words", "kind", "fp", "place", "before", "inside", "after"])
                for k, (doc, place, fp, *texts) in _found(words, [x for x in kinds if x], bitmap):
                    lists = [pa.array(x, pa.list_(pa.string())) for x in texts]
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(doc)), pa.nulls(len(doc), pa.int64()), pa.array(np.full(len(doc), k, np.int32)), pa.array(fp), pa.array(place.astype(np.int32)), *lists], ["row", "n_words", "kind", "fp", "place", "before", "inside", "after"])

    return run


def _equal_run(a, b):
    """How many first elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.array_position(same, False) - 1, F.lit(0)).cast("int"), F.size(same)


def _extension(a, b):
    first, n = _equal_run(a, b)
    return F.when(first < 0, n).otherwise(first)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, item_ids (sorted strings), spans, contaminated.

    A word is hit if it lies in an occurrence of ten consecutive words of an item (all words of
    a shorter item).  ``spans`` are the merged hit ranges, in words, end exclusive.  Null and
    wordless texts have no words and no hits; rows with equal ids are judged each by itself; an
    empty benchmark hits nothing.  Other columns of either table are ignored.
    """
    items = written(item_fingerprints(benchmark))
    # one bitmap of 2^BITS bits per kind (ten kinds at most), whatever the size of the benchmark
    slots = (
        items.select("kind", F.col("fp").bitwiseAND((1 << BITS) - 1).alias("bit"))
        .groupBy("kind", F.floor(F.col("bit") / 4096).alias("part"))
        .agg(F.collect_set(F.col("bit") % 4096).alias("bits"))
    )
    bitmaps: dict[int, np.ndarray] = {0: np.zeros(1 << BITS, bool)}
    for r in slots.toLocalIterator():
        bitmaps.setdefault(r["kind"], np.zeros(1 << BITS, bool))[r["part"] * 4096 + np.array(r["bits"], np.int64)] = True
    kinds = sorted(bitmaps)
    packed = [np.packbits(bitmaps[k]).tobytes() for k in kinds]

    row, key = absent(docs, "row", "key")
    keyed = docs.select(F.monotonically_increasing_id().alias(row), F.col(id_col).alias(key), F.col(text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    # a row per document and one per fingerprint that the bitmaps let pass; written, so that a row's number is the same whoever reads it
    prints = written(
        keyed.select(F.struct(F.col(row).alias("n"), F.col(key).alias("id")).alias("row"), text_col).mapInArrow(
            _document_prints(kinds, packed), f"row struct<n: bigint, id: {id_type}>, n_words long, {_PRINT}"
        )
    )
    # what many items share, with the words around it, is one place that bears all their ids
    places = items.groupBy("kind", "fp", "before", "inside", "after").agg(F.sort_array(F.collect_set(F.col("id").cast("string"))).alias("items"))
    places = small_or_not(written(places.select("items", *[F.col(c).alias(f"i_{c}") for c in ("kind", "fp", "before", "inside", "after")])))
    hits = prints.join(places, (F.col("kind") == F.col("i_kind")) & (F.col("fp") == F.col("i_fp")) & (F.col("inside") == F.col("i_inside")), "left")
    back, on = _extension(F.col("before"), F.col("i_before")), _extension(F.col("after"), F.col("i_after"))
    start, end = F.col("place") - F.col("back"), F.col("place") + F.size("inside") + F.col("on")
    real = F.col("items").isNotNull() & ((F.col("kind") > 0) | (F.col("back") + F.col("on") + GRAM >= SPAN))
    spans = (
        hits.where(F.col("n_words").isNotNull() | F.col("items").isNotNull())
        .withColumns({"back": back, "on": on})
        .select("row", "n_words", F.when(real, F.col("items")).alias("items"), F.when(real, F.struct(start.alias("s"), end.alias("e"))).alias("span"))
        .groupBy("row")
        .agg(F.max("n_words").alias("n_words"), F.collect_set("items").alias("items"), F.sort_array(F.collect_set("span")).alias("found"))
    )
    merged = F.expr(
        "aggregate(found, cast(array() as array<struct<s: int, e: int>>), (m, x) -> CASE "
        "WHEN size(m) > 0 AND x.s <= element_at(m, -1).e THEN concat(slice(m, 1, size(m) - 1), array(named_struct('s', element_at(m, -1).s, 'e', greatest(element_at(m, -1).e, x.e)))) "
        "ELSE concat(m, array(x)) END)"
    )
    # words counted by the same sweep without the array, in time linear in the spans
    n_hit = F.expr("aggregate(found, named_struct('n', 0L, 'e', 0), (m, x) -> named_struct('n', m.n + greatest(0, x.e - greatest(x.s, m.e)), 'e', greatest(m.e, x.e)), m -> m.n)")
    item_ids = F.array_sort(F.array_distinct(F.flatten("items")))
    return spans.select(
        F.col("row.id").alias(id_col),
        F.col("n_words"),
        n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"),
        merged.alias("spans"),
        (F.size("found") > 0).alias("contaminated"),
    )


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p, w FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM iw),
lens AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dg.n, p FROM dg JOIN ig USING (n, g)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
