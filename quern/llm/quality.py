"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words and runs of punctuation are tokens; single tokens and pairs of neighbours are hashed into
2^18 features, counted, and scaled by the root of their number.  All pairs of equal neighbours are
one feature, whatever the word, and so are those of equal words two apart: stuttering shows in any
vocabulary.  That is a choice made for repeated junk, beside the plain n-grams (``stutter`` turns it off).  Training reads a bounded sample of labelled rows; scoring is one sparse dot product a
document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import absent, table, written
from .words import IS_WORD, NO_GRAM, Words, text_slices

_KIND = IS_WORD.astype(np.uint8)
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 2

_AGAIN, _APART = np.uint64(0x5BD1E995_7F4A7C15), np.uint64(0xC2B2AE3D_27D4EB4F)


@dataclass(frozen=True)
class QualityConfig:
    """``sample``: labelled rows to learn from, at most; ``alpha``, ``beta``, ``l1``, ``l2``: of the updates."""

    bits: int = 18
    stutter: bool = True
    sample: int = 12_000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    threshold: float = 0.3


def _features(data: np.ndarray, offs: np.ndarray, bits: int, stutter: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, documents of theirs, number of features a document) of a slice of texts."""
    words = Words(data, offs, kind=_KIND, lower=False)
    n = len(words.counts)
    doc = words.doc_of()
    h, left = words.hashes, words.left()
    pairs = words.grams(2)
    real = pairs != NO_GRAM
    again = np.flatnonzero((h[:-1] == h[1:]) & (left[:-1] > 1) & stutter)
    pairs[again] = _AGAIN
    apart = np.flatnonzero((h[:-2] == h[2:]) & (left[:-2] > 2) & stutter)
    index = np.concatenate([h, pairs[real], np.full(len(apart), _APART)]) >> np.uint64(64 - bits)
    where = np.concatenate([doc, doc[real], doc[apart]])
    return index.astype(np.int64), where, np.bincount(where, minlength=n)


def _train(config: QualityConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for batch in batches:
            y = np.asarray(batch.column(0)).astype(float)
            for lo, data, offs in text_slices(batch.column(1)):
                index, where, count = _features(data, offs, config.bits, config.stutter)
                order = np.argsort(where, kind="stable")
                parts = np.split(index[order], np.cumsum(count)[:-1])
                for d, part in enumerate(parts):
                    f, c = np.unique(part, return_counts=True)
                    rows.append((np.append(f, 1 << config.bits).astype(np.int32), np.append(c / np.sqrt(max(1, len(part))), 1.0).astype(np.float32), y[lo + d]))
        z, n = np.zeros((1 << config.bits) + 1), np.zeros((1 << config.bits) + 1)

        def weights(zi, ni):
            return np.where(np.abs(zi) <= config.l1, 0.0, (np.sign(zi) * config.l1 - zi) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2))

        for _ in range(config.epochs):
            for f, x, y in rows:
                zi, ni = z[f], n[f]
                w = weights(zi, ni)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                more = ni + g * g
                z[f] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / config.alpha * w
                n[f] = more
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, n).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """The model's weights (float32, the intercept last), of ``config.sample`` labelled rows at most.

    The sample is the labelled ids with the least hashes.  Of an id's several labels the lowest
    counts, and of its several texts the first in order; null ids, labels and unknown ids are left out.
    """
    key, label = absent(docs, "key", "label")
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias(key))
        .agg(F.min(label_col).cast("int").alias(label))
        .orderBy(F.xxhash64(key), key)
        .limit(config.sample)
    )
    # the sample has config.sample rows at most
    rows = docs.select(id_col, text_col).join(F.broadcast(written(chosen)), F.col(id_col) == F.col(key)).groupBy(key, label).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    model = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(1), key)).select(label, "text").mapInArrow(_train(config), "weights binary")
    found = model.collect()
    return bytes(found[0]["weights"]) if found else np.zeros((1 << config.bits) + 1, np.float32).tobytes()


def _score(model: bytes, config: QualityConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(model, np.float32).astype(np.float64)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, data, offs in text_slices(batch.column(1)):
                index, where, count = _features(data, offs, config.bits, config.stutter)
                dot = np.bincount(where, w[index], minlength=len(count)) / np.sqrt(np.maximum(count, 1))
                scores[lo : lo + len(count)] = 1 / (1 + np.exp(-np.clip(dot + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["key", "score"])

    return run


def score(docs: DataFrame, model: bytes, config: QualityConfig = QualityConfig(), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and ``score``: how likely its quality is 1.

    The score depends on the text alone; a null or empty text scores the model's intercept.
    Repeated rows are scored each by itself; other columns are ignored.
    """
    (key,) = absent(docs, "key")
    kind = docs.select(F.struct(*keep).alias(key)).schema[key].dataType.simpleString()
    return docs.select(F.struct(*keep).alias(key), text_col).mapInArrow(_score(model, config), f"key {kind}, score double").select("key.*", "score")


def held_out(id_col: str = "doc_id"):
    """Whether an id is kept from training: crc32 of its text modulo 5 is 0 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op7_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    config = QualityConfig()
    model = train(docs, labels.where(~held_out()), config)
    return score(docs, model, config).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))
