"""Quality rules: two fixed rules, and gradient-boosted trees over statistics of a document.

Statistics are counted by numpy for a slice of documents at once.  The trees are grown level by
level on histograms, from a bounded sample of labelled documents; features of ``FALLING`` can only
lower a score as they rise: a split of one whose right side scored higher is not taken, and the
middle of a split's two values bounds all that grows below its sides.  The fitted trees are flat
arrays of nodes, walked by all documents and trees of a slice together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .spark_io import absent, table, written
from .words import NO_GRAM, Words, mixed, text_slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20  # words; per cent of words in repeated windows

_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_IN_LINE = np.ones(256, bool)
_IN_LINE[0x0A] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "digits", "marks", "stutter", "top_word", "line_words")
#: Features that can only lower a score.
FALLING = ("symbols", "dup_lines", "repeats", "stutter")


@dataclass(frozen=True)
class RuleConfig:
    """``sample``: labelled rows to learn from, at most; ``threshold``: the least chance of quality that is kept."""

    sample: int = 12_000
    trees: int = 40
    depth: int = 4
    bins: int = 64
    rate: float = 0.3
    smooth: float = 1.0
    least: float = 2.0
    threshold: float = 0.3


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: a node with feature -1 is a leaf of ``value``; else ``left`` and ``left + 1`` follow it, the latter above ``cut``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int


def _per_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _sorted_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): an order that brings equal values of one document together, and whether each equals the one before."""
    key = value ^ mixed(doc.astype(np.uint64))  # 64 bits tell the values of a slice apart
    order = np.argsort(key)
    same = np.zeros(len(order), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    return order, same


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each document of a slice of UTF-8 texts, as COUNTS and FEATURES name them."""
    n = len(offs) - 1
    solid = _SOLID[data]
    points = (data & 0xC0) != 0x80
    words = Words(data, offs, kind=_SOLID, lower=False)
    doc = words.doc_of()
    symbols = _per_document(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offs)
    word_chars = _per_document(solid & points, offs)

    lines = Words(data, offs, kind=_IN_LINE, lower=False)
    told = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=told[1:])
    worded = told[lines.ends] > told[lines.starts]
    line_doc = lines.doc_of()[worded]
    n_lines = np.bincount(line_doc, minlength=n)
    order, same = _sorted_pairs(line_doc, lines.hashes[worded])
    dup_lines = np.bincount(line_doc[order][same], minlength=n)

    grams = words.grams(WINDOW)
    at = np.flatnonzero(grams != NO_GRAM)
    order, same = _sorted_pairs(doc[at], grams[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(grams) + WINDOW + 1, np.int64)
    starts = at[order[twice]]
    cover[starts] += 1  # windows begin at different words
    cover[starts + WINDOW] -= 1
    repeated = np.cumsum(cover)[: len(grams)] > 0
    repeats = np.bincount(doc[repeated], minlength=n)

    order, same = _sorted_pairs(doc, words.hashes)
    distinct = words.counts - np.bincount(doc[order][same], minlength=n)
    runs = np.flatnonzero(~same)
    top = np.zeros(n, np.int64)
    if len(runs):
        np.maximum.at(top, doc[order][runs], np.diff(np.append(runs, len(order))))
    stutter = np.bincount(doc[1:][(words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)

    n_words = words.counts.astype(np.int64)
    per_word, per_char, per_line = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    capitals = _per_document((data >= 65) & (data <= 90), offs)
    digits = _per_document((data >= 48) & (data <= 57), offs)
    marks = _per_document(np.isin(data, np.frombuffer(b"!\"'(),-./:;?[]_{}~^=+\\@`", np.uint8)), offs)
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    features = np.stack(
        [
            np.log1p(n_words), word_chars / per_word, symbols / per_word, dup_lines / per_line, repeats / per_word, distinct / per_word, capitals / per_char, digits / per_char,
            marks / per_char, stutter / per_word, top / per_word, n_words / per_line,
        ], 1,
    )
    return counts, features


def fit(x: np.ndarray, y: np.ndarray, config: RuleConfig = RuleConfig(), falling: tuple[str, ...] = FALLING) -> Forest:
    """Trees of logistic loss; the first holds the sample's own odds.  No examples make a forest of chance one half."""
    feature, cut, left, value, roots = [-1], [0.0], [0], [0.0], [0]

    def forest() -> Forest:
        return Forest(np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(value), config.depth)

    if not len(y):
        return forest()
    rate = (y.sum() + 1) / (len(y) + 2)
    value[0] = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, config.bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    down = np.array([f in falling for f in FEATURES])
    width = config.bins + 1
    raw = np.full(len(y), value[0])
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        grown = np.zeros(len(y), np.int64)  # the node of each row
        roots.append(len(feature))
        level = [(len(feature), np.arange(len(y)), -np.inf, np.inf)]
        feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
        for depth in range(config.depth + 1):
            below = []
            for node, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = config.rate * float(np.clip(-gs / (hs + config.smooth), low, high))
                grown[rows] = node
                if depth == config.depth:
                    continue
                best = (1e-6, -1, 0, 0.0, 0.0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.bincount(binned[rows, f], g[rows], width).cumsum()[: len(c)]
                    hl = np.bincount(binned[rows, f], h[rows], width).cumsum()[: len(c)]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + config.smooth), low, high), np.clip(-gr / (hr + config.smooth), low, high)
                    # the loss saved by the sides' own (bounded) values
                    gain = -(gl * vl + (hl + config.smooth) * vl**2 / 2) - (gr * vr + (hr + config.smooth) * vr**2 / 2)
                    gain += gs * value[node] / config.rate + (hs + config.smooth) * (value[node] / config.rate) ** 2 / 2
                    gain[(hl < config.least) | (hr < config.least) | (down[f] & (vr > vl))] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
                _, f, k, vl, vr = best
                if f < 0:
                    continue
                feature[node], cut[node], left[node] = f, float(cuts[f][k]), len(feature)
                middle = (vl + vr) / 2
                right_side = binned[rows, f] > k
                bounds = [(middle, high), (low, middle)] if down[f] else [(low, high), (low, high)]
                for side, (lo, hi) in zip((rows[~right_side], rows[right_side]), bounds, strict=True):
                    below.append((len(feature), side, lo, hi))
                    feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
            level = below
        raw += np.array(value)[grown]
    return forest()


def chances(forest: Forest, x: np.ndarray) -> np.ndarray:
    """How likely each row's quality is 1."""
    node = np.tile(forest.roots, (len(x), 1))
    rows = np.arange(len(x))[:, None]
    for _ in range(forest.depth):
        f = forest.feature[node]
        node = np.where(f >= 0, forest.left[node] + (x[rows, np.maximum(f, 0)] > forest.cut[node]), node)
    return 1 / (1 + np.exp(-np.clip(forest.value[node].sum(1), -35, 35)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offs in text_slices(batch.column(1)):
            _, x = statistics(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(x)], pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Trees of ``config.sample`` labelled rows at most, whose statistics alone come to the driver (a dozen numbers a row).

    The sample is the labelled ids with the least hashes.  Of an id's several labels the lowest
    counts, and all its rows are learned from, up to the sample's size; null ids, labels and unknown ids are left out.
    """
    key, label = absent(docs, "key", "label")
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias(key)).agg(F.min(label_col).cast("int").alias(label))
        .orderBy(F.xxhash64(key), key).limit(config.sample)
    )
    # the sample has config.sample rows at most
    rows = docs.select(id_col, text_col).join(F.broadcast(written(chosen)), F.col(id_col) == F.col(key)).select(label, text_col)
    found = rows.mapInArrow(_features, "label int, x array<double>").orderBy("x", "label").limit(config.sample).collect()
    return fit(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["label"] for r in found], float), config)


def _judge(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, scores = np.zeros((batch.num_rows, len(COUNTS)), np.int64), np.zeros(batch.num_rows)
            for lo, data, offs in text_slices(batch.column(1)):
                c, x = statistics(data, offs)
                counts[lo : lo + len(c)], scores[lo : lo + len(c)] = c, chances(forest, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T], pa.array(scores)], ["key", *COUNTS, "score"])

    return run


def judge(docs: DataFrame, forest: Forest, config: RuleConfig = RuleConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, COUNTS, score, base_failed, kept.

    A word is a run of characters but white space; a line counts if it has a word, and is a repeat if
    an earlier one is equal; words of a five-word window that the text holds twice count as repeated.
    ``base_failed``: under MIN_WORDS words, or over MAX_REPEAT per cent of them repeated; such a row is not
    kept, others are if their score, of the text alone, reaches the threshold.  A null text is
    empty; rows with equal ids are judged each by itself; other columns are ignored.
    """
    (key,) = absent(docs, "key")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *[f"{c} long" for c in COUNTS], "score double"])
    told = docs.select(F.col(id_col).alias(key), text_col).mapInArrow(_judge(forest), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return told.select(F.col("key").alias(id_col), *COUNTS, "score", failed.alias("base_failed"), (~failed & (F.col("score") >= config.threshold)).alias("kept"))


def op13_monotone_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, by trees of the labelled ones that aren't held out; edge cases are ``judge``'s."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, train(docs, labels.where(~held_out())))
