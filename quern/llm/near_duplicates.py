"""N-gram Jaccard join by a MinHash LSH forest.

Each distinct set of five-word shingles gets a label per tree, a string of minima of random
permutations.  Sets whose labels share a prefix meet under one node of that tree's trie.  The search
begins with whole labels and checks all pairs that meet exactly.  The similarities of the links
found tell how many there must be and how many of them a shorter prefix would show, so the prefix is
shortened until the target recall is reached, and each time the pairs that meet newly are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import BINS, check_groups, link
from .spark_io import absent, table, written
from .words import Words, mixed, shingle_sets, text_slices

#: Texts of a group that are checked together, in bytes; longer ones are checked part by part.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class ForestConfig:
    """``num`` / ``den``: the similarity threshold; ``label``: the length of whole labels."""

    shingle: int = 5
    num: int = 4
    den: int = 5
    trees: int = 16
    label: int = 8
    recall: float = 0.9995


def recall_at(similarity: float | np.ndarray, prefix: int, trees: int) -> float | np.ndarray:
    """How likely a pair of this Jaccard similarity shares a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def least_prefix(config: ForestConfig) -> int:
    """The longest prefix at which even pairs exactly at the threshold have the target recall; no shorter one is ever needed."""
    prefix = config.label
    while prefix > 1 and recall_at(config.num / config.den, prefix, config.trees) < config.recall:
        prefix -= 1
    return prefix


def shorter(config: ForestConfig):
    """The length of prefixes to search by next, given the last one and the links found by it, in bins of similarity.

    Links of similarity s that were found with chance p(s) stand for 1 / p(s) links; one more link at the threshold is
    taken to exist, so that a handful of links, or none, says little.  The longest prefix that would show enough of all
    these is next; none is, when the last one did.
    """
    threshold = config.num / config.den
    middle = threshold + (np.arange(BINS) + 0.5) / BINS * (1 - threshold)

    def next_prefix(last: int | None, near: np.ndarray) -> int | None:
        if last is None:
            return config.label
        there = near / recall_at(middle, last, config.trees)
        reached = lambda d: (there @ recall_at(middle, d, config.trees) + recall_at(threshold, d, config.trees)) / (there.sum() + 1)
        least = least_prefix(config)
        if last <= least or reached(last) >= config.recall:
            return None
        return next((d for d in range(last - 1, least, -1) if reached(d) >= config.recall), least)

    return next_prefix


def nodes_at(config: ForestConfig):
    """The nodes, one a tree, that a label's prefixes of some length lead to."""

    def nodes(prefix: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(config.trees - 1)), lambda t: F.xxhash64(t, F.slice("label", t * config.label + 1, prefix)))

    return nodes


def _sign(config: ForestConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(711)
        count = config.trees * config.label
        flip, times = rng.integers(1, 1 << 63, count, np.uint64), rng.integers(1, 1 << 63, count, np.uint64) | np.uint64(1)
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column(0)
            for lo, data, offs in text_slices(batch.column(1)):
                h, bounds = shingle_sets(Words(data, offs), config.shingle)
                n = len(bounds) - 1
                full = np.flatnonzero(np.diff(bounds))
                at = bounds[:-1][full]
                labels = np.zeros((n, count), np.int16)
                sids: list[str | None] = [None] * n
                sizes = np.zeros(n, np.int64)
                packed: list[bytes | None] = [None] * n
                if len(full):
                    x = np.empty_like(h)
                    for i in range(count):
                        np.bitwise_xor(h, flip[i], out=x)
                        x *= times[i]
                        # 16 bits of each minimum; a prefix of several tells sets apart
                        labels[full, i] = (mixed(np.minimum.reduceat(x, at)) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                for d in full.tolist():
                    u = np.unique(h[bounds[d] : bounds[d + 1]])
                    sizes[d] = len(u)
                    sids[d] = f"{int(mixed(u).sum(dtype=np.uint64)):016x}{int(mixed(u ^ flip[0]).sum(dtype=np.uint64)):016x}"
                    packed[d] = zip_.compress(data[offs[d] : offs[d + 1]])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * count + 1, count, dtype=np.int32)), pa.array(labels.ravel()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, n), pa.array(sizes), pa.array(sids, pa.string()), lists, pa.array(packed, pa.binary())], ["key", "n_shingles", "sid", "label", "payload"])

    return run


def _similar(config: ForestConfig):
    """The exact check of a group's texts: intersections counted over the shingles that more than one of them has; links and similarities."""

    def same(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(payloads) > 2 and sum(zstandard.frame_content_size(p) for p in payloads) > PART_BYTES:
            return by_thirds(payloads)
        unzip = zstandard.ZstdDecompressor()
        texts = [unzip.decompress(p) for p in payloads]
        sets = []
        for lo in range(0, len(texts), 64):
            part = texts[lo : lo + 64]
            offs = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            h, bounds = shingle_sets(Words(np.frombuffer(b"".join(part), np.uint8), offs), config.shingle)
            sets += [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(len(part))]
        n = len(sets)
        size = np.array([len(s) for s in sets])
        everything = np.concatenate(sets)
        _, column, times = np.unique(everything, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        row = np.repeat(np.arange(n), size)
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        total = int(shared.sum())
        common = np.zeros((n, n), np.float32)  # counts to 2^24 are exact
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        wide = max(256, (1 << 22) // n)
        for c in range(0, total, wide):
            a, b = np.searchsorted(column, [c, c + wide])
            has = np.zeros((n, min(wide, total - c)), np.float32)
            has[row[a:b], column[a:b] - c] = 1
            common += has @ has.T
        common = common.astype(np.float64)
        union = size[:, None] + size[None, :] - common
        return common * config.den >= union * config.num, common / union

    def by_thirds(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same matrices for texts that are too long together: any pair lies in two of three parts."""
        n = len(payloads)
        out, similar = np.zeros((n, n), bool), np.zeros((n, n))
        parts = np.array_split(np.arange(n), 3)
        for left_out in range(3):
            at = np.concatenate([p for i, p in enumerate(parts) if i != left_out])
            out[np.ix_(at, at)], similar[np.ix_(at, at)] = same([payloads[i] for i in at])
        return out, similar

    return same


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ForestConfig = ForestConfig(), classes: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, n_links, class_id, kept.

    Two rows are linked if their sets of word shingles have a Jaccard similarity of ``num/den``
    or more; ``n_links`` counts the other rows linked to a row, copies included; ``class_id`` is
    the least id among all rows reachable by links, and ``kept`` marks the rows with that id.
    A text of fewer words than a shingle is one shingle; a text without words, or null, links
    with nothing.  Rows that repeat an id are linked like any others.  Other columns are ignored.
    With ``classes``, ``n_links`` is left out, and so is the work of checking pairs within a class: a group of n near
    copies takes little more than n checks instead of n x n.
    """
    row, key = absent(docs, "row", "key")
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id")).alias(key), F.col(text_col))
    signed = keyed.mapInArrow(_sign(config), f"key struct<n: bigint, id: {kind}>, n_shingles long, sid string, label array<smallint>, payload binary")
    signed = written(signed.select(F.col("key.n").alias("row"), F.col("key.id").alias("id"), "n_shingles", "sid", "label", "payload"))
    linked = link(signed, check_groups(_similar(config), config.num / config.den), "id", nodes_at(config), shorter(config), classes)
    links = [] if classes else ["n_links"]
    return linked.select(F.col("id").alias(id_col), "n_shingles", *links, "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
