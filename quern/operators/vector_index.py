"""A kept inverted-file index: vectors laid out by cell, so that a search reads the cells near its queries.

Cells are those of a spherical k-means of a bounded sample; every vector lies in the cell of its
nearest centre, in blocks of one folder per cell.  A search probes the nearest cells of each query and
compares exactly within them.  How many cells are probed is told by the sample: the least number that finds
``recall`` of the true neighbours there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import BLOCK, nearest_in_pairs, unit_rows
from .lexical import top_k
from .snapshots import SnapshotLog
from .store import small_or_not, written


@dataclass(frozen=True)
class CellConfig:
    """``sample``: vectors that centres are learned from, at most, and ``numbers`` in them; ``cells``: at most (the root of the count otherwise);
    ``asked``: sample rows that tell how many cells to probe; ``recall``: what they must find of their ``depth`` nearest."""

    sample: int = 20_000
    numbers: int = 8_000_000
    cells: int = 4_096
    rounds: int = 10
    asked: int = 500
    depth: int = 20
    recall: float = 0.98


def centres(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Unit centres of unit rows; a centre that loses all its rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        own, best = sims.argmax(1), sims.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-300), c)
    return c


def probes(x: np.ndarray, c: np.ndarray, config: CellConfig) -> int:
    """The least number of cells that find ``recall`` of the sample's own nearest rows."""
    own = (x @ c.T).argmax(1)
    asked = x[: config.asked]
    depth = min(config.depth, len(x))
    near = np.argpartition(-(asked @ x.T), depth - 1, axis=1)[:, :depth]
    # how many cells must be probed to reach each true neighbour
    place = np.empty((len(asked), len(c)), np.int64)
    order = np.argsort(-(asked @ c.T), axis=1)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1)
    found = np.bincount(needed.ravel(), minlength=len(c)).cumsum() / needed.size
    return int(np.searchsorted(found, config.recall)) + 1


def _assigned(c: np.ndarray, probe: int):
    """(cell, id, data) of each vector, for its ``probe`` nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in unit_rows(batch):
                if dim != c.shape[1]:
                    continue
                for lo in range(0, len(ids), BLOCK):
                    part = x[lo : lo + BLOCK]
                    sims = part @ c.T
                    cells = np.argpartition(-sims, probe - 1, axis=1)[:, :probe] if probe < len(c) else np.tile(np.arange(len(c)), (len(part), 1))
                    data = [r.tobytes() for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.ravel().astype(np.int32)), pa.array(np.repeat(ids[lo : lo + BLOCK], cells.shape[1])), pa.array([d for d in data for _ in range(cells.shape[1])], pa.binary())], ["cell", "id", "data"]
                    )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring rows of one cell."""
    for batch in batches:
        cells = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
        bounds = [lo for a, b in zip(starts, [*starts[1:], len(cells)], strict=True) for lo in range(int(a), int(b), BLOCK)] if len(cells) else []
        ends = [*bounds[1:], len(cells)]
        if bounds:
            ids, data = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cells[lo]) for lo in bounds], pa.int32()), pa.array([len(data[lo]) // 8 for lo in bounds], pa.int32()), pa.array([ids[lo:hi] for lo, hi in zip(bounds, ends, strict=True)], pa.list_(pa.int64())), pa.array([b"".join(data[lo:hi]) for lo, hi in zip(bounds, ends, strict=True)], pa.binary())],
                ["cell", "dim", "ids", "data"],
            )


class VectorIndex:
    """An index of (id, vector) rows with long ids, in a folder; what is no vector (null, zero, not finite, of another length) is left out."""

    def __init__(self, spark: SparkSession, path: str, config: CellConfig = CellConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.log = SnapshotLog(spark, path)

    def build(self, vectors: DataFrame) -> dict:
        """Lays out all rows of ``vectors`` (id, vector), in place of what was there."""
        id_col, column = vectors.columns
        rows = vectors.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
        n, dim = rows.agg(F.count(F.lit(1)), F.mode(F.size("vector"))).first()
        size = max(1, min(self.config.sample, self.config.numbers // max(1, dim or 1)))
        # the sample: the rows with the least hashes
        held = rows.where(F.size("vector") == (dim or 0)).orderBy(F.xxhash64("id"), "id").limit(size).toArrow().combine_chunks()
        found = [x for batch in held.to_batches() for _, _, x in unit_rows(batch)]
        x = np.concatenate(found) if found else np.zeros((0, dim or 1))
        cells = max(1, min(self.config.cells, round(n**0.5), len(x)))
        c = centres(x, cells, self.config.rounds) if len(x) else np.zeros((1, dim or 1))
        probe = probes(x, c, self.config) if len(x) else 1

        def write(at: int, _: dict | None) -> dict:
            folder = self.log.folder(at + 1)
            dealt = rows.mapInArrow(_assigned(c, 1), "cell int, id long, data binary").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
            dealt.mapInArrow(_blocks, "cell int, dim int, ids array<long>, data binary").write.partitionBy("cell").parquet(f"{folder}/blocks")
            self.spark.createDataFrame([(c.tobytes(),)], "centres binary").write.parquet(f"{folder}/centres")
            return {"data": folder.rsplit("/", 1)[1], "dim": dim or 1, "cells": len(c), "probe": probe, "n": n}

        return self.log.change(write)

    def blocks(self, commit: dict) -> DataFrame:
        return self.spark.read.schema("dim int, ids array<long>, data binary, cell int").parquet(f"{self.path}/{commit['data']}/blocks")

    def search(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): of the rows in each query's nearest cells, the k of greatest cosine; ``queries`` are (id, vector) rows."""
        commit = self.log.read()
        if commit is None:
            raise ValueError(f"{self.path} has no version")
        c = np.frombuffer(self.spark.read.parquet(f"{self.path}/{commit['data']}/centres").first()[0]).reshape(-1, commit["dim"])
        id_col, column = queries.columns
        asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
        dealt = asked.mapInArrow(_assigned(c, min(probe or commit["probe"], len(c))), "cell int, id long, data binary").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        q = written(dealt.mapInArrow(_blocks, "cell int, dim int, ids array<long>, data binary").select("cell", F.col("ids").alias("qids"), F.col("data").alias("qdata")))
        near = [r[0] for r in q.select("cell").distinct().collect()]  # as many as there are cells, at most
        pairs = self.blocks(commit).where(F.col("cell").isin(near)).join(small_or_not(q), "cell")
        return top_k(nearest_in_pairs(pairs, k), "query_id", "score", "id", k)
