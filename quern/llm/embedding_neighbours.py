"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1; each hash table takes the floors of several Gaussian
projections, shifted at random and divided by a bucket width.  Vectors in the same bucket of
some table are checked by exact cosine in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import answer, forest, groups, link
from .spark_io import absent, table, written
from .words import mixed


@dataclass(frozen=True)
class PStableConfig:
    """``width``: of a bucket; ``chance``: how many unrelated (orthogonal) vectors a bucket may
    hold by chance; ``recall``: of pairs exactly at the threshold."""

    cosine: float = 0.9
    width: float = 2.0
    chance: int = 128
    recall: float = 0.99


def collision(distance: float, width: float) -> float:
    """How likely one projection puts two vectors at this Euclidean distance into one interval."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, config: PStableConfig) -> tuple[int, int]:
    """(projections a table, tables) for this many rows.

    A table takes as many projections as keep chance collisions at ``chance`` a bucket, which
    grows with the logarithm of the rows; the tables then follow from the recall.
    """
    near, far = collision(math.sqrt(2 - 2 * config.cosine), config.width), collision(math.sqrt(2), config.width)
    projections = max(4, math.ceil(math.log(max(1, rows) / config.chance) / -math.log(far))) if rows > config.chance else 4
    return projections, max(1, math.ceil(math.log(1 - config.recall) / math.log(1 - near**projections)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Tables:
    """The buckets of unit vectors in all tables; the projections of a dimension are made once."""

    def __init__(self, projections: int, tables: int, width: float):
        self.projections, self.tables, self.width = projections, tables, width
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        if dim not in self.planes:
            rng = np.random.default_rng([405, dim])
            self.planes[dim] = rng.standard_normal((dim, self.projections * self.tables)), rng.uniform(0, self.width, self.projections * self.tables)
        a, shift = self.planes[dim]
        out = np.empty((len(x), self.tables), np.int32)
        for lo in range(0, len(x), 2048):
            cells = np.floor((x[lo : lo + 2048] @ a + shift) / self.width).astype(np.int64).view(np.uint64).reshape(-1, self.tables, self.projections)
            h = np.full(cells.shape[:2], dim, np.uint64)
            for j in range(self.projections):
                h = mixed(h + cells[:, :, j])
            out[lo : lo + 2048] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def _sign(projections: int, tables: int, config: PStableConfig, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Tables(projections, tables, config.width)
        for batch in batches:
            n = batch.num_rows
            vectors = batch.column(1)
            size = np.asarray(vectors.value_lengths().fill_null(0)) if n else np.zeros(0, int)
            sids: list[str | None] = [None] * n
            payload: list[bytes | None] = [None] * n
            nodes = np.zeros((n, tables), np.int32)
            for dim in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == dim)
                flat = vectors.take(pa.array(at)).flatten()
                x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
                ok = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[ok], x[ok]
                if not len(at):
                    continue
                nodes[at] = buckets(_unit(x))
                for i, v in zip(at.tolist(), x, strict=True):
                    payload[i] = (v + 0.0).astype(kind).tobytes()
                    sids[i] = hashlib.blake2b(payload[i], digest_size=16).hexdigest()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32)), pa.array(nodes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.string()), lists, pa.array(payload, pa.binary())], ["key", "sid", "label", "payload"])

    return run


#: Rows up to which groups are compared many at a time, filled up to a power of two; numbers compared at once.
_SMALL, _AT_ONCE = 64, 1 << 22


def _pairs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of rows of one group whose cosine reaches the threshold; ``x`` holds unit vectors."""
    for n in sorted(set((1 << np.ceil(np.log2(sizes[(sizes > 1) & (sizes <= _SMALL)])).astype(int)).tolist())):
        some = np.flatnonzero((sizes > n // 2) & (sizes <= n) & (sizes > 1))
        step = max(1, _AT_ONCE // (n * max(n, x.shape[1])))
        for lo in range(0, len(some), step):
            at = starts[some[lo : lo + step]][:, None] + np.arange(n)
            real = np.arange(n) < sizes[some[lo : lo + step]][:, None]
            rows = np.where(real[:, :, None], x[np.minimum(at, len(x) - 1)], 0.0)
            g, i, j = np.nonzero(np.matmul(rows, rows.transpose(0, 2, 1)) >= cosine)
            up = (i < j) & real[g, i] & real[g, j]
            yield at[g[up], i[up]], at[g[up], j[up]]
    for start, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        step = max(1, _AT_ONCE // n)
        for lo in range(0, n, step):
            i, j = np.nonzero(x[start + lo : min(start + n, start + lo + step)] @ x[start : start + n].T >= cosine)
            up = i + lo < j
            yield start + lo + i[up], start + j[up]


def _check(config: PStableConfig, kind: type, projections: int, tables: int):
    """The exact check: cosines in double precision, of many groups at a time; a pair counts under its first common bucket.

    Buckets of other tables don't travel with the vectors: they are worked out anew for those that have a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Tables(projections, tables, config.width)
        for t in groups(batches):
            rep, copies, tree, lo, hi, own = (t.column(c).to_numpy() for c in ("rep", "copies", "tree", "lo", "hi", "own"))
            gid = t.column("gid").to_numpy()
            payload = t.column("payload").to_pylist()
            length = np.array([len(p) for p in payload])
            first, second = [np.zeros(0, int)], [np.zeros(0, int)]
            for size in np.unique(length):  # vectors of different sizes are never compared
                at = np.flatnonzero(length == size)
                x = _unit(np.frombuffer(b"".join([payload[i] for i in at.tolist()]), kind).astype(np.float64).reshape(len(at), -1))
                edge = np.flatnonzero(np.r_[True, gid[at][1:] != gid[at][:-1], True])
                for i, j in _pairs(x, edge[:-1], np.diff(edge), config.cosine):
                    # each pair once a group: of several blocks, only across two of them
                    across = (lo[at[i]] == hi[at[i]]) | (own[at[i]] != own[at[j]])
                    i, j = i[across], j[across]
                    linked, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                    nodes = buckets(x[linked])
                    step = _AT_ONCE // tables + 1
                    for part in range(0, len(i), step):
                        a, b = i[part : part + step], j[part : part + step]
                        na, nb = nodes[place[: len(i)][part : part + step]], nodes[place[len(i) :][part : part + step]]
                        here = tree[at[a]]
                        earlier = (na == nb) & (np.arange(tables) < here[:, None])
                        mine = ~earlier.any(1)
                        first.append(at[a[mine]])
                        second.append(at[b[mine]])
            a, b = np.concatenate(first), np.concatenate(second)
            if not len(a):
                continue
            links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
            root, hit = rep[forest(len(rep), a, b)], links > 0
            yield answer(rep[hit], links[hit], root[hit])

    return run


def embedding_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: PStableConfig = PStableConfig()) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows are linked if their cosine is at least the threshold; ``component_id`` is the least id
    reachable by links, ``kept`` marks the rows with that id.  A vector that is null, zero, empty or
    holds null or non-finite components links with nothing, and vectors of different sizes never link.
    Rows that repeat an id are compared like any others.  Other columns are ignored.
    """
    projections, tables = table_plan(vectors.select(id_col).count(), config)
    (key,) = absent(vectors, "key")
    kind = vectors.schema[id_col].dataType.simpleString()
    stored = np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64
    keyed = vectors.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id")).alias(key), F.col(vector_col))
    signed = keyed.mapInArrow(_sign(projections, tables, config, stored), f"key struct<n: bigint, id: {kind}>, sid string, label array<int>, payload binary")
    signed = written(signed.select(F.col("key.n").alias("row"), F.col("key.id").alias("id"), "sid", "label", "payload"))
    once = lambda last, near: tables if last is None else None
    linked = link(signed, _check(config, stored, projections, tables), "id", lambda n: F.col("label"), once, labelled=False)
    return linked.select(F.col("id").alias(id_col), "n_links", F.col("class_id").alias("component_id"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op9_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS m FROM e UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n WHERE r.m < l.b),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
