"""Dense search: a pluggable encoder, a portable default, and exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from .lexical import terms, top_k
from .store import BROADCAST_BYTES, written

#: Prefixes of what is embedded; lexical search takes the bare text.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "

#: Vectors of a block; a task multiplies one block of queries with one of vectors.
BLOCK = 4096
#: Queries of a block that are multiplied at once.
TILE = 256
#: Blocks of vectors that a part holds, where blocks of queries are copied to parts.
PART_BLOCKS = 8


class Encoder(Protocol):
    def __call__(self, texts: DataFrame, id_col: str, prefix: str) -> DataFrame:
        """(id, vector) of ``texts`` (id, text); ``prefix`` tells a model whether it sees a query or a passage."""


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Encoder:
    """An encoder of a model: ``load`` runs once a task and returns what turns a list of texts into rows of vectors.  A null text has no vector."""

    def encode(texts: DataFrame, id_col: str, prefix: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                own = [t is not None for t in batch.column(1).to_pylist()]
                ids, found = batch.column(0).filter(pa.array(own, pa.bool_())), [prefix + t for t in batch.column(1).to_pylist() if t is not None]
                if found:
                    vectors = pa.array(np.asarray(model(found), np.float64).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([ids, vectors], [id_col, "vector"])

        kind = texts.schema[id_col].dataType.simpleString()
        return texts.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, vector array<double>")

    return encode


def hashed_encoder(texts: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """The default encoder; a bag of words has no use for the prefix."""
    return bucket_vectors(texts, id_col)


def bucket_weights(docs: DataFrame, id_col: str, text_col: str = "text", dim: int = SETTINGS.dense_dim) -> DataFrame:
    """(id, bucket, weight): the default encoder's vectors as rows, without zeros.

    The default encoder counts terms in ``dim`` buckets of an MD5 digest and scales to length 1, so
    any engine with MD5 computes the same vector.  Counting is one aggregation of exploded terms, most of it before the shuffle.
    """
    each = docs.select(id_col, F.explode(terms(F.col(text_col))).alias("t")).select(id_col, (F.conv(F.substring(F.md5("t"), 1, 6), 16, 10).cast("int") % dim).alias("bucket"))
    counted = each.groupBy(id_col, "bucket").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norm = counted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counted.join(norm, id_col).select(id_col, "bucket", (F.col("c") / F.col("norm")).alias("weight"))


def _summed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            sizes = np.diff(held.offsets.to_numpy())
            own = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(own * dim + held.flatten().to_numpy(), minlength=len(sizes) * dim).astype(np.float64)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(counts), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], ["id", "vector"])

    return run


def bucket_vectors(docs: DataFrame, id_col: str, text_col: str = "text", dim: int = SETTINGS.dense_dim) -> DataFrame:
    """(id, vector): the default encoder's counts as dense arrays, without a shuffle; texts without terms are left out."""
    bucket = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dim
    rows = docs.select(F.col(id_col).alias("id"), F.transform(terms(F.col(text_col)), bucket).alias("buckets")).where(F.size("buckets") > 0)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_summed(dim), f"id {kind}, vector array<double>").withColumnRenamed("id", id_col)


def unit_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, unit vectors) of the batch's (id, vector) rows, by length; rows that are null, empty, zero or not finite, or hold nulls, are left out."""
    ids, held = batch.column(0), batch.column(1)
    sizes = np.zeros(len(held), np.int64)
    told = ~(ids.is_null().to_numpy(zero_copy_only=False) | held.is_null().to_numpy(zero_copy_only=False))
    offsets = held.offsets.to_numpy()
    sizes = np.where(told, np.diff(offsets), 0)
    values = held.values.cast(pa.float64()).fill_null(np.nan).to_numpy()
    keys = ids.fill_null(0).to_numpy().astype(np.int64)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = values[offsets[at][:, None] + np.arange(dim)]
        norms = np.sqrt((x * x).sum(1))
        good = np.isfinite(x).all(1) & x.any(1)
        yield int(dim), keys[at][good], x[good] / norms[good][:, None]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of unit vectors."""
    for batch in batches:
        for dim, ids, x in unit_rows(batch):
            for lo in range(0, len(ids), BLOCK):
                part = x[lo : lo + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[lo : lo + BLOCK]], pa.list_(pa.int64())), pa.array([part.tobytes()], pa.binary())], ["dim", "ids", "data"])


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, qids, qdata, ids, data = batch.column(0)[r].as_py(), *(batch.column(c)[r] for c in range(1, 5))
                every, x = (np.frombuffer(c.as_buffer()).reshape(-1, dim) for c in (qdata, data))
                asked, ids = qids.values.to_numpy(), ids.values.to_numpy()
                order = np.argsort(ids, kind="stable")  # so that the first of equal scores has the least id
                ids, x = ids[order], x[order]
                for lo in range(0, len(asked), TILE):  # so that a task holds the scores of few queries at once
                    qids, sims = asked[lo : lo + TILE], every[lo : lo + TILE] @ x.T
                    np.round(sims, 6, out=sims)
                    if len(ids) > k:
                        # what reaches the k-th best of each query, ties included
                        cut = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k, None]
                        rows, at = np.nonzero(sims >= cut)
                    else:
                        rows, at = (i.ravel() for i in np.indices(sims.shape))
                    scores = sims[rows, at]
                    best = np.lexsort((at, -scores, rows))
                    rows, at, scores = rows[best], at[best], scores[best]
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    keep = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(qids[rows[keep]]), pa.array(ids[at[keep]]), pa.array(scores[keep])], ["query_id", "id", "score"])

    return run


def nearest_in_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of every pair of blocks (dim, qids, qdata, ids, data)."""
    return pairs.select("dim", "qids", "qdata", "ids", "data").mapInArrow(_nearest(k), "query_id long, id long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of greatest cosine of every query; both sides are (id, vector).

    Exact.  Rows are packed into blocks first, so the product is of blocks; every pair of blocks
    is one matrix product that keeps k rows a query.  Blocks of queries are broadcast if they are counted to be small;
    else they are dealt to as many parts as the blocks of vectors need.
    """
    schema = "dim int, ids array<long>, data binary"
    q = written(queries.mapInArrow(_packed, schema)).select("dim", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    x = vectors.mapInArrow(_packed, schema)
    if (q.agg(F.sum(F.octet_length("qdata") + 8 * F.size("qids"))).first()[0] or 0) <= BROADCAST_BYTES:
        pairs = x.join(F.broadcast(q), "dim")
    else:
        x = written(x)
        parts = max(1, x.count() // PART_BLOCKS)
        dealt = x.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        pairs = dealt.join(q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["dim", "part"])
    return top_k(nearest_in_pairs(pairs, k), "query_id", "score", "id", k)
