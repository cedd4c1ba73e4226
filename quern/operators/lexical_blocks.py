"""Postings in blocks of documents, scored against blocks of questions: what a search shuffles is its best documents alone.

A block holds the postings of some thousand documents, by term.  Nothing is shuffled to make it, and a document's
score is whole within its block, so pairs of a question and a document never leave the task that scores them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms and documents of a block, at most; a document of more terms is a block of its own.
BLOCK_TERMS, BLOCK_DOCS = 2 << 20, 1 << 16
#: Questions of a block, and blocks of questions that are sent to a block of documents together.
BLOCK_QUESTIONS, GROUP_BLOCKS = 2048, 16
#: Pairs of a question and a document that have a sum at once, and postings that are added at once, but for a question of more.
CELLS, ADDED = 1 << 20, 1 << 18
#: What rounding and the order of sums may add to a score.
SLACK = 1e-3


def _block(ids: pa.Array, sizes: np.ndarray, flat: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    order = pc.sort_indices(ids)  # so that the first of equal scores has the least id
    place = np.empty(n, np.int64)
    place[order.to_numpy()] = np.arange(n)
    held = flat.dictionary_encode()
    keys = held.indices.to_numpy().astype(np.int64)
    keys *= n
    keys += np.repeat(place, sizes)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    tfs = np.diff(first, append=len(keys))
    tfs = tfs.astype(np.min_scalar_type(tfs.max(initial=0)))
    term, doc = np.divmod(keys[first], n)
    counts = np.bincount(term, minlength=len(held.dictionary)).astype(np.int32)
    dls = sizes[order.to_numpy()].astype(np.int32)
    row = [
        pa.array([uuid.uuid4().hex]), pa.array([n], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.take(order)), pa.array([dls.tobytes()], pa.binary()),
        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), held.dictionary), pa.array([counts], pa.list_(pa.int32())), pa.array([doc.astype(np.uint16).tobytes()], pa.binary()), pa.array([tfs.tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(row, ["block", "n", "words", "ids", "dls", "terms", "counts", "docs", "tfs"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, held = batch.column(0), batch.column(1)
        ends = held.offsets.to_numpy()
        lo = 0
        while lo < len(ids):
            hi = min(max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + BLOCK_TERMS, "right")) - 1), lo + BLOCK_DOCS, len(ids))
            yield _block(ids.slice(lo, hi - lo), np.diff(ends[lo : hi + 1]).astype(np.int64), held.values.slice(ends[lo], ends[hi] - ends[lo]))
            lo = hi


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, n, words, ids, dls, terms, counts, docs, tfs) of ``docs`` (id, terms; each id once)."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "terms").mapInArrow(_blocks, f"block string, n long, words long, ids array<{kind}>, dls binary, terms array<string>, counts array<int>, docs binary, tfs binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            rows = batch.column(1)[r].values
            ids = pc.unique(rows.field("q"))
            at = pc.index_in(rows.field("q"), value_set=ids).to_numpy()
            held = rows.field("term").dictionary_encode()
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(ids) + 1)).astype(np.int32)
            floors = np.zeros(len(ids))
            floors[at] = rows.field("floor").fill_null(0.0).to_numpy()
            row = [
                batch.column(0).slice(r, 1), pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([ends.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(held.dictionary)], pa.int32()), held.dictionary),
                pa.array([held.indices.to_numpy()[order].astype(np.int32).tobytes()], pa.binary()), pa.array([rows.field("w").to_numpy()[order].tobytes()], pa.binary()), pa.array([floors.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, ["nth", "qblock", "qids", "qends", "qterms", "qcodes", "qws", "qfloors"])


def in_question_blocks(weighted: DataFrame, question_id: str) -> DataFrame:
    """(nth, asked) of ``weighted`` (question, term, w, floor), a written table: groups of blocks of questions; no document below a question's floor is looked for."""
    kind = weighted.schema[question_id].dataType.simpleString()
    blocks = -(-weighted.select(question_id).distinct().count() // BLOCK_QUESTIONS)
    each = weighted.select(F.pmod(F.xxhash64(question_id), F.lit(max(1, blocks))).alias("part"), F.struct(F.col(question_id).alias("q"), "term", "w", "floor").alias("row"))
    packed = each.groupBy("part").agg(F.collect_list("row").alias("rows")).mapInArrow(_packed, f"nth long, qblock string, qids array<{kind}>, qends binary, qterms array<string>, qcodes binary, qws binary, qfloors binary")
    return packed.groupBy(F.expr(f"nth div {GROUP_BLOCKS}").alias("nth")).agg(F.collect_list(F.struct("qblock", "qids", "qends", "qterms", "qcodes", "qws", "qfloors")).alias("asked"))


class _Postings:
    """A block's postings by term, with what each adds to a score of weight 1."""

    def __init__(self, ids: pa.Array, dls: np.ndarray, terms: pa.Array, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, k1: float, b: float, avgdl: float):
        self.ids, self.terms, self.docs, self.n = ids, terms, docs, len(ids)
        self.ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.parts = (k1 * (1 - b + b * dls / avgdl))[docs]  # and in place from here on, as these are the largest arrays
        self.parts += tfs
        np.divide(tfs, self.parts, out=self.parts)
        self.parts *= k1 + 1
        self.most = np.maximum.reduceat(self.parts, self.ends[:-1]) if len(counts) else np.zeros(0)
        self.keys = np.repeat(np.arange(len(counts)) * self.n, counts)  # of a term and a document, in order
        self.keys += docs
        self.sums = np.zeros(max(CELLS, self.n))

    def best(self, at: np.ndarray, ws: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(questions, documents, scores): of each question the k best documents of those that reach its floor, which rises to the k-th.

        ``own`` are the questions of the terms ``at`` and their weights.  Documents that hold only terms that can't reach the floor
        together are never touched, and what others have is looked up until they can't reach it.
        """
        most = ws * self.most[at]
        order = np.lexsort((-most, own))
        at, ws, own, most = at[order], ws[order], own[order], most[order]
        ends = np.searchsorted(own, np.arange(len(floors) + 1))
        upto = np.concatenate([[0.0], np.cumsum(most)])
        needed = upto[ends[own + 1]] - upto[:-1] >= floors[own] - SLACK  # what a term and all after it can add
        mids = ends[:-1] + np.bincount(own[needed], minlength=len(floors))
        at_most = upto[ends[1:]] - upto[mids]
        sizes = np.where(needed, self.ends[at + 1] - self.ends[at], 0)
        added = np.concatenate([[0], np.cumsum(sizes)])[ends]
        lo = 0
        while lo < len(floors):
            hi = min(lo + max(1, CELLS // max(1, self.n)), max(lo + 1, int(np.searchsorted(added, added[lo] + ADDED, "right")) - 1), len(floors))
            if added[hi] > added[lo]:
                reach = floors[lo:hi] - SLACK - at_most[lo:hi]
                q, docs, sums = self._summed(at[ends[lo] : ends[hi]], ws[ends[lo] : ends[hi]], own[ends[lo] : ends[hi]] - lo, sizes[ends[lo] : ends[hi]], reach, floors[lo:hi] <= SLACK, k)
                q += lo
                q, docs, sums = self._whole(q, docs, sums, at, ws, upto, mids[q], ends[q + 1], floors)
                scores = np.floor(sums * 1e4 + 0.5) / 1e4
                held = (floors[q] <= 0) | (scores >= floors[q] - SLACK)
                q, docs, scores = q[held], docs[held], scores[held]
                order = np.lexsort((docs, -scores, q))
                q, docs, scores = q[order], docs[order], scores[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                last = nth == k - 1
                floors[q[last]] = np.maximum(floors[q[last]], scores[last])
                if len(q):
                    yield q[nth < k], docs[nth < k], scores[nth < k]
            lo = hi

    def _summed(self, at: np.ndarray, ws: np.ndarray, own: np.ndarray, sizes: np.ndarray, reach: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(questions, documents, sums) of the sums that reach ``reach``; of questions that are ``free``, and so summed whole, only the k best and their equals."""
        total, n = int(sizes.sum()), self.n
        place = np.arange(total)
        place += np.repeat(self.ends[at] - np.cumsum(sizes) + sizes, sizes)
        docs, q = self.docs[place], np.repeat(own, sizes)
        cells = q * n
        cells += docs
        parts = self.parts[place]
        parts *= np.repeat(ws, sizes)
        held = self.sums[: len(reach) * n]
        np.add.at(held, cells, parts)
        if n > k and free.any():
            reach = reach.copy()
            reach[free] = np.maximum(reach[free], np.partition(held.reshape(-1, n)[free], n - k, axis=1)[:, n - k] - SLACK)
        sums = held[cells]
        found = np.flatnonzero(sums >= reach[q])
        held[cells[found]] = found  # of a pair's several postings the last counts
        found = found[held[cells[found]] == found]
        held[cells] = 0
        return q[found], docs[found].astype(np.int64), sums[found]

    def _whole(self, q: np.ndarray, docs: np.ndarray, sums: np.ndarray, at: np.ndarray, ws: np.ndarray, upto: np.ndarray, nexts: np.ndarray, ends: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a question and a document with their whole sums, without those that can't reach the floor; ``nexts`` to ``ends`` are the terms not yet added."""
        whole = []
        while len(q):
            left = (nexts < ends) & (sums + (upto[ends] - upto[nexts]) >= floors[q] - SLACK)
            over = nexts == ends
            whole.append((q[over], docs[over], sums[over]))
            q, docs, sums, nexts, ends = q[left], docs[left], sums[left], nexts[left], ends[left]
            key = at[nexts] * self.n + docs
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            sums = sums + np.where(self.keys[i] == key, ws[nexts] * self.parts[i], 0.0)
            nexts = nexts + 1
        return tuple(map(np.concatenate, zip(*whole, strict=True))) if whole else (q, docs, sums)


def _scored(k: int, k1: float, b: float, avgdl: float, question_id: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        reached: dict[str, np.ndarray] = {}  # by block of questions: what the k-th best document reaches, so far
        for batch in batches:
            for r in range(batch.num_rows):
                col = {c: batch.column(c)[r] for c in batch.schema.names}
                if name != col["block"].as_py():
                    name, block = col["block"].as_py(), None  # of two blocks, one is held
                    docs = np.frombuffer(col["docs"].as_buffer(), np.uint16)
                    tfs = np.frombuffer(col["tfs"].as_buffer(), f"u{col['tfs'].as_buffer().size // max(1, len(docs)) or 1}")
                    block = _Postings(col["ids"].values, np.frombuffer(col["dls"].as_buffer(), np.int32), col["terms"].values, col["counts"].values.to_numpy(), docs, tfs, k1, b, avgdl)
                asked = {c: [x[c] for x in col["asked"]] for c in ("qblock", "qids", "qends", "qterms", "qcodes", "qws", "qfloors")}
                places = pc.fill_null(pc.index_in(pa.concat_arrays([x.values for x in asked["qterms"]]), value_set=block.terms), -1).to_numpy()
                first = 0
                for i, qblock in enumerate(asked["qblock"]):
                    get = lambda c, kind: np.frombuffer(asked[c][i].as_buffer(), kind)  # noqa: B023, E731
                    qids = asked["qids"][i].values
                    floors = reached.setdefault(qblock.as_py(), get("qfloors", np.float64).copy())
                    at = places[first : first + len(asked["qterms"][i].values)][get("qcodes", np.int32)].astype(np.int64)
                    first += len(asked["qterms"][i].values)
                    there = at >= 0
                    own = np.repeat(np.arange(len(qids)), np.diff(get("qends", np.int32)))
                    for q, found, scores in block.best(at[there], get("qws", np.float64)[there], own[there], floors, k):
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), block.ids.take(pa.array(found)), pa.array(scores)], [question_id, id_col, "score"])

    return run


def scored(pairs: DataFrame, k: int, k1: float, b: float, avgdl: float, question_id: str, id_col: str) -> DataFrame:
    """(question, id, score) of pairs of a block of documents and a group of blocks of questions: of each pair the k best of every question at least, of those that can be among the k best of all."""
    ids, asked = pairs.schema["ids"].dataType.elementType, pairs.schema["asked"].dataType.elementType["qids"].dataType.elementType
    columns = pairs.select("block", "ids", "dls", "terms", "counts", "docs", "tfs", "asked")
    return columns.mapInArrow(_scored(k, k1, b, avgdl, question_id, id_col), f"`{question_id}` {asked.simpleString()}, `{id_col}` {ids.simpleString()}, score double")
