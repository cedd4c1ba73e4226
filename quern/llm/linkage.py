"""Linking rows by a hashed search and an exact check: shared by the similarity joins.

A signed row has a label, from which its node (a hash) of every tree or hash table follows, and a payload for
the check.  Rows under the same node are candidates.  Candidate pairs are never written out: each
node's rows come together in one task, in pairs of blocks if there are many, and the task returns a
count of links per row and a spanning forest of the links.  A pair under several common nodes is
counted under the first.  Equal rows (one content id) are searched once and weighted.

The search may go on with shorter labels, whose nodes are larger: pairs that met before are left out then.
Where only the classes are wanted, a pair within a class need not be checked: large nodes are
searched by pivots first, and later searches check pairs of different classes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import small_or_not, written

#: Rows of a node that meet in one task; a larger node is split into pairs of blocks, or into blocks that share PIVOTS rows.
BLOCK = 1024
PIVOTS = 64

#: Bins of the similarities of links, of equal width from the threshold to 1.
BINS = 40

#: What a check returns: of a row of a group its number of links there and the least row linked to it, however
#: indirectly; and without a row, how many of the links fall into each bin.
FOUND = "rep long, links long, root long, near array<long>"

Check = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that links (a, b) connect it to."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (runs of equal ``gid``) of a sorted partition."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        gid = batch.column(batch.schema.get_field_index("gid")).to_numpy()
        cut = int(np.searchsorted(gid, gid[-1], "left"))
        if cut == 0 and rest and rest[-1].column(rest[-1].schema.get_field_index("gid"))[-1].as_py() == gid[0]:
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, cut)] if cut else rest
        if done:
            yield pa.Table.from_batches(done).combine_chunks()
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def lists(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def answer(rep: np.ndarray, links: np.ndarray, root: np.ndarray, near: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of FOUND."""
    parts = [pa.array(np.append(x, []).astype(np.int64)) for x in (rep, links, root)]
    bins = pa.nulls(len(rep), pa.list_(pa.int64()))
    if near is not None and near.any():
        parts = [pa.concat_arrays([x, pa.nulls(1, pa.int64())]) for x in parts]
        bins = pa.concat_arrays([bins, pa.array([near.tolist()], pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([*parts, bins], ["rep", "links", "root", "near"])


def check_groups(compare: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], threshold: float) -> Check:
    """A check, group by group: ``compare`` gives the matrices of links and of similarities among payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            gid = t.column("gid").to_numpy()
            rep, copies, tree, lo, hi, own, kind = (t.column(c).to_numpy() for c in ("rep", "copies", "tree", "lo", "hi", "own", "kind"))
            nodes, seen = lists(t.column("nodes")), lists(t.column("seen"))
            payload = t.column("payload")
            edges = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            near = np.zeros(BINS, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                k, before, t0 = nodes[a:b], seen[a:b], int(tree[a])
                # this task answers for pairs whose first common node it is, and for pairs across its blocks, of different classes
                mine = (k[:, None, t0] == k[None, :, t0]) & (kind[a:b, None] != kind[None, a:b])
                for j in range(t0):
                    mine &= k[:, None, j] != k[None, :, j]
                for j in range(before.shape[1]):
                    mine &= before[:, None, j] != before[None, :, j]
                if lo[a] != hi[a]:
                    mine &= own[a:b, None] != own[None, a:b]
                np.fill_diagonal(mine, False)
                some = np.flatnonzero(mine.any(1))
                if not len(some):
                    continue
                linked, similar = compare([payload[a + i].as_py() for i in some.tolist()])
                linked = linked & mine[np.ix_(some, some)]
                hit = linked.any(1)
                if hit.any():
                    x, y = np.nonzero(np.triu(linked, 1))
                    near += np.bincount(np.clip(((similar[x, y] - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
                    links = (linked * copies[a:b][some][None, :]).sum(1)
                    out.append((rep[a:b][some][hit], links[hit], rep[a:b][some][forest(len(some), x, y)][hit]))
            if out:
                yield answer(*[np.concatenate(x) for x in zip(*out, strict=True)], near)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node of its component.

    Alternating large-star and small-star rounds: each reads and writes a table in the shared
    folder, and nothing but a count and a checksum of the edges comes to the driver.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = written(both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def _blocks(thin: DataFrame, classes: bool, first: bool, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rep, tree, own, lo, hi, gid) of the nodes of ``thin`` (rep, kind, tree, node) that may bring a pair, and (n, who) of these nodes."""
    later = classes and not first
    counted = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("kind").alias("low"), F.max("kind").alias("high")]
    each = thin.groupBy("tree", "node").agg(*counted).where("low <> high" if later else "n > 1")
    # nodes with the same rows as a node of an earlier tree bring no further pair
    sizes = each.groupBy("n", "who").agg(F.min(F.struct("tree", "node")).alias("k"))
    if done is not None:
        sizes = sizes.join(done, ["n", "who"], "left_anti")
    sizes = written(sizes.select("k.tree", "k.node", "n", "who"))
    rows = thin.join(small_or_not(sizes.drop("who")), ["tree", "node"])
    if later:  # the largest class of each node that has more than a block
        large = small_or_not(written(sizes.where(F.col("n") > BLOCK).select("tree", "node")))
        most = thin.join(large, ["tree", "node"]).groupBy("tree", "node", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("tree", "node").agg(F.max(F.struct("n", "kind")).alias("most"))
        most = small_or_not(written(most.select("tree", "node", F.col("most.n").alias("n_most"), F.col("most.kind").alias("most"))))
        rows = rows.join(most, ["tree", "node"], "left")
    hashed = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    one = F.lit(0)
    if not classes:
        blocks = count(F.col("n"))
        rows = rows.withColumn("own", hashed(blocks)).withColumn("other", F.explode(F.sequence(one, blocks - 1)))
    elif first:
        blocks = count(F.col("n"))
        pivot = F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("n")) < PIVOTS
        rows = rows.withColumn("own", F.explode(F.when(pivot, F.sequence(one, blocks - 1)).otherwise(F.array(hashed(blocks))))).withColumn("other", F.col("own"))
    else:
        # the largest class of a node is split by itself, and its blocks meet those of the other rows only
        whole, big = F.col("n") <= BLOCK, F.col("kind") == F.col("most")
        few, many = F.greatest(F.lit(1), count(F.col("n") - F.col("n_most"))), F.greatest(F.lit(1), count(F.col("n_most")))
        own = F.when(whole, 0).when(big, few + hashed(many)).otherwise(hashed(few))
        others = F.when(whole, F.array(one)).when(big, F.sequence(one, few - 1)).otherwise(F.sequence(one, few + many - 1))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    placed = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return placed.select("rep", "tree", "own", "lo", "hi", F.xxhash64("tree", "node", "lo", "hi").alias("gid")), sizes.select("n", "who")


def link(signed: DataFrame, check: Check, id_col: str, nodes: Callable[[int], Column], shorter: Callable[[int | None, np.ndarray], int | None], classes: bool = False, labelled: bool = True) -> DataFrame:
    """``signed`` without its signature, with ``n_links`` (other rows linked to it) and ``class_id`` (least id of its component).

    ``signed`` has ``row`` (unique), an id, ``sid`` (null: links with nothing), ``label`` and
    ``payload``, and is a written table.  ``nodes`` gives the nodes (an array) of a length of labels,
    and ``shorter`` the next length to search by, or None, from the last one (at first None) and the
    bins of the links found.  With ``classes`` alone, ``n_links`` is left out.  Unless ``labelled``, checks see the
    payloads alone, without the nodes of all trees beside each.
    """
    spark = signed.sparkSession
    reps = written(signed.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")))
    base = written(signed.select(F.col("row").alias("rep"), "label").join(reps.select("rep", "copies"), "rep"))
    payload = signed.select(F.col("row").alias("rep"), "payload")
    near, last, done = np.zeros(BINS, np.int64), None, None
    found: DataFrame | None = None
    member: DataFrame | None = None
    while (length := shorter(last, near)) is not None:
        first = found is None
        rows = base.withColumn("nodes", nodes(length))
        rows = rows.withColumn("seen", F.array().cast("array<bigint>") if first or classes else nodes(last).cast("array<bigint>"))
        if classes and not first:
            rows = rows.join(member, "rep", "left").withColumn("kind", F.coalesce("root", "rep"))
        else:
            rows = rows.withColumn("kind", F.col("rep"))
        rows = rows.select("rep", "copies", "kind", "nodes", "seen")
        placed, sizes = _blocks(rows.select("rep", "kind", F.posexplode("nodes").alias("tree", "node")), classes, first, done)
        if not classes:  # where all pairs of a node were checked, under it or an earlier one
            done = sizes if done is None else done.unionByName(sizes)
        full = placed.join(rows if labelled else rows.select("rep", "copies"), "rep").join(payload, "rep")
        now = written(full.repartition("gid").sortWithinPartitions("gid").mapInArrow(check, FOUND))
        bins = now.where("near IS NOT NULL").select(F.posexplode("near").alias("bin", "links")).groupBy("bin").agg(F.sum("links")).collect()
        near = near + np.bincount([r[0] for r in bins], [r[1] for r in bins], BINS).astype(np.int64)
        now = now.where("rep IS NOT NULL").select("rep", "links", "root")
        found = now if found is None else found.unionByName(now)
        last = length
        if classes:
            member = written(_members(found))
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, root long")
    per_rep = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = member if member is not None else _members(found)
    named = written(reps.join(member, "rep").groupBy("root").agg(F.min("first_id").alias("class_id")))
    info = (
        reps.join(per_rep, "rep", "left")
        .join(member.join(named, "root").select("rep", "class_id"), "rep", "left")
        .select("sid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_id", "first_id").alias("class_id"))
    )
    info = written(info)
    rest = [c for c in signed.columns if c not in ("label", "payload")]
    linked = (
        signed.select(rest)
        .join(info, "sid", "left")
        .withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "class_id": F.coalesce("class_id", F.col(id_col))})
        .drop("sid")
    )
    return linked.drop("n_links") if classes else linked


def _members(found: DataFrame) -> DataFrame:
    """(rep, root) of every row that has a link."""
    return components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
