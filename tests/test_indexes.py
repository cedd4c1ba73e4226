"""Kept indexes: the same results as searches that read everything, and only what is asked for read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import dense, lexical
from quern.operators.lexical_index import LexicalIndex
from quern.operators.vector_index import CellConfig, VectorIndex
from quern.plans import catalogue, kept


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [1024, 8])
def test_index_finds_what_bm25_finds_through_changes(spark, tmp_path, monkeypatch, block):
    from quern.operators import lexical_index

    monkeypatch.setattr(lexical_index, "BLOCK", block)  # frequent terms in several blocks
    rng = random.Random(block)
    words = lambda n: " ".join(f"r{rng.randrange(300)}" if rng.random() < 0.3 else rng.choice(["the", "of", "and", "to"]) for _ in range(n))
    docs = {i: words(rng.randrange(1, 60)) for i in range(200)} | {300: None, 301: "", 302: "the the"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(i, words(8)) for i in range(20)] + [(90, "the of"), (91, "nowhere"), (92, None)], "item_id long, text string")
    index = LexicalIndex(spark, str(tmp_path / "index"), buckets=8)
    index.upsert(frame(docs))
    check = lambda: rows(index.search(asked, 5)) == rows(lexical.bm25(frame(docs), asked, 5))
    assert check()
    new = {i: words(20) for i in [3, 4, 5, 400, 401]}
    docs |= new
    index.upsert(frame(new))
    assert check()
    index.delete(spark.createDataFrame([(i,) for i in [4, 7, 8, 999]], "doc_id long"))
    docs = {i: t for i, t in docs.items() if i not in (4, 7, 8)}
    assert check()
    back = {7: "the word of rare7", 3: "of"}
    docs |= back
    index.upsert(frame(back))
    assert check()
    before = index.commit()
    assert before["n"] == len(docs) and len(before["segments"]) == 4
    after = index.compact()
    assert len(after["segments"]) == 1 and after["n"] == before["n"] and after["words"] == before["words"] and check()
    # what is known of terms is what a count of all postings tells
    posts = lexical.postings(frame(docs))
    terms = posts.select("term").distinct()
    assert rows(index.frequencies(terms, after)) == rows(lexical.idf_stats(posts).select("term", "df")) == rows(index.frequencies(terms, before))
    assert index.search(asked.limit(0), 5).count() == 0


def test_a_search_reads_only_its_terms(spark, sf):
    index = kept.document_index(spark, sf)
    assert index is kept.document_index(spark, sf)
    commit = index.commit()
    some = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(lexical.terms(F.col("text"))).alias("term")).groupBy("term").count().orderBy("count", "term").limit(3).select("term")
    posts = index.postings(spark.createDataFrame(some.collect(), "term string"), commit)
    everything = spark.read.parquet(f"{index.path}/{commit['segments'][0]['data']}/postings")
    assert 0 < len(posts.inputFiles()) <= len(everything.inputFiles())
    plan = posts._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    assert set(r[0] for r in posts.select("term").distinct().collect()) == {r[0] for r in some.collect()}


def test_a_cleared_index_is_made_anew(spark, sf):
    import shutil

    index = kept.document_index(spark, sf)
    shutil.rmtree(index.path)
    again = kept.document_index(spark, sf)
    assert again is not index and again.commit()["n"] == index.spark.read.parquet(f"{sf}/documents.parquet").count()
    assert kept.document_index(spark, sf) is again


def test_empty_indexes(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "l"))
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame([(1, "a")], "item_id long, text string"), 5)
    index.upsert(spark.createDataFrame([], "doc_id long, text string"))
    assert index.search(spark.createDataFrame([(1, "a")], "item_id long, text string"), 5).count() == 0
    cells = VectorIndex(spark, str(tmp_path / "v"))
    cells.build(spark.createDataFrame([], "id long, v array<double>"))
    assert cells.search(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), 5).count() == 0


def recall(approximate, exact):
    found = {(r["query_id"], r["id"]) for r in approximate.collect()}
    true = {(r["query_id"], r["id"]) for r in exact.collect()}
    return len(found & true) / len(true)


def test_cells_find_the_nearest_and_read_little(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(60, 32))
    x = middles[rng.integers(0, 60, 6_000)] + 0.4 * rng.normal(size=(6_000, 32))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9_000, None), (9_001, [0.0] * 32), (9_002, [float("nan")] * 32), (9_003, [1.0])]
    vectors = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    index = VectorIndex(spark, str(tmp_path / "v"), CellConfig(sample=2_000))
    commit = index.build(vectors)
    asked = vectors.where("id % 20 = 0")
    assert recall(index.search(asked, 20), dense.nearest(asked, vectors, 20)) >= 0.95
    held = {r["cell"]: r["n"] for r in index.blocks(commit).groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect()}
    assert sum(held.values()) == 6_000  # every vector is in a cell
    assert commit["probe"] * max(held.values()) < 3_000 and commit["probe"] * 6_000 / commit["cells"] < 1_500
    # all cells probed: exact
    assert rows(index.search(asked, 20, probe=commit["cells"])) == rows(dense.nearest(asked, vectors, 20))


def test_recall_on_the_given_vectors(spark, sf):
    assert recall(catalogue.QUERIES["ivf_topk"](spark, sf), catalogue.QUERIES["dense_topk"](spark, sf)) >= 0.95


def test_nearest_by_dealt_blocks_is_nearest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(300)], "id long, v array<double>").repartition(5)
    near = rows(dense.nearest(v, v, 7))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dense, "PART_BLOCKS", 1)
    assert rows(dense.nearest(v, v, 7)) == near


def test_a_pair_of_blocks_holds_the_scores_of_few_queries(spark):
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(0).normal(size=(dense.BLOCK, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = pa.array([np.arange(len(x))], pa.list_(pa.int64()))
    pair = pa.RecordBatch.from_arrays([pa.array([64], pa.int32()), ids, pa.array([x.tobytes()]), ids, pa.array([x.tobytes()])], ["dim", "qids", "qdata", "ids", "data"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(dense._nearest(20)(iter([pair]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and found.num_rows == 20 * len(x)
    q = 4_000  # of the last queries
    best = np.argsort(-np.round(x[q] @ x.T, 6), kind="stable")[:20]
    assert [r["id"] for r in found.to_pylist() if r["query_id"] == q] == best.tolist()


def test_texts_of_documents_are_not_shuffled_to_few_hits(spark, sf):
    from quern.plans import search

    hits = spark.createDataFrame([(1, 0), (1, 2)], "item_id long, doc_id long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = search._of_documents(hits, docs)
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
