"""The pipeline's stages against plain Python, each on its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quern.llm import mixing, quality

from . import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{name}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns

    before, after = seen["quality_filter"]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out()))
    scores = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    assert {r["doc_id"] for r in after} == {i for i, s in scores.items() if s >= 0.3}

    before, after = seen["near_duplicate_filter"]
    roots = brute.linked({r["doc_id"]: brute.shingles(r["text"]) for r in before}, brute.jaccard)
    assert sorted(r["doc_id"] for r in after) == sorted({root for _, root in roots.values()})

    before, after = seen["decontamination_filter"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contaminated([r["text"] for r in before], items)
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, (_, n, _) in zip(before, hits, strict=True) if not n)

    before, after = seen["mix_to_targets"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = mixing.label_domains(labels).where("domain <> 'low'")
    toxic = {r["doc_id"] for r in mixing.domain_posteriors(spark.createDataFrame(before), marks, ["good", "toxic"]).collect() if r["posterior"][1] > r["posterior"][0]}
    times = {r["doc_id"]: 0 for r in before}
    for r in after:
        times[r["doc_id"]] += 1
    assert all((n == 0) == (i in toxic) and n <= 4 for i, n in times.items())


def test_mix_meets_targets_unlike_what_is_there(spark, tmp_path):
    """Of a corpus that is mostly English: nothing clean is lost, and languages' shares of tokens come out as asked."""
    rng = random.Random(9)
    shares = {"en": 0.7, "de": 0.12, "es": 0.08, "fr": 0.1}
    rows = []
    for i in range(3_000):
        lang = rng.choices(list(shares), list(shares.values()))[0]
        words = [f"{lang}{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        if toxic := i % 15 == 0:
            words[:9] = [f"bad{lang}{rng.randrange(3)}" for _ in range(9)]
        rows.append((i, " ".join(words), lang if i % 7 else None, toxic, len(words)))
    docs = spark.createDataFrame([(i, t, lang, "a", n) for i, t, lang, _, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(toxic)) for i, _, _, toxic, _ in rows if i % 3 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.mix_to_targets(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {i for i, _, _, toxic, _ in rows if not toxic}
    held = {lang: sum(r["n_chars"] for r in out if r["text"].split()[-1].startswith(lang)) for lang in shares}
    for lang, target in cp.TARGETS.items():
        assert abs(held[lang] / sum(held.values()) - target) < 0.01, held
    rates = cp.language_rates(docs.where("doc_id % 15 <> 0").withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), F.col("text"))}), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    r = rates.first()
    assert all(abs(e - t) < 0.01 * t for e, t in zip(r["expected"], r["target"], strict=True))


def test_shards_of_a_mix(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = docs.collect(), cp.shard(spark, docs, sf).collect()
    assert len(after) == len(before)
    assert all(r["shard"] == brute.jump(r["doc_id"], 8) for r in after)


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{rng.randrange(99)}" for _ in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " x", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "some other text that stands alone here", None, "b", 2), (1, "another text by the same id, unlike all others", "en", "a", 3)]
    for i, (name, table) in enumerate({"labels": ([(1, 1, 0)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, "nothing of the kind")], "item_id long, text string")}.items()):
        spark.createDataFrame(*table).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame(rows, schema)
    deduped = cp.near_duplicate_filter(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in deduped) == ["1", "1", "3", "4", "None"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 4 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def mix_corpus(spark, folder, toxic, short=120, n=2000):
    """Documents of 40 words, ``toxic`` of them toxic, then ``short`` clean ones of 0 to 6 words; every third row is labelled, and 60 toxic ones."""
    rng = random.Random(5)
    word = lambda kind: f"{kind}{rng.randrange(4 if kind == 't' else 40)}" if rng.random() < 0.3 else f"c{rng.randrange(60)}"
    kinds = ["t" if i < toxic else "g" for i in range(n)]
    texts = [" ".join(word(k) for _ in range(40)) for k in kinds] + [" ".join(f"c{rng.randrange(60)}" for _ in range(i % 7)) for i in range(short)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, int(kinds[i] == "t")) for i in range(n) if i % 3 == 0 or i < min(toxic, 60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_mix_keeps_short_clean_documents(spark, tmp_path):
    docs = mix_corpus(spark, tmp_path, toxic=260)
    kept = {r["doc_id"] for r in cp.mix_to_targets(spark, docs, str(tmp_path)).collect()}
    assert kept >= set(range(2000, 2120)) and kept >= set(range(260, 2000))


def test_mix_removes_rare_toxic_documents(spark, tmp_path):
    docs = mix_corpus(spark, tmp_path, toxic=4, n=4000)  # 0.1 % of the tokens
    kept = [r["doc_id"] for r in cp.mix_to_targets(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept) == list(range(4, 4120))
