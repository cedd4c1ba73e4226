"""Queries over the corpus: cleaning, chunking, ids and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import chunking, store
from ..sources import documents as sources
from . import fixtures as X


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows; one that Spark reads in a task or two, as small files are, is dealt to all cores first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and rows.rdd.getNumPartitions() * 3 <= cores:
        return rows.repartition(cores)
    return rows


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(X.frame(spark, [(-i, t) for i, t in X.TEXTS], "doc_id long, text string"))


_TEXTS_SQL = "t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -n, text FROM " + X.values(X.TEXTS, "n, text") + ")"
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


def corpus_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "documents")
        .select("source", "lang", F.length("text").alias("c"), T.word_count(F.col("text")).alias("w"))
        .groupBy("source", "lang")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.max("w").alias("max_words"), F.sum("c").alias("chars"))
    )


SCAN_SQL = f"""SELECT source, lang, count(*) AS docs, sum(w) AS words, max(w) AS max_words, sum(c) AS chars
FROM (SELECT source, lang, length(text) AS c, len({_WORDS.format('text')}) AS w FROM documents) GROUP BY ALL"""


def control_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.strip_controls(F.col("text"))).alias("digest"))


CONTROL_SQL = f"WITH {_TEXTS_SQL} SELECT doc_id, md5(regexp_replace(text, '{P.CONTROL}', '', 'g')) AS digest FROM t"


def whitespace_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.cache_key(F.col("text"))).alias("key"))


_S = r"[\s\x{A0}]"
KEY_SQL = f"WITH {_TEXTS_SQL} SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '{_S}+', ' ', 'g'), '^ | $', '', 'g'))) AS key FROM t"


def pdf_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.md5(T.clean_page(F.col("text"))).alias("digest"))


def _nest(start: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    for pattern, by in steps:
        start = f"regexp_replace({start}, {pattern}, {by}, '{flags}')"
    return start


_BOILER = "(?is)(" + "|".join(P.BOILERPLATE).replace(r"\s", _S).replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\S", r"[^\s\x{A0}]") + ")"
CLEAN_SQL = f"WITH {_TEXTS_SQL} SELECT doc_id, md5(" + _nest(
    "text",
    [
        (f"'{_BOILER}'", "' '"),
        (r"'[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]'", "''"),
        (r"'\x{A0}'", "' '"),
        (r"'[\x00-\x08\x0b-\x1f]'", "''"),
        (r"'\n\s*\n+'", r"chr(10) || chr(10)"),
        (r"'[ \t]+'", "' '"),
        (r"'^\s+|\s+$'", "''"),
    ],
) + ") AS digest FROM t"


def _re2(patterns: list[str]) -> str:
    return "(?i)(" + "|".join(patterns).replace(r"\s", _S).replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''") + ")"


def injection_neutralise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir).withColumn("q", T.sanitise_question(F.col("text")))
    return t.select("doc_id", F.md5(T.neutralise(F.col("text"))).alias("digest"), F.md5("q.text").alias("question"), "q.flagged")


_ONE_LINE = f"substr(regexp_replace(regexp_replace(regexp_replace(text, '{P.CONTROL}', '', 'g'), '{_S}+', ' ', 'g'), '^ | $', '', 'g'), 1, 1000)"
NEUTRAL_SQL = f"""WITH {_TEXTS_SQL}, o AS (SELECT doc_id, text, {_ONE_LINE} AS q FROM t)
SELECT doc_id, md5(regexp_replace(text, '{_re2(P.CORPUS_INJECTIONS)}', '{P.CORPUS_MARK}', 'g')) AS digest,
       md5(regexp_replace(q, '{_re2(P.QUESTION_INJECTIONS)}', '{P.QUESTION_MARK}', 'g')) AS question,
       regexp_matches(q, '{_re2(P.QUESTION_INJECTIONS)}') AS flagged FROM o"""


def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("words"))
    each = docs.select("doc_id", F.posexplode(chunking.word_windows(F.col("text"), F.col("words"))).alias("part", "chunk"))
    return each.select("doc_id", "part", F.md5("chunk").alias("digest"), T.word_count(F.col("chunk")).alias("words"))


_WINDOWS_SQL = f"""d AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, text, w, unnest(range(0, greatest(CAST(ceil((len(w) - 1000) / 850.0) AS INT), 0) + 1)) AS part FROM d),
win AS (SELECT doc_id, CAST(part AS INT) AS part, CASE WHEN len(w) <= 1000 THEN text ELSE array_to_string(w[part * 850 + 1:part * 850 + 1000], ' ') END AS chunk FROM p)"""
WINDOWS_SQL = f"WITH {_WINDOWS_SQL} SELECT doc_id, part, md5(chunk) AS digest, CAST(len({_WORDS.format('chunk')}) AS INT) AS words FROM win"

PACK_TARGET = 80


def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda p: T.strip(p)), lambda p: p != "").alias("ps"))
    each = docs.select("doc_id", F.posexplode(chunking.pack_paragraphs(F.col("ps"), PACK_TARGET, "\n")).alias("part", "chunk"))
    return each.select("doc_id", "part", F.md5("chunk").alias("digest"), T.word_count(F.col("chunk")).alias("words"))


PACK_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
e AS (SELECT doc_id, ps, list_transform(ps, lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> ''))) AS ns FROM d WHERE len(ps) > 0),
r AS (SELECT doc_id, 1 AS i, 1 AS lo, ns[1] AS n, 0 AS part, CAST(NULL AS BIGINT) AS out_lo, CAST(NULL AS BIGINT) AS out_hi FROM e
  UNION ALL
  SELECT r.doc_id, i + 1,
    CASE WHEN n + ns[i + 1] > {PACK_TARGET} THEN CASE WHEN ns[i] <= {PACK_TARGET // 2} THEN i ELSE i + 1 END ELSE lo END,
    CASE WHEN n + ns[i + 1] > {PACK_TARGET} THEN CASE WHEN ns[i] <= {PACK_TARGET // 2} THEN ns[i] ELSE 0 END + ns[i + 1] ELSE n + ns[i + 1] END,
    part + CASE WHEN n + ns[i + 1] > {PACK_TARGET} THEN 1 ELSE 0 END,
    CASE WHEN n + ns[i + 1] > {PACK_TARGET} THEN lo END, CASE WHEN n + ns[i + 1] > {PACK_TARGET} THEN i END
  FROM r JOIN e USING (doc_id) WHERE i < len(ps)),
c AS (SELECT doc_id, part - 1 AS part, out_lo AS lo, out_hi AS hi FROM r WHERE out_lo IS NOT NULL
  UNION ALL SELECT r.doc_id, part, lo, i FROM r JOIN e USING (doc_id) WHERE i = len(ps)),
t AS (SELECT doc_id, CAST(part AS INT) AS part, array_to_string(ps[lo:hi], chr(10)) AS chunk FROM c JOIN e USING (doc_id))
SELECT doc_id, part, md5(chunk) AS digest, CAST(len({_WORDS.format('chunk')}) AS INT) AS words FROM t"""


def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.frame(spark, X.ARTICLES, "n int, text string").withColumn("articles", chunking.article_count(F.col("text")))
    pieces = docs.where("articles >= 3").select("n", "articles", F.posexplode(chunking.article_chunks(F.col("text"))).alias("position", "p"))
    return pieces.select("n", "articles", "position", "p.article_no", "p.section", "p.text")


ARTICLE_SQL = rf"""WITH a AS (SELECT n, text, regexp_replace(chr(10) || text, '\n(\s*Член\s+\d+[а-я]?)([^\p{{L}}\p{{N}}_])', chr(1) || '\1\2', 'g') AS m FROM {X.values(X.ARTICLES, 'n, text')}),
s AS (SELECT n, len(string_split(m, chr(1))) - 1 AS articles, list_filter(list_transform(string_split(m, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM a),
e AS (SELECT n, articles, unnest(ps) AS text, unnest(range(len(ps))) AS o FROM s WHERE articles >= 3),
k AS (SELECT *, nullif(regexp_extract(text, '^(Член\s+\d+[а-я]?)([^\p{{L}}\p{{N}}_]|$)', 1), '') AS article_no FROM e)
SELECT n, CAST(articles AS INT) AS articles, CAST(row_number() OVER (PARTITION BY n ORDER BY o) - 1 AS INT) AS position, article_no,
       CASE WHEN article_no IS NULL THEN '{P.INTRO_SECTION}' END AS section, text
FROM k WHERE article_no IS NOT NULL OR len({_WORDS.format('text')}) > 20"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), "lang")
    return chunking.chunk_documents(docs)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "source", "lang", "chunk_index", "strategy", "section", "word_count", F.md5("text").alias("digest"))


_CHUNKS_SQL = rf"""d AS (SELECT doc_id, source || '/' || doc_id AS source, lang, regexp_replace(regexp_replace(text, '{P.CONTROL}', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS w FROM d WHERE text <> ''),
p AS (SELECT *, unnest(range(0, greatest(CAST(ceil((len(w) - 1000) / 850.0) AS INT), 0) + 1)) AS part FROM w),
pieces AS (SELECT doc_id, source, lang, len(w) AS n, part, CASE WHEN len(w) <= 1000 THEN text ELSE array_to_string(w[part * 850 + 1:part * 850 + 1000], ' ') END AS chunk,
  least(1000, len(w) - part * 850) AS size FROM p),
-- every window but the last is fuller than a pack, so each is a pack of its own
c AS (SELECT doc_id, source, lang, part, chunk FROM pieces),
k AS (SELECT *, '{P.PART_SECTION} ' || part AS section, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS chunk_index
      FROM c WHERE len({_WORDS.format('chunk')}) >= 8),
ch AS (SELECT doc_id, source, lang, CAST(chunk_index AS INT) AS chunk_index, section, regexp_replace(chunk, '{_re2(P.CORPUS_INJECTIONS)}', '{P.CORPUS_MARK}', 'g') AS text FROM k)"""
CHUNKS_SQL = f"""WITH {_CHUNKS_SQL} SELECT doc_id, source, lang, chunk_index, 'paragraph' AS strategy, section,
CAST(len({_WORDS.format('text')}) AS INT) AS word_count, md5(text) AS digest FROM ch"""


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_ids(_chunks(spark, sf_dir)).select("source", "chunk_index", "chunk_id")


_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
IDS_SQL = f"WITH {_CHUNKS_SQL} SELECT source, chunk_index, {_ID} AS chunk_id FROM (SELECT source, chunk_index, sha256(source || ':' || chunk_index || ':' || text) AS h FROM ch)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored documents, and a new version of those of good quality."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return docs, docs.join(good, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("new: "), "text"))


def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return store.upsert(old, new, "doc_id").select("doc_id", "source", F.md5("text").alias("digest"))


UPSERT_SQL = """WITH n AS (SELECT doc_id, source, 'new: ' || text AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT doc_id, source, md5(text) AS digest FROM (SELECT * FROM n UNION ALL SELECT doc_id, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n))"""


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with toxic documents are replaced by their other labelled ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = read(spark, sf_dir, "labels")
    new = docs.join(labels.where("quality = 0 AND toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return store.replace_sources(docs, new).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("ids"))


REPLACE_SQL = """WITH n AS (SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1))
SELECT source, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT * FROM n UNION ALL SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM n)) GROUP BY source"""


def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_by_source(read(spark, sf_dir, "documents"), "src0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


DELETE_SQL = "SELECT source, count(*) AS docs FROM documents WHERE source <> 'src0' GROUP BY source"


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"))
    return store.ingest_report(_chunks(spark, sf_dir), docs)


REPORT_SQL = f"""WITH {_CHUNKS_SQL}, s AS (SELECT source, (SELECT count(*) FROM ch WHERE ch.source = d.source) AS n FROM d)
SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) FILTER (n > 0) AS sources_ok, coalesce(string_agg(source, ',' ORDER BY source) FILTER (n = 0), '') AS failures FROM s"""


def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.frame(spark, X.FILES, "n int, source string")
    manifest = X.frame(spark, X.MANIFEST, "file string, title string, url string, tables boolean")
    joined = sources.join_manifest(files, manifest)
    return joined.withColumn("m", T.folder_metadata(F.col("source"))).select("n", "source", "title", "url", "tables", "m.*")


MANIFEST_SQL = rf"""WITH f AS (SELECT n, source, regexp_extract(source, '([^/]*)$', 1) AS name, string_split(source, '/') AS p FROM {X.values(X.FILES, 'n, source')}),
m AS (SELECT * FROM {X.values(X.MANIFEST, 'file, title, url, tables')})
SELECT n, source, coalesce(nullif(CASE WHEN a.file IS NOT NULL THEN a.title ELSE b.title END, ''), regexp_replace(name, '\.[^.]*$', '')) AS title,
       CASE WHEN a.file IS NOT NULL THEN a.url ELSE b.url END AS url, coalesce(CASE WHEN a.file IS NOT NULL THEN a.tables ELSE b.tables END, TRUE) AS tables,
       CASE WHEN len(p) > 1 THEN p[1] END AS ciklus, CASE WHEN len(p) > 3 THEN p[3] END AS fakultet, CASE WHEN len(p) > 4 THEN p[4] END AS nasoka
FROM f LEFT JOIN m AS a ON a.file = source LEFT JOIN m AS b ON b.file = name"""

QUERIES = {
    "corpus_scan_stats": corpus_scan_stats,
    "control_strip": control_strip,
    "whitespace_key": whitespace_key,
    "pdf_text_clean": pdf_text_clean,
    "injection_neutralise": injection_neutralise,
    "word_windows": word_windows,
    "paragraph_pack": paragraph_pack,
    "article_split": article_split,
    "chunk_documents": chunk_documents,
    "chunk_ids": chunk_ids,
    "upsert_by_id": upsert_by_id,
    "replace_source": replace_source,
    "delete_by_source": delete_by_source,
    "ingest_report": ingest_report,
    "manifest_join": manifest_join,
}
ORACLES = {
    "corpus_scan_stats": SCAN_SQL,
    "control_strip": CONTROL_SQL,
    "whitespace_key": KEY_SQL,
    "pdf_text_clean": CLEAN_SQL,
    "injection_neutralise": NEUTRAL_SQL,
    "word_windows": WINDOWS_SQL,
    "paragraph_pack": PACK_SQL,
    "article_split": ARTICLE_SQL,
    "chunk_documents": CHUNKS_SQL,
    "chunk_ids": IDS_SQL,
    "upsert_by_id": UPSERT_SQL,
    "replace_source": REPLACE_SQL,
    "delete_by_source": DELETE_SQL,
    "ingest_report": REPORT_SQL,
    "manifest_join": MANIFEST_SQL,
}
