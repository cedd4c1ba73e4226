"""Ingestion end to end: files and pages to chunks in a versioned table, with a report.

    python -m quern.plans.ingest --store DIR [--pdfs DIR] [--pages PARQUET] [--only pdf|web] [--dry-run] --extractor module:function
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, store
from ..sources import documents, html


def pdf_documents(spark: SparkSession, root: str, extractor: documents.Extractor, manifest: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """(source, text, error, title, url, doc_type, lang and folders) of a folder of PDF files, or of one of them."""
    files = documents.scan_pdfs(spark, root)
    if only is not None:
        files = files.where(F.col("source") == only)
    read = documents.extract_pdfs(files, extractor)
    if manifest is not None:
        read = documents.join_manifest(read, manifest).drop("tables")
    else:
        read = read.withColumns({"title": T.stem(F.col("source")), "url": F.lit(None).cast("string")})
    return read.withColumns({"doc_type": F.lit("pdf"), "lang": F.lit("mk"), "_f": T.folder_metadata(F.col("source"))}).select("*", "_f.*").drop("_f")


def web_documents(pages: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The same of fetched pages (page_id, url, html); a page without text is an error.

    A page whose address is that of one of ``sources`` (url, title), to the letter, has the title given there, if any.
    """
    read = html.extract_pages(pages)
    if sources is not None:
        given = sources.where("title <> ''").groupBy("url").agg(F.min("title").alias("_given"))
        read = read.join(given, "url", "left").withColumn("title", F.coalesce("_given", "title")).drop("_given")
    none = F.lit(None).cast("string")
    return read.select(
        F.col("url").alias("source"), F.nullif(F.col("text"), F.lit("")).alias("text"), F.when(F.col("text") == "", "no text").alias("error"),
        "title", "url", F.lit("web").alias("doc_type"), F.lit("mk").alias("lang"), none.alias("ciklus"), none.alias("fakultet"), none.alias("nasoka"),
    )


def ingest(docs: DataFrame, target: store.ChunkTable | None, replace: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, report, errors) of documents; without a target it's a dry run.

    All chunks of a run have its time.  With ``replace`` the chunks of a source take the place of
    its old ones, unless there are none; without it they are added by id.
    """
    good = docs.where(F.col("error").isNull()).drop("error")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    chunks = store.written(store.with_ids(chunking.chunk_documents(good)).withColumn("ingested_at", stamp))
    report = store.ingest_report(chunks, docs)
    if target is not None:
        target.replace(chunks) if replace else target.upsert(chunks)
    return chunks, report, docs.where(F.col("error").isNotNull()).select("source", "error")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--store", required=True)
    parser.add_argument("--pdfs")
    parser.add_argument("--pages")
    parser.add_argument("--extractor", help="module:function of a PDF extractor")
    parser.add_argument("--only", choices=["pdf", "web"])
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    from ..session import session

    spark = session("ingest")
    parts = []
    if args.pdfs and args.only != "web":
        if not args.extractor:
            parser.error("PDF files need an --extractor")
        module, _, name = args.extractor.partition(":")
        parts.append(pdf_documents(spark, args.pdfs, getattr(importlib.import_module(module), name)))
    if args.pages and args.only != "pdf":
        parts.append(web_documents(spark.read.parquet(args.pages)))
    failed = 0
    for docs in parts:
        _, report, errors = ingest(docs, None if args.dry_run else store.ChunkTable(spark, args.store))
        report.show(truncate=False)
        failed += errors.count()
        errors.show(truncate=False)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
