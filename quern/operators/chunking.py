"""Documents into chunks: word windows, articles, packed paragraphs, and tables' rows.

Folds over a document's own pieces run as one expression a row; documents are chunked side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions import patterns as P
from ..functions import text as T


def word_windows(text: Column, words: Column, size: int = SETTINGS.window_words, overlap: float = SETTINGS.overlap_ratio) -> Column:
    """ARRAY<STRING>: a text of up to ``size`` words as it is, a longer one in overlapping windows of words.

    ``words`` is the text's words, a column of its own so that they are split once.
    """
    step = max(1, size - int(size * overlap))
    last = F.ceil((F.size(words) - size) / step).cast("int")
    return F.when(F.size(words) <= size, F.array(text)).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
    )


def windows_of(text: Column, size: int = SETTINGS.window_words, overlap: float = SETTINGS.overlap_ratio) -> Column:
    # the transform of one element binds the words, so that they are split once
    return F.get(F.transform(F.array(T.tokens(text)), lambda words: word_windows(text, words, size, overlap)), F.lit(0))


def pack_paragraphs(paragraphs: Column, target: int = SETTINGS.paragraph_target, joint: str = "\n\n") -> Column:
    """ARRAY<STRING>: paragraphs packed greedily up to ``target`` words; a full pack's last paragraph,
    if it is at most half of that, also begins the next one, which isn't measured again."""
    start = F.expr("named_struct('out', cast(array() as array<array<string>>), 'held', cast(array() as array<string>), 'n', 0, 'last', 0)")

    def add(s: Column, p: Column) -> Column:
        carries = s["last"] <= target // 2
        full = (s["n"] + p["n"] > target) & (F.size(s["held"]) > 0)
        kept = F.when(~full, s["held"]).when(carries, F.slice(s["held"], -1, 1)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]).alias("out"),
            F.concat(kept, F.array(p["t"])).alias("held"),
            (F.when(~full, s["n"]).when(carries, s["last"]).otherwise(0) + p["n"]).alias("n"),
            p["n"].alias("last"),
        )

    def finish(s: Column) -> Column:
        return F.transform(F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]), lambda x: F.array_join(x, joint))

    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("t"), T.word_count(p).alias("n")))
    return F.aggregate(sized, start, add, finish)


def paragraph_chunks(text: Column, separator: str = "\n\n", target: int = SETTINGS.paragraph_target) -> Column:
    """ARRAY<STRING>: the paragraphs of a text, long ones in windows, packed."""
    paragraphs = F.filter(F.transform(F.split(text, separator), lambda p: T.strip(p)), lambda p: p != "")
    return pack_paragraphs(F.flatten(F.transform(paragraphs, lambda p: windows_of(p))), target, separator)


def article_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?mU)^\s*" + P.ARTICLE), F.lit(0)))


def article_chunks(text: Column, intro_words: int = SETTINGS.intro_words) -> Column:
    """ARRAY<STRUCT<text, article_no, section, part>>: one piece an article, and an introduction of enough words before them."""
    pieces = F.filter(F.transform(F.split(text, r"(?mU)(?=^\s*" + P.ARTICLE + ")"), lambda p: T.strip(p)), lambda p: p != "")
    named = F.transform(pieces, lambda p: F.struct(p.alias("text"), T.strip(F.regexp_extract(p, r"(?U)^" + P.ARTICLE, 0)).alias("no")))
    kept = F.filter(named, lambda p: (p["no"] != "") | (T.word_count(p["text"]) > intro_words))
    return F.flatten(
        F.transform(
            kept,
            lambda p: F.transform(
                windows_of(p["text"]),
                lambda w, i: F.struct(w.alias("text"), F.nullif(p["no"], F.lit("")).alias("article_no"), F.when(p["no"] == "", P.INTRO_SECTION).alias("section"), i.alias("part")),
            ),
        )
    )


def chunk_documents(docs: DataFrame, settings: Settings = SETTINGS, separator: str = "\n\n") -> DataFrame:
    """Chunks of ``docs`` (text, source, and if there are any: title, url, doc_type, lang).

    A text with enough articles is cut at them, any other is packed by paragraphs; short chunks
    go (their words are counted before instructions are neutralised), and the rest are numbered
    from 0.  Null and blank texts have no chunks.
    """
    has = set(docs.columns)
    pick = lambda name, other: F.col(name) if name in has else other
    meta = [c for c in docs.columns if c not in ("text", "source", "title", "url", "doc_type", "lang")]
    base = docs.where(F.col("text").isNotNull() & (T.strip("text") != "")).select(
        *meta,
        T.strip_controls(F.col("text")).alias("text"),
        "source",
        T.or_else(pick("title", F.lit(None).cast("string")), F.col("source")).alias("title"),
        pick("url", F.lit(None).cast("string")).alias("url"),
        pick("doc_type", F.lit("pdf")).alias("doc_type"),
        pick("lang", F.lit("mk")).alias("lang"),
    )
    by_article = article_count(F.col("text")) >= settings.min_articles
    pieces = F.when(F.col("by_article"), article_chunks(F.col("text"), settings.intro_words)).otherwise(
        F.transform(
            paragraph_chunks(F.col("text"), separator, settings.paragraph_target),
            lambda t, i: F.struct(t.alias("text"), F.lit(None).cast("string").alias("article_no"), F.concat_ws(" ", F.lit(P.PART_SECTION), i.cast("string")).alias("section"), F.lit(None).cast("int").alias("part")),
        )
    )
    kept = F.filter("pieces", lambda p: T.word_count(p["text"]) >= settings.min_chunk_words)
    return (
        base.withColumn("by_article", by_article)
        .withColumn("pieces", pieces)
        .select(*meta, "source", "title", "url", "doc_type", "lang", "by_article", F.posexplode(kept).alias("chunk_index", "piece"))
        .select(
            *meta,
            T.neutralise(F.col("piece.text")).alias("text"),
            "source", "title", "url", "doc_type", "lang", "chunk_index",
            F.when(F.col("by_article"), "article").otherwise("paragraph").alias("strategy"),
            F.lit("prose").alias("content_type"),
            "piece.article_no", "piece.section", "piece.part",
        )
        .withColumn("word_count", T.word_count(F.col("text")))
    )


def split_long_row(row: Column, limit: Column | int) -> Column:
    """ARRAY<STRING>: a table row of more words than ``limit`` in parts, each but the first led by the row's first field."""
    words = T.tokens(row)
    first = F.when(row.contains(" | "), F.get(F.split(row, r" \| ", 2), F.lit(0))).otherwise(F.array_join(F.slice(words, 1, 8), " "))
    lead = F.array_join(F.slice(T.tokens(first), 1, 12), " ")
    limit = F.lit(limit) if isinstance(limit, int) else limit
    step = F.greatest(F.lit(20), limit - T.word_count(lead) - 2)
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / step).cast("int")),
        lambda i: F.concat(F.when(i > 0, F.concat(lead, F.lit(f" {P.CONTINUED}: "))).otherwise(""), F.array_join(F.slice(words, i * step + 1, step), " ")),
    )
    return F.when(F.size(words) <= limit, F.array(row)).otherwise(parts)


def pack_rows(rows: Column, limit: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: rows, long ones split, packed greedily up to ``limit`` words."""
    start = F.expr("named_struct('out', cast(array() as array<array<string>>), 'held', cast(array() as array<string>), 'n', 0)")

    def add(s: Column, r: Column) -> Column:
        n = T.word_count(r)
        full = (s["n"] + n > limit) & (F.size(s["held"]) > 0)
        return F.when(full, F.struct(F.concat(s["out"], F.array(s["held"])).alias("out"), F.array(r).alias("held"), n.alias("n"))).otherwise(
            F.struct(s["out"].alias("out"), F.concat(s["held"], F.array(r)).alias("held"), (s["n"] + n).alias("n"))
        )

    return F.aggregate(
        F.flatten(F.transform(rows, lambda r: split_long_row(r, limit))), start, add, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])
    )


_SUBTITLE = r"(?U)^—\s*(.+?)\s*—$"


def table_chunks(blocks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Chunks of table blocks (source, table_index, text, columns, section, page_start, page_end).

    A first line in brackets is the title; title and columns head every part, and a part after
    the first is also headed by the last short subtitle before it.
    """
    lines = F.filter(F.split("text", r"\R"), lambda x: T.strip(x) != "")
    titled = F.get("lines", F.lit(0)).rlike(r"^\[.*\]$")
    out = (
        blocks.withColumn("lines", lines)
        .where(F.size("lines") > 0)
        .withColumn("headline", F.when(titled, F.get("lines", F.lit(0))))
        .withColumn("rows", F.when(titled, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")))
        .where(F.size("rows") > 0)
        .withColumn("named", F.when(F.size("columns") > 0, F.concat(F.lit(P.COLUMNS_LABEL), F.array_join("columns", ", "))))
        .withColumn("budget", F.greatest(F.lit(50), settings.table_words - (T.word_count(F.concat_ws(" ", "headline", "named")) + 13)))
        .withColumn("parts", pack_rows(F.col("rows"), F.col("budget")))
    )
    short = lambda r: (F.regexp_extract(r, _SUBTITLE, 1) != "") & (T.word_count(F.regexp_extract(r, _SUBTITLE, 1)) <= 10)
    own = F.transform("parts", lambda rows: T.strip(F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), F.filter(rows, short)), -1), _SUBTITLE, 1)))
    carried = F.transform("own", lambda _, i: F.element_at(F.concat(F.array(F.lit("")), F.filter(F.slice("own", 1, i), lambda x: x != "")), -1))
    return (
        out.withColumn("own", own)
        .withColumn("carried", carried)
        .select("source", "table_index", "section", "columns", "page_start", "page_end", "headline", "named", "carried", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "rows"))
        .withColumn("subtitle", F.nullif(F.get("carried", F.col("part")), F.lit("")))
        .withColumn("head", F.when(F.col("subtitle").isNotNull(), F.concat(F.lit("— "), "subtitle", F.lit(f" {P.CONTINUED} —"))))
        .withColumn("text", T.neutralise(T.strip_controls(F.concat_ws("\n", "headline", "named", "head", F.array_join("rows", "\n")))))
        .select(
            "source", "table_index", "section", "columns", "page_start", "page_end", "part", "n_parts", F.size("rows").alias("n_rows"), "text",
            T.word_count(F.col("text")).alias("word_count"), F.lit("table").alias("content_type"), F.lit("table").alias("strategy"),
        )
    )
