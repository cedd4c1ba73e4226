"""Column functions for cleaning, counting and testing text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS
from . import patterns as P

SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any script at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """The words between white space; none of an empty text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def strip_controls(c: Column) -> Column:
    """Without control characters but tab, newline and carriage return."""
    return F.regexp_replace(c, P.CONTROL, "")


def clean_page(c: Column) -> Column:
    """Text of a scanned page without boilerplate, invisible characters and runs of blanks; the order of steps matters."""
    c = F.regexp_replace(c, "(?iuUs)(" + "|".join(P.BOILERPLATE) + ")", " ")
    c = F.regexp_replace(c, P.INVISIBLE, "")
    c = F.regexp_replace(c, " ", " ")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "")
    c = F.regexp_replace(c, r"(?U)\n\s*\n+", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(c)


def neutralise(c: Column) -> Column:
    """Document text with instructions to a model replaced by a mark."""
    return F.regexp_replace(c, P.any_of(P.CORPUS_INJECTIONS), P.CORPUS_MARK)


def sanitise_question(c: Column, limit: int = SETTINGS.max_question_chars) -> Column:
    """STRUCT<text, flagged>: a question on one line, cut to ``limit`` first, then with injections marked."""
    one_line = F.substring(strip(F.regexp_replace(strip_controls(F.coalesce(c, F.lit(""))), SPACES, " ")), 1, limit)
    pattern = P.any_of(P.QUESTION_INJECTIONS)
    return F.struct(F.regexp_replace(one_line, pattern, P.QUESTION_MARK).alias("text"), one_line.rlike(pattern).alias("flagged"))


def cache_key(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, SPACES, " ")))


def needs_translation(c: Column) -> Column:
    """Whether a text has no Cyrillic letter."""
    return ~c.rlike("[Ѐ-ӿ]")


def is_greeting(c: Column) -> Column:
    """At most five words, and a greeting anywhere in them, inside words too."""
    return (word_count(c) <= 5) & F.lower(strip(c)).rlike(P.any_of(P.GREETINGS))


def asks_for_prompt(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(P.any_of(P.PROMPT_REQUESTS))


def asks_for_author(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(P.any_of(P.AUTHORSHIP))


def detect_language(c: Column) -> Column:
    """``mk`` if any letter is Cyrillic, else the language with most stop words in the text, else ``und``."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+")
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    votes = F.array(*[F.struct(count(ws).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(P.STOPWORDS.items())])
    best = F.array_max(votes)
    return F.when(F.coalesce(c, F.lit("")).rlike("[Ѐ-ӿ]"), "mk").when(best["n"] > 0, best["code"]).otherwise("und")


def language_directive(code: Column) -> Column:
    """The sentence that tells a model which language to answer in."""
    named = F.create_map(*[F.lit(x) for pair in P.LANGUAGES.items() for x in pair])[code]
    return (
        F.when(code == "mk", "[LANGUAGE: answer in Macedonian, in Cyrillic]")
        .when(code == "en", "[LANGUAGE: answer in English]")
        .when(named.isNotNull(), F.concat(F.lit("[LANGUAGE: answer in "), named, F.lit("]")))
        .otherwise("[LANGUAGE: answer in the language of the question]")
    )


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    """A chunk's id: the first half of a SHA-256 digest, written as a UUID."""
    h = F.sha2(F.concat_ws(":", source, index.cast("string"), text), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def folder_metadata(path: Column) -> Column:
    """STRUCT of a file's folders: the first, third and fourth, where there are so many."""
    parts = F.split(path, "/")
    folder = lambda i: F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i)))
    return F.struct(folder(0).alias("ciklus"), folder(2).alias("fakultet"), folder(3).alias("nasoka"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def or_else(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def dispatch(url: Column, crawl: Column) -> Column:
    """How a web source is read: a PDF address beats crawling, crawling beats a single page."""
    return F.when(F.lower(F.get(F.split(url, r"\?"), F.lit(0))).endswith(".pdf"), "pdf").when(F.coalesce(crawl, F.lit(False)), "crawl").otherwise("page")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def same_domain(url: Column, domain: Column) -> Column:
    """Whether a URL's host is the domain, without ``www.``, or below it."""
    d = F.regexp_replace(F.lower(domain), r"^www\.", "")
    return (host(url) == d) | host(url).endswith(F.concat(F.lit("."), d))


def client_ip(direct: Column, forwarded: Column, trusted: bool = False, hops: int = 1) -> Column:
    """The peer, or behind trusted proxies the address ``hops`` before the last; the first if there are fewer."""
    direct = F.coalesce(direct, F.lit("unknown"))
    if not trusted:
        return direct
    chain = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.size(chain) == 0, direct).when(F.size(chain) > hops, F.element_at(chain, -(hops + 1))).otherwise(F.get(chain, F.lit(0)))


def escape_angles(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render_markdown(c: Column) -> Column:
    """The small Markdown of answers as HTML: bold, headings, bullets, numbers, line ends."""
    c = escape_angles(F.replace(c, F.lit("&"), F.lit("&amp;")))
    c = F.regexp_replace(c, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"(?m)^#{1,4}\s+(.*)$", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"(?m)^\s*[-•]\s+(.*)$", "&nbsp;&nbsp;• $1")
    c = F.regexp_replace(c, r"(?m)^\s*(\d+)\.\s+(.*)$", "&nbsp;&nbsp;$1. $2")
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def widget_input(c: Column, limit: int = 2000) -> Column:
    return F.substring(strip(c), 1, limit)
