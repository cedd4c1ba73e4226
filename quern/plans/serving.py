"""Queries of serving: routes, history, limiters, caches, metrics, events, pages, crawls and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import patterns as P
from ..functions import text as T
from ..operators.store import written
from ..operators import answering, chunking, crawl, fusion, routing, state, tables
from ..sources import html
from . import fixtures as X
from .corpus import _S, read
from .search import RERANKED


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal questions and the users' turns."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question"))
    asked = turns.unionByName(X.frame(spark, [(f"q{n}", q) for n, q in X.QUESTIONS], "id string, question string"))
    return routing.route(asked).select("id", "route", "flagged", "lang", F.coalesce("reply", F.lit("")).alias("reply"), T.needs_translation(F.col("question")).alias("translate"))


def _re2(patterns: list[str]) -> str:
    return "(?i)(" + "|".join(patterns).replace(r"\s", _S).replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''") + ")"


def _votes() -> str:
    known = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)}))) AS {code}" for code, ws in P.STOPWORDS.items())
    best = f"greatest({', '.join(P.STOPWORDS)})"
    pick = " ".join(f"WHEN {code} = {best} THEN '{code}'" for code in P.STOPWORDS)
    return known, f"CASE WHEN regexp_matches(question, '[\\x{{400}}-\\x{{4FF}}]') THEN 'mk' WHEN {best} = 0 THEN 'und' {pick} END"


def route_ctes(asked: str) -> str:
    """CTEs a to d: questions (id, question) of a query, and what the router makes of them."""
    known, lang = _votes()
    one_line = f"substr(regexp_replace(regexp_replace(regexp_replace(question, '{P.CONTROL}', '', 'g'), '{_S}+', ' ', 'g'), '^ | $', '', 'g'), 1, 1000)"
    return rf"""a AS ({asked}),
b AS (SELECT *, {one_line} AS o, regexp_split_to_array(lower(question), '[^\p{{L}}]+') AS w FROM a),
c AS (SELECT *, regexp_matches(o, '{_re2(P.QUESTION_INJECTIONS)}') AS flagged, regexp_replace(o, '{_re2(P.QUESTION_INJECTIONS)}', '{P.QUESTION_MARK}', 'g') AS clean, {known} FROM b),
d AS (SELECT *, {lang} AS lang, CASE WHEN clean = '' THEN 'invalid' WHEN regexp_matches(question, '{_re2(P.PROMPT_REQUESTS)}') THEN 'refusal'
  WHEN regexp_matches(question, '{_re2(P.AUTHORSHIP)}') THEN 'author'
  WHEN len(list_filter(string_split(clean, ' '), lambda x: x <> '')) <= 5 AND regexp_matches(lower(clean), '{_re2(P.GREETINGS)}') THEN 'greeting' ELSE 'retrieve' END AS route FROM c)"""


def _route_sql() -> str:
    asked = f"SELECT conv_id || '/' || turn AS id, text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT 'q' || n, text FROM {X.values(X.QUESTIONS, 'n, text')}"
    refusals = " ".join(f"WHEN '{code}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for code, text in P.REFUSALS.items())
    fallback = P.REFUSALS["en"].replace("'", "''")
    return rf"""WITH {route_ctes(asked)}
SELECT id, route, flagged, lang, CASE route WHEN 'refusal' THEN CASE lang {refusals} ELSE '{fallback}' END WHEN 'author' THEN '{P.AUTHOR_REPLY}' WHEN 'greeting' THEN '{P.GREETING_REPLY}' ELSE '' END AS reply,
  NOT regexp_matches(question, '[\x{{400}}-\x{{4FF}}]') AS translate FROM d"""


def lang_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directive of every language of the documents, and of the literal codes."""
    codes = read(spark, sf_dir, "documents").select("lang").distinct().unionByName(X.frame(spark, [("mk",), ("tr",), ("sq",), ("und",)], "lang string"))
    return codes.select("lang", T.language_directive(F.col("lang")).alias("directive"))


DIRECTIVE_SQL = f"""WITH c AS (SELECT DISTINCT lang FROM documents UNION ALL SELECT * FROM {X.values([("mk",), ("tr",), ("sq",), ("und",)], 'lang')})
SELECT lang, CASE lang WHEN 'mk' THEN '[LANGUAGE: answer in Macedonian, in Cyrillic]' WHEN 'en' THEN '[LANGUAGE: answer in English]'
{' '.join(f"WHEN '{k}' THEN '[LANGUAGE: answer in {v}]'" for k, v in P.LANGUAGES.items())} ELSE '[LANGUAGE: answer in the language of the question]' END AS directive FROM c"""


def proxy_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.frame(spark, X.PROXIES, "n int, direct string, forwarded string")
    ip = lambda **k: T.client_ip(F.col("direct"), F.col("forwarded"), **k)
    return rows.select("n", ip().alias("plain"), ip(trusted=True).alias("one_hop"), ip(trusted=True, hops=2).alias("two_hops"))


_CHAIN = "list_filter(list_transform(string_split(coalesce(forwarded, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
PROXY_SQL = f"""SELECT n, d AS plain, CASE WHEN len(c) = 0 THEN d WHEN len(c) > 1 THEN c[len(c) - 1] ELSE c[1] END AS one_hop,
CASE WHEN len(c) = 0 THEN d WHEN len(c) > 2 THEN c[len(c) - 2] ELSE c[1] END AS two_hops
FROM (SELECT n, coalesce(direct, 'unknown') AS d, {_CHAIN} AS c FROM {X.values(X.PROXIES, 'n, direct, forwarded')})"""


def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal and page URLs: how each is read, and whether it belongs to the literal domain."""
    urls = X.frame(spark, X.URLS, "n long, url string, crawl boolean").unionByName(read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("n"), "url", F.lit(False).alias("crawl")))
    return urls.select("n", T.dispatch(F.col("url"), F.col("crawl")).alias("kind"), T.host(F.col("url")).alias("host"), T.same_domain(F.col("url"), F.lit("www.x.mk")).alias("same"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"
DISPATCH_SQL = f"""WITH u AS (SELECT n, url, crawl FROM {X.values(X.URLS, 'n, url, crawl')} UNION ALL SELECT page_id + 1000, url, FALSE FROM pages)
SELECT n, CASE WHEN lower(string_split(url, '?')[1]) LIKE '%.pdf' THEN 'pdf' WHEN coalesce(crawl, FALSE) THEN 'crawl' ELSE 'page' END AS kind, {_HOST} AS host,
{_HOST} = 'x.mk' OR {_HOST} LIKE '%.x.mk' AS same FROM u"""


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_messages(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "position", "role")


HISTORY_SQL = f"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {SETTINGS.history_turns})"""

#: Windows that the test log's sparse requests reach: a day, two requests; the service's are minutes.
DAY, PER_DAY = 86_400, 2


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sessions(_log(spark, sf_dir)).select("event_id", "user_id", "session_no")


SESSION_SQL = f"""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= {SETTINGS.history_ttl_s} THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS session_no FROM g"""


def session_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that only some rows renew: clicks and views are reads."""
    reads = F.col("event_type").isin("click", "view")
    return state.sessions(_log(spark, sf_dir), renews=~reads).select("event_id", "user_id", "session_no")


APPENDS_SQL = f"""WITH m AS (SELECT *, NOT coalesce(event_type IN ('click', 'view'), TRUE) AS renews FROM events),
g AS (SELECT *, max(CASE WHEN renews THEN epoch(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m),
o AS (SELECT *, last IS NULL OR epoch(ts) - last > {SETTINGS.history_ttl_s} AS over FROM g)
SELECT event_id, user_id, CASE WHEN renews OR NOT over THEN CAST(sum(CASE WHEN renews AND over THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) END AS session_no FROM o"""


def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for variants, three to a question: errors are failures, purchases are hits."""
    log = _log(spark, sf_dir).withColumn("question_id", F.floor(F.col("event_id") / 3))
    return fusion.search_status(log.select("question_id", (F.col("event_type") == "error").alias("failed")), log.where("event_type = 'purchase'"), "question_id")


STATUS_SQL = """SELECT CAST(floor(event_id / 3) AS BIGINT) AS question_id,
  CASE WHEN bool_and(coalesce(event_type = 'error', FALSE)) THEN 'unavailable' WHEN coalesce(bool_or(event_type = 'purchase'), FALSE) THEN 'found' ELSE 'empty' END AS status
FROM events GROUP BY 1"""


def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rate_limit_sliding(_log(spark, sf_dir), limit=PER_DAY, window_s=DAY).select("event_id", "allowed")


def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rate_limit_fixed(_log(spark, sf_dir), limit=PER_DAY, window_s=DAY).select("event_id", "allowed")


_NUMBERED = "e AS (SELECT event_id, {key} AS k, epoch(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM {table})"


def _sliding(key: str, table: str, limit: int, name: str, event: str = "event_id") -> str:
    """A sliding log, as a recursive fold over each key's requests: the admitted times of a window travel along."""
    return f"""{name}_e AS (SELECT event_id, {key} AS k, epoch(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM {table}),
{name} AS (SELECT k, i, event_id, TRUE AS allowed, [t] AS held FROM {name}_e WHERE i = 1
  UNION ALL SELECT e.k, e.i, e.event_id, len(list_filter(r.held, lambda x: e.t - x <= {DAY})) < {limit},
    CASE WHEN len(list_filter(r.held, lambda x: e.t - x <= {DAY})) < {limit} THEN list_append(list_filter(r.held, lambda x: e.t - x <= {DAY}), e.t) ELSE list_filter(r.held, lambda x: e.t - x <= {DAY}) END
  FROM {name} AS r JOIN {name}_e AS e ON e.k = r.k AND e.i = r.i + 1)"""


SLIDING_SQL = f"WITH RECURSIVE {_sliding('user_id', 'events', PER_DAY, 'r')} SELECT event_id, allowed FROM r"
FIXED_SQL = f"""WITH RECURSIVE {_NUMBERED.format(key='user_id', table='events')},
r AS (SELECT k, i, event_id, t AS opened, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.i, e.event_id, CASE WHEN e.t >= opened + {DAY} THEN e.t ELSE opened END, CASE WHEN e.t >= opened + {DAY} THEN 1 ELSE n + 1 END FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)
SELECT event_id, n <= {PER_DAY} AS allowed FROM r"""


def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand in for addresses, users for sessions; errors come without a key."""
    log = _log(spark, sf_dir)
    return state.guard_chain(log, "event_type", "user_id", outer_limit=50, inner_limit=PER_DAY, window_s=DAY, key_ok=F.col("event_type") != "error").select("event_id", "verdict")


GUARD_SQL = f"""WITH RECURSIVE keyed AS (SELECT * FROM events WHERE event_type <> 'error'), {_sliding('event_type', 'keyed', 50, 'o')},
passed AS (SELECT * FROM keyed WHERE event_id IN (SELECT event_id FROM o WHERE allowed)), {_sliding('user_id', 'passed', PER_DAY, 'i_')}
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 401 WHEN event_id IN (SELECT event_id FROM i_ WHERE allowed) THEN 200 ELSE 429 END AS INT) AS verdict FROM events"""


def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cache_hits(_log(spark, sf_dir), "user_id", ttl_s=DAY).select("event_id", "hit")


_CACHE = f"""{_NUMBERED.format(key='user_id', table='events')},
r AS (SELECT k, i, event_id, FALSE AS hit, t AS stored FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.i, e.event_id, e.t - stored <= {DAY}, CASE WHEN e.t - stored <= {DAY} THEN stored ELSE e.t END FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)"""


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cache_stats(cache_ttl_hits(spark, sf_dir))


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.request_metrics(_log(spark, sf_dir), F.col("event_type") == "error", F.col("value"))


def sse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns as events, and put together again."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("answer"))
    return answering.reassemble(answering.sse_events(turns, "id"), "id").select("id", "answer", "complete")


def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns as events, with sources and the session's id; every seventh turn ends with an error."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("answer"),
        F.array(F.struct(F.concat(F.lit("conv/"), "conv_id").alias("source"))).alias("sources"),
        F.col("conv_id").cast("string").alias("session"),
        F.when(F.col("turn") % 7 == 0, "the model failed").alias("failed"),
    )
    return answering.sse_events(turns, "id", sources="sources", session="session", failed="failed")


SSE_SQL = r"""WITH e AS (SELECT conv_id || '/' || turn AS id, list_concat(['{"type":"sources","sources":[{"source":"conv/' || conv_id || '"}],"session_id":"' || conv_id || '"}'],
  list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '\S*\s|\S+'), lambda x: x <> ''), lambda x: '{"type":"token","token":' || CAST(to_json(x) AS VARCHAR) || '}'),
  [CASE WHEN turn % 7 = 0 THEN '{"type":"error","message":"the model failed"}' ELSE '{"type":"done"}' END]) AS p FROM conversations WHERE role = 'assistant')
SELECT id, CAST(unnest(range(0, len(p))) AS INT) AS seq, 'data: ' || unnest(p) || chr(10) || chr(10) AS event FROM e"""


def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("## Answer\n- **first** & <b>\n 2. "), "text").alias("text"))
    return turns.select("conv_id", "turn", F.md5(T.render_markdown(F.col("text"))).alias("digest"))


MARKDOWN_SQL = r"""SELECT conv_id, turn, md5(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace('## Answer' || chr(10) || '- **first** & <b>' || chr(10) || ' 2. ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '(?m)^#{1,4}\s+(.*)$', '<strong>\1</strong>', 'g'), '(?m)^\s*[-•]\s+(.*)$', '&nbsp;&nbsp;• \1', 'g'),
  '(?m)^\s*(\d+)\.\s+(.*)$', '&nbsp;&nbsp;\1. \2', 'g'), chr(10), '<br>')) AS digest FROM conversations WHERE role = 'assistant'"""


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_pages(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "title", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.link_table(html.extract_pages(read(spark, sf_dir, "pages")))


def _plain(c: str) -> str:
    """Character references of the given pages, as their characters (the semicolon may be missing)."""
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return c


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
# by patterns, as all given pages have one article of plain elements; pages of other shapes are tested by themselves
HTML_SQL = rf"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
n AS (SELECT page_id, url, title, flatten(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda x: string_split({_plain('x')}, chr(10)))) AS nodes FROM a),
t AS (SELECT page_id, url, title, array_to_string(list_filter(list_transform(nodes, lambda x: {_TRIM.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM n)
SELECT page_id, coalesce(nullif({_TRIM.format(rf"regexp_replace({_plain('title')}, '\s+', ' ', 'g')")}, ''), url) AS title, md5(text) AS digest, length(text) AS chars FROM t"""
LINKS_SQL = rf"""WITH h AS (SELECT page_id, url, unnest(list_distinct(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: regexp_extract({_plain('x')}, '^[^#]*')))) AS href FROM pages)
SELECT page_id, url, regexp_extract(url, '^https?://[^/]+') || href AS link, CASE WHEN regexp_matches(lower(regexp_extract(href, '^[^?#]*')), '\.pdf$') THEN 'pdf' ELSE 'html' END AS kind FROM h"""


def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages are parsed once, not at every level
    found = written(html.link_table(html.extract_pages(read(spark, sf_dir, "pages"))).select(F.col("url").alias("src"), F.col("link").alias("dst")))
    links = X.frame(spark, X.LINKS, "src string, dst string").unionByName(found)
    return crawl.crawl(links, X.frame(spark, [("http://x.mk/",)], "url string"), 3, crawl.within("www.x.mk"))


def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the pages table as a web of its own, from the first page of every host; what it links elsewhere is not fetched."""
    pages = read(spark, sf_dir, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))

    def fetch(urls: DataFrame) -> DataFrame:
        found = urls.join(pages, "url").withColumn("kind", F.when(F.lower("url").endswith(".pdf"), "pdf").otherwise("html"))
        return found.select("url", F.col("url").alias("final_url"), "kind", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))

    seeds = pages.groupBy(T.host(F.col("url"))).agg(F.min("url").alias("url")).select("url")
    return crawl.crawl_report(crawl.crawl_pages(seeds, fetch))


CRAWL_SQL = f"""WITH RECURSIVE l AS (SELECT * FROM {X.values(X.LINKS, 'src, dst')} WHERE regexp_matches(dst, '^https?://([^/:]*\\.)?x\\.mk(/|:|$)')),
r AS (SELECT 'http://x.mk/' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN l ON src = url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM r GROUP BY url"""

_CELL = "doc string, page int, table_no int, row_no int, cell_no int, x0 double, x1 double, text string"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    cells = tables.split_header(tables.clean_cells(X.frame(spark, X.CELLS, _CELL)))
    return cells, tables.header_columns(cells)


def table_header_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body cell of the literal tables with its column."""
    cells, columns = _tables(spark)
    blocks = tables.stitched(cells, columns)
    return tables.cells_to_columns(cells.where("NOT is_header").join(blocks, tables.TABLE), columns.join(blocks, tables.TABLE)).select("doc", "page", "table_no", "row_no", "cell_no", "name")


COLUMNS = [
    ("d1", 1, 0, 0.0, 10.0, "Ред. бр."), ("d1", 1, 1, 12.0, 60.0, "Предмет"), ("d1", 1, 2, 62.0, 100.0, "Кредити"), ("d1", 1, 3, 62.0, 80.0, "Кредити зимски"), ("d1", 1, 4, 82.0, 100.0, "Кредити летен"),
    ("d1", 2, 0, 0.0, 40.0, "Такса"), ("d1", 2, 1, 45.0, 90.0, "Износ"),
]
HEADER_SQL = f"""WITH c AS (SELECT * FROM {X.values(X.CELLS, 'doc, page, table_no, row_no, cell_no, x0, x1, text')}),
k AS (SELECT * FROM {X.values(COLUMNS, 'doc, block, col, c0, c1, name')}),
b AS (SELECT *, CASE WHEN page = 3 THEN 2 ELSE 1 END AS block FROM c WHERE doc = 'd1' AND NOT (page = 1 AND row_no < 2) AND NOT (page = 3 AND row_no < 1)),
j AS (SELECT b.*, k.name, k.col, c1 - c0 AS w, (least(x1, c1) - greatest(x0, c0)) / least(x1 - x0, c1 - c0) >= 0.3 AS fits FROM b LEFT JOIN k USING (doc, block))
SELECT doc, page, table_no, row_no, cell_no, CASE WHEN bool_or(fits) THEN min_by(name, w * 1000 + col) FILTER (fits) END AS name FROM j GROUP BY ALL"""


def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, columns = _tables(spark)
    return tables.stitched(cells, columns).select("doc", "page", "table_no", "block")


ISLANDS_SQL = f"""WITH t AS (SELECT * FROM {X.values([("d1", 1, 0, True), ("d1", 2, 0, False), ("d1", 3, 0, True)], 'doc, page, table_no, has')})
SELECT doc, page, table_no, CAST(sum(CASE WHEN has OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page, table_no) AS BIGINT) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, table_no) = 1 AS first FROM t)"""


def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.headings(X.frame(spark, X.TOPS, "doc string, page int, table_no int, top double"), X.frame(spark, X.LINES, "doc string, page int, line_no int, line string, bottom double"))


HEADING_SQL = rf"""WITH t AS (SELECT * FROM {X.values(X.TOPS, 'doc, page, table_no, top')}), l AS (SELECT * FROM {X.values(X.LINES, 'doc, page, line_no, line, bottom')}),
j AS (SELECT t.*, l.line, l.line_no, l.bottom, bottom <= top + 2 AND top - bottom >= 0 AND top - bottom < 60 AS above,
  line_no < 5 AND len(string_split(line, ' ')) BETWEEN 3 AND 14 AND length(regexp_replace(line, '\D', '', 'g')) < 5 AS early FROM t LEFT JOIN l USING (doc, page)),
g AS (SELECT doc, page, table_no, max_by(line, bottom) FILTER (above) AS near, min_by(line, line_no) FILTER (early) AS early FROM j GROUP BY ALL)
SELECT doc, page, table_no, coalesce(CASE WHEN near <> '' AND length(regexp_replace(near, '\D', '', 'g')) <= 8 THEN substr(near, 1, 120) END, early, '?') AS section FROM g"""


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal tables from cells to chunks."""
    blocks = tables.table_blocks(
        X.frame(spark, X.CELLS, _CELL), X.frame(spark, X.GRIDS, "doc string, page int, table_no int, grid int"),
        X.frame(spark, X.TOPS, "doc string, page int, table_no int, top double"), X.frame(spark, X.LINES, "doc string, page int, line_no int, line string, bottom double"),
    )
    return chunking.table_chunks(blocks).select("source", "table_index", "section", "page_start", "page_end", "part", "n_parts", "n_rows", "text", "word_count")


QUERIES = {
    "route_questions": route_questions,
    "lang_directive": lang_directive,
    "proxy_ip": proxy_ip,
    "source_dispatch": source_dispatch,
    "history_last_n": history_last_n,
    "session_ttl": session_ttl,
    "rate_limit_sliding": rate_limit_sliding,
    "rate_limit_fixed": rate_limit_fixed,
    "guard_chain": guard_chain,
    "cache_ttl_hits": cache_ttl_hits,
    "cache_stats": cache_stats,
    "request_metrics": request_metrics,
    "sse_roundtrip": sse_roundtrip,
    "sse_events": sse_events,
    "markdown_render": markdown_render,
    "html_extract": html_extract,
    "html_links": html_links,
    "crawl_bfs": crawl_bfs,
    "crawl_report": crawl_report,
    "session_appends": session_appends,
    "search_status": search_status,
    "table_header_join": table_header_join,
    "table_islands": table_islands,
    "heading_asof": heading_asof,
    "table_chunks": table_chunks,
}
#: Answers of benchmark questions: the reply, or the first line of the best passage as the context shows it.
ANSWERS_SQL = rf"""WITH RECURSIVE {RERANKED}, {route_ctes("SELECT item_id AS id, text AS question FROM benchmark")},
best AS (SELECT item_id, string_split(replace(replace(substr(text, 1, {SETTINGS.context_chars}), '<', '&lt;'), '>', '&gt;'), chr(10))[1] AS line FROM top5 WHERE place = 0)
SELECT id AS item_id, route, lang, CASE route WHEN 'retrieve' THEN coalesce(nullif(line, ''), '{P.NO_INFORMATION}') WHEN 'greeting' THEN '{P.GREETING_REPLY}' WHEN 'author' THEN '{P.AUTHOR_REPLY}' ELSE '{P.NO_INFORMATION}' END AS answer
FROM d LEFT JOIN best ON best.item_id = d.id"""


ORACLES = {
    "answers": ANSWERS_SQL,
    "html_extract": HTML_SQL,
    "html_links": LINKS_SQL,
    "route_questions": _route_sql(),
    "lang_directive": DIRECTIVE_SQL,
    "proxy_ip": PROXY_SQL,
    "source_dispatch": DISPATCH_SQL,
    "history_last_n": HISTORY_SQL,
    "session_ttl": SESSION_SQL,
    "session_appends": APPENDS_SQL,
    "search_status": STATUS_SQL,
    "rate_limit_sliding": SLIDING_SQL,
    "rate_limit_fixed": FIXED_SQL,
    "guard_chain": GUARD_SQL,
    "cache_ttl_hits": f"WITH RECURSIVE {_CACHE} SELECT event_id, hit FROM r",
    "cache_stats": f"WITH RECURSIVE {_CACHE} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(CAST(hit AS INT)), 3) AS hit_rate FROM r",
    "request_metrics": "SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 1) AS avg_latency_ms FROM events",
    "sse_events": SSE_SQL,
    "sse_roundtrip": "SELECT conv_id || '/' || turn AS id, text AS answer, TRUE AS complete FROM conversations WHERE role = 'assistant'",
    "markdown_render": MARKDOWN_SQL,
    "crawl_bfs": CRAWL_SQL,
    "table_header_join": HEADER_SQL,
    "table_islands": ISLANDS_SQL,
    "heading_asof": HEADING_SQL,
}
