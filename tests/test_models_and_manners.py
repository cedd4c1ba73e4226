"""Model calls that are kept, fetching with manners, languages learned from the corpus."""

import http.server
import threading
import time

from pyspark.sql import functions as F

from quern.operators import crawl, language
from quern.operators.memo import Memo, translated
from quern.operators.store import written
from quern.sources import documents
from quern.sources.polite import fetch_politely


def test_a_model_is_called_once_a_text(spark, tmp_path):
    calls, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(text):
            calls.add(1)
            if "bad" in text:
                raise ValueError
            return None if text == "none" else text.upper()

        return model

    memo = Memo(spark, str(tmp_path / "memo"), load)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "bad", "none", "a"])], "id long, t string").repartition(3)
    got = lambda df: sorted((r["id"], r["out"]) for r in df.collect())
    want = [(0, "A"), (1, "B"), (2, "A"), (3, None), (4, None), (5, None), (6, "A")]
    first = memo.called(rows, "t", "out")
    assert got(first) == want and got(first) == want and calls.value == 4  # reading twice calls no more
    more = rows.unionByName(spark.createDataFrame([(9, "c")], "id long, t string"))
    assert got(Memo(spark, str(tmp_path / "memo"), load).called(more, "t", "out")) == [*want, (9, "C")]
    assert calls.value == 7  # the new one, and the two that failed, again
    assert memo.called(rows.where("t = 'a'"), "t", "out").count() == 3 and calls.value == 7
    assert memo.kept().count() == 3


def test_translation_leaves_a_question_alone_where_it_fails(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"), lambda: lambda t: {"one": "едно"}[t])
    rows = spark.createDataFrame([(1, "one", True), (2, "two", True), (3, "три", False)], "question_id long, clean string, needs_translation boolean")
    got = {r["question_id"]: (r["translated"], r["attempted"]) for r in translated(rows, memo).collect()}
    assert got == {1: ("едно", True), 2: (None, True), 3: (None, False)}


class Site(http.server.BaseHTTPRequestHandler):
    asked: list = []
    robots = b"User-agent: *\nDisallow: /private\nCrawl-delay: 1\n"

    def do_GET(self):
        Site.asked.append((self.headers["Host"], self.path, time.monotonic()))
        body = self.robots if self.path == "/robots.txt" else b"<a href='/b'>b</a><a href='/private/c'>c</a>"
        self.send_response(200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_fetching_with_manners(spark):
    """One host answers under two names: each is asked for robots.txt once, with pauses, and never for what that forbids."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    roots = [f"http://{h}:{server.server_port}" for h in ("127.0.0.1", "localhost")]
    resolve = lambda h: ["93.184.216.34"]  # noqa: E731 - this server stands for a public one
    urls = [(f"{r}/{p}",) for r in roots for p in ("a", "b", "private/x", "a")] + [("ftp://x/",), (None,), ("http://u:p@h/",)]
    fetch = lambda u: fetch_politely(u, documents.http_fetcher(resolve), resolve, delay_s=0.05)
    got = {r["url"]: (r["kind"], r["error"]) for r in fetch(spark.createDataFrame(urls, "url string")).collect()}
    assert got == {**{f"{r}/{p}": ("html", None) for r in roots for p in "ab"}, **{f"{r}/private/x": (None, "robots") for r in roots}, "ftp://x/": (None, "scheme"), None: (None, "scheme"), "http://u:p@h/": (None, "credentials")}
    for r in roots:
        own = [(p, t) for h, p, t in Site.asked if h == r[7:]]
        assert [p for p, _ in own] == ["/robots.txt", "/a", "/b"] and own[2][1] - own[1][1] >= 0.99
    # a crawl by the same means
    pages = crawl.crawl_pages(spark.createDataFrame([(f"{roots[0]}/a",)], "url string"), fetch, max_depth=1)
    assert {(r["url"][len(roots[0]) :], r["error"]) for r in pages.collect()} == {("/a", None), ("/b", None), ("/private/c", "robots")}
    server.shutdown()


def test_languages_of_held_out_documents(spark, sf):
    """Learned from four fifths of the documents, nearly all others of some length are told right."""
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    known = written(language.profiles(docs.where("doc_id % 5 <> 0")))
    told = language.detected(docs.where("doc_id % 5 = 0"), known).join(docs, "doc_id").where(F.length("text") > 40)
    total, right = told.agg(F.count(F.lit(1)), F.sum((F.col("detected") == F.col("lang")).cast("int"))).first()
    assert total > 150 and right / total > 0.97


def test_languages_of_odd_texts(spark):
    known = written(language.profiles(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "xx"), (4, "x", None)], "doc_id long, text string, lang string")))
    rows = [(1, "the dog"), (2, "und der"), (3, None), (4, "123 !!"), (5, "щщщ"), (6, "THE")]
    got = {r["doc_id"]: r["detected"] for r in language.detected(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}


def test_languages_without_a_shuffle_of_trigrams(spark, monkeypatch):
    texts = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, "ÿĀ 𝒜𝒷 ñandú", "es"), (5, None, "en"), (6, "", "de")]
    known = written(language.profiles(spark.createDataFrame(texts, "doc_id long, text string, lang string"), grams=40))
    rows = [*texts, (7, "THE hund", None), (7, "le chien, the dog", None), (8, "x 1 y", None), (None, "the dog", None), (9, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.detected(docs, known)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    told = lambda df: sorted(((r["doc_id"] or -1, r["detected"], round(r["margin"], 5)) for r in df.collect()))
    own = told(got)
    monkeypatch.setattr(language, "BROADCAST_ROWS", 0)  # by joins
    joined = language.detected(docs, known)
    assert "Generate" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert own == told(joined) and len(own) == 10 and own[0][1] == "und"
