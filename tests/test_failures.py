"""Errors that stay errors, tables that can't be lost, addresses that must not be reached."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import answering, dense, store
from quern.operators.snapshots import Conflict, SnapshotLog
from quern.plans import retrieve
from quern.sources import documents

QUESTIONS = [(1, "how long is the second course of study"), (2, "hi"), (3, "who pays the fee of the last semester")]
CHUNKS = [(7, "the second course of study is two years long"), (8, "the fee of the last semester is paid by the student")]


def frames(spark):
    return spark.createDataFrame(QUESTIONS, "question_id long, question string"), spark.createDataFrame(CHUNKS, "chunk_key long, text string")


def test_a_failed_generation_is_no_answer(spark):
    questions, chunks = frames(spark)

    def model(question, context, lang):
        if "fee" in question:
            raise ValueError("down")
        return "Two years."

    out = retrieve.answer_questions(questions, chunks, generator=answering.model_generator(lambda: model)).persist()
    got = {r["question_id"]: (r["answer"], r["failed"], r["cacheable"]) for r in out.collect()}
    assert got[1] == ("Two years.", None, True) and got[3] == (None, "generation", False) and got[2][1:] == (None, False)
    assert {r["question_id"] for r in retrieve.history_rows(out, fixed_routes=True).collect()} == {1, 2}
    events = answering.sse_events(out, "question_id", failed="failed").where("question_id = 3").collect()
    assert [r["event"] for r in events] == ['data: {"type":"error","message":"generation"}\n\n']


def test_a_search_that_is_down_leaves_nothing(spark):
    questions, chunks = frames(spark)

    def encoder(texts, id_col, prefix):  # fails on one question
        return dense.hashed_encoder(texts.where(~F.col("text").contains("fee") | F.lit(prefix == dense.PASSAGE_PREFIX)), id_col, prefix)

    out = retrieve.answer_questions(questions, chunks, encoder=encoder).persist()
    got = {r["question_id"]: (r["status"], r["failed"], r["answer"] is None, r["cacheable"]) for r in out.collect()}
    assert got == {1: ("found", None, False, True), 2: (None, None, False, False), 3: ("unavailable", "search", True, False)}
    rows = retrieve.history_rows(out).collect()
    assert {r["question_id"] for r in rows} == {1} and all(r["text"] for r in rows)


def test_only_questions_that_found_little_are_searched_again(spark, monkeypatch):
    questions = spark.createDataFrame([(1, "fee", "course"), (2, "zzz", "fee")], "question_id long, text string, translated string")
    chunks = spark.createDataFrame([(i, f"fee number {i}") for i in range(30)], "chunk_key long, text string")
    asked = []
    plain = retrieve.lexical.bm25
    monkeypatch.setattr(retrieve.lexical, "bm25", lambda docs, q, *a: (asked.append(sorted(r[0] for r in q.select("question_id").collect())), plain(docs, q, *a))[1])
    found, tried = retrieve.search_variants(questions, chunks, use_hybrid=False)
    assert asked == [[1, 2], [2]] and tried.count() == 3
    assert {r["question_id"]: r["count"] for r in found.groupBy("question_id").count().collect()} == {1: 20, 2: 20}


def test_two_writers_lose_nothing(spark, tmp_path):
    rows = lambda s: spark.createDataFrame([(s, s)], "source string, chunk_id string")
    table = store.ChunkTable(spark, str(tmp_path / "t"))
    table.ensure("source string, chunk_id string")
    errors = []

    def write(n):
        try:
            mine = store.ChunkTable(spark, str(tmp_path / "t"))
            for i in range(3):
                mine.upsert(rows(f"w{n}-{i}"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and {r["source"] for r in table.current().collect()} == {f"w{n}-{i}" for n in range(2) for i in range(3)}
    assert [c["operation"] for c in table.history()] == ["ensure", *["upsert"] * 6]
    assert table.current(1).count() == 0 and table.current(2).count() == 1
    table.delete("w0-0")
    assert table.current().count() == 5


def test_commits_are_put_once(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "t"))
    assert log.read() is None and log.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.read()["a"] == 1
    remote = SnapshotLog(spark, str(tmp_path / "r"))
    remote._put(1, "{}")  # as on other file systems than local ones
    with pytest.raises(Conflict):
        remote._put(1, "{}")


@pytest.mark.parametrize("at", ["data", "commit"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, at):
    table = store.ChunkTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, chunk_id string")
    with monkeypatch.context() as m:
        m.setattr(SnapshotLog, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.publish(rows)  # the very first one, too
    assert table.current() is None
    table.publish(rows)
    new = spark.createDataFrame([("d", "4")], "source string, chunk_id string")
    with monkeypatch.context() as m:
        if at == "commit":
            m.setattr(SnapshotLog, "commit", lambda *a: 1 / 0)
        else:
            m.setattr(store, "_ddl", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.upsert(new)
    assert table.current().count() == 3
    assert table.upsert(new).count() == 4


def test_a_lost_log_is_an_error(spark, tmp_path):
    table = store.ChunkTable(spark, str(tmp_path / "t"))
    for s in "abc":
        table.upsert(spark.createDataFrame([(s, s)], "source string, chunk_id string"))
    (tmp_path / "t" / "_log" / f"{2:020d}.json").rename(tmp_path / "aside")
    with pytest.raises(ValueError, match="misses commits"):
        table.current()
    for f in (tmp_path / "t" / "_log").iterdir():
        f.unlink()
    with pytest.raises(ValueError, match="misses commits"):
        table.upsert(spark.createDataFrame([("d", "d")], "source string, chunk_id string"))


class Site(http.server.BaseHTTPRequestHandler):
    sent = 0

    def do_GET(self):
        if self.path.startswith("/to/"):
            self.send_response(302)
            self.send_header("Location", self.path[4:])
            self.end_headers()
        elif self.path == "/huge":
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            try:
                for _ in range(2_000):
                    self.wfile.write(b"x" * 65_536)
                    Site.sent += 65_536
            except OSError:
                pass
        else:
            self.send_response(200 if self.path == "/page" else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<p>page")

    def log_message(self, *args):
        pass


def test_fetching_from_a_server(spark):
    """Pages, redirects to public and private addresses, and a body without end."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    resolve = lambda h: ["93.184.216.34" if h == "127.0.0.1" else "10.0.0.1"]  # noqa: E731 - this server stands for a public one
    paths = ["/page", "/to/page", "/to//page", "/gone", "/huge", "/to/http://inner.example/secret", "/to/file:///etc/passwd", f"/to/{root}/to/http://inner.example/"]
    rows = documents.fetch(spark.createDataFrame([(root + p,) for p in paths], "url string").coalesce(1), documents.http_fetcher(resolve), resolve).collect()
    got = {r["url"][len(root) :]: (r["kind"], r["error"]) for r in rows}
    server.shutdown()
    assert got["/page"] == got["/to//page"] == ("html", None)
    assert got["/gone"][1] == "status 404" and got["/huge"][1] == "too large" and Site.sent < 60 << 20
    assert got["/to/http://inner.example/secret"][1] == got[paths[-1]][1] == "redirect: address" and got["/to/file:///etc/passwd"][1] == "redirect: scheme"
    # a fetcher of one's own may follow redirects: where it ended is checked
    follow = lambda url: ("http://inner.example/", "text/html", b"secret")
    r = documents.fetch(spark.createDataFrame([(root + "/x",)], "url string"), follow, resolve).first()
    assert r["content"] is None and r["error"] == "redirect: address"
