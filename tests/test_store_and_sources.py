from pyspark.sql import functions as F

from quern.operators import crawl, store, tables
from quern.sources import documents, html


def chunks(spark, rows):
    return spark.createDataFrame(rows, "source string, chunk_index int, text string")


def test_replacing_with_nothing_keeps_the_old(spark):
    old = chunks(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")])
    got = store.replace_sources(old, chunks(spark, [("b", 0, "new")])).orderBy("source", "chunk_index").collect()
    assert [(r["source"], r["text"]) for r in got] == [("a", "x"), ("a", "y"), ("b", "new")]
    assert store.replace_sources(old, chunks(spark, [])).count() == 3


def test_ingesting_twice_changes_nothing(spark, tmp_path):
    rows = store.with_ids(chunks(spark, [("a", 0, "x"), ("b", 0, "z")]))
    t = store.ChunkTable(spark, str(tmp_path / "t"))
    assert t.current() is None
    t.upsert(rows)
    t.upsert(rows)
    assert sorted(map(tuple, t.current().select("source", "text").collect())) == [("a", "x"), ("b", "z")]
    t.replace(store.with_ids(chunks(spark, [("b", 0, "q")])))
    assert sorted(map(tuple, t.current().select("source", "text").collect())) == [("a", "x"), ("b", "q")]


def test_crawl_by_levels(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "x")], "src string, dst string")
    got = crawl.crawl(links, spark.createDataFrame([("a",)], "url string"), 5, F.col("dst") != "x")
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert [r["url"] for r in crawl.budgeted(got, 2).collect()] == ["a", "b"]


def test_page_text():
    p = html.read_page("<html><head><title> T  x </title><script>var a='</p>';</script></head><body><nav>menu</nav><article><h1>H</h1><p>a <b>b</b></p><aside>no</aside></article><footer>f</footer></body></html>")
    assert p.text() == "H\na\nb" and "".join(p.title).split() == ["T", "x"]
    assert html.read_page("<body>x<main>m</main><article>a</article></body>").text() == "m"
    assert html.read_page(None).text() == ""


def test_page_tables_are_markdown():
    p = html.read_page("<body><table><tr><th>A</th><th>B</th></tr><tr><td>a|b</td><td>2</td></tr><tr><td></td><td></td></tr></table></body>")
    assert p.text() == "| A | B |\n| --- | --- |\n| a/b | 2 |"


def test_links():
    assert html.absolute_links("http://h/a/", ["b#x", "mailto:q", "//o/p.pdf?x", "b"]) == ["http://h/a/b", "http://o/p.pdf?x"]


def test_urls_that_must_not_be_fetched():
    public = lambda h: ["93.184.216.34"]
    assert documents.check_url("http://h/x", public) is None
    assert documents.check_url("ftp://h/x", public) == "scheme"
    assert documents.check_url("http://u:p@h/x", public) == "credentials"
    for address in ("127.0.0.1", "10.0.0.1", "169.254.1.1", "::1", "224.0.0.1", "0.0.0.0"):
        assert documents.check_url("http://h/x", lambda h, a=address: [a]) == "address"


def test_fetch_failures_are_rows(spark):
    def fetcher(url):
        if "bad" in url:
            raise ValueError("broken")
        return url, "application/pdf" if "pdf" in url else "text/html; charset=x" if "page" in url else "image/png", b"x"

    urls = spark.createDataFrame([("http://h/page",), ("http://h/pdf",), ("http://h/bad",), ("http://h/img",), ("file:///x",)], "url string")
    got = {r["url"]: (r["kind"], r["error"]) for r in documents.fetch(urls, fetcher, lambda h: ["93.184.216.34"]).collect()}
    assert got == {"http://h/page": ("html", None), "http://h/pdf": ("pdf", None), "http://h/bad": (None, "broken"), "http://h/img": (None, "content type image/png"), "file:///x": (None, "scheme")}


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.pdf").write_bytes("one\fСтраница 1 / 2 two".encode())
    (tmp_path / "a" / "y.pdf").write_bytes(b"bad")
    (tmp_path / "z.txt").write_text("no")
    files = documents.scan_pdfs(spark, str(tmp_path))

    def extractor(content):
        if content == b"bad":
            raise ValueError("not a PDF")
        return content.decode().split("\f")

    got = {r["source"]: (r["text"], r["error"]) for r in documents.extract_pdfs(files, extractor).collect()}
    assert got == {"a/b/x.pdf": ("one\n\ntwo", None), "a/y.pdf": (None, "not a PDF")}
    assert documents.extract_pdfs(files, extractor, max_bytes=10).where("error = 'too large'").count() == 1


def test_source_list(spark):
    rows, bad = documents.read_sources(spark, "web_sources:\n- url: http://h/a.pdf\n  crawl: true\n- url: http://h/\n  crawl: true\n- title: none\n")
    assert [(r["kind"], r["max_depth"], r["max_pages"]) for r in rows.collect()] == [("pdf", 1, 30), ("crawl", 1, 30)] and bad == ["entry 2"]
    assert documents.read_sources(spark, "")[0].count() == 0


def test_header_names(spark):
    assert spark.range(1).select(tables.merged_name(F.array(*map(F.lit, ["Ред.", "бр.", "Ред.", "БР."])))).first()[0] == "Ред. бр."


def test_header_columns_by_fragments(spark):
    """A title over two sub-columns, a name in two rows, a long remark, and a table of one column."""
    rows = [
        ("d", 1, 1, 0, 0, 0.0, 10.0, "No"), ("d", 1, 1, 0, 1, 20.0, 60.0, "Points"), ("d", 1, 1, 1, 0, 0.0, 9.0, "no."), ("d", 1, 1, 1, 1, 20.0, 38.0, "oral"), ("d", 1, 1, 1, 2, 41.0, 60.0, "written"),
        ("d", 1, 1, 1, 3, 70.0, 90.0, "x" * 61), ("d", 1, 2, 0, 0, 0.0, 5.0, "One"), ("d", 1, 2, 1, 0, 0.0, 5.0, "column"),
    ]
    cells = spark.createDataFrame([(*r, True) for r in rows], "doc string, page int, table_no int, row_no int, cell_no int, x0 double, x1 double, text string, is_header boolean")
    got = [(r["col"], r["x0"], r["x1"], r["name"]) for r in tables.header_columns(cells).orderBy("col").collect()]
    assert got == [(0, 0.0, 10.0, "No no."), (1, 20.0, 60.0, "Points"), (2, 20.0, 38.0, "Points oral"), (3, 41.0, 60.0, "Points written")]


def test_overlap(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0, 7.0), (0.0, 10.0, 8.0, 20.0), (0.0, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(tables.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [1.0, 0.2, 0.0]


def test_crawl_fetches_within_its_budget(spark):
    page = lambda *links: "".join(f"<a href='{x}'>x</a>" for x in links).encode() + b"\xff"
    web = {
        "http://h/": page("/b", "/a", "http://other/x", "/f.pdf#p", "/gone"),
        "http://h/a": page("/c", "/deep.pdf", "/"),
        "http://h/b": page("http://www.h/d"),
        "http://h/c": page("/e"),
        "http://h/f.pdf": b"%PDF",
        "http://k/": page("http://h/a"),
    }
    calls = spark.sparkContext.accumulator(0)

    def fetcher(url):
        calls.add(1)
        if url not in web:
            raise ValueError("404")
        return url, "application/pdf" if url.endswith(".pdf") else "text/html", web[url]

    fetch = lambda urls: documents.fetch(urls, fetcher, lambda h: ["93.184.216.34"])
    seeds = spark.createDataFrame([("http://h/",), ("http://k/",), ("http://h/",), (None,)], "url string")
    rows = lambda **kw: sorted((r["seed"], r["depth"], r["url"], r["error"]) for r in crawl.crawl_pages(seeds, fetch, **kw).collect() if r["depth"] is not None)
    everything = crawl.crawl_pages(seeds, fetch, max_depth=1)
    assert {(r["seed"], r["url"], r["error"]) for r in everything.where("depth IS NULL").collect()} == {("http://h/", "http://h/f.pdf", None), ("http://h/", "http://h/deep.pdf", "404")}
    assert calls.value == 7  # two seeds, three pages and two files, each once
    got = [tuple(r) for r in crawl.crawl_report(everything).orderBy("seed").collect()]
    assert got == [("http://h/", 4, 3, 1, 2), ("http://k/", 1, 1, 0, 0)]
    # the budget counts pages that fail, level by level in order of their addresses
    assert rows(max_depth=2, max_pages=5, fetch_pdfs=False) == [
        ("http://h/", 0, "http://h/", None), ("http://h/", 1, "http://h/a", None), ("http://h/", 1, "http://h/b", None), ("http://h/", 1, "http://h/gone", "404"),
        ("http://h/", 2, "http://h/c", None), ("http://k/", 0, "http://k/", None),
    ]
    assert crawl.crawl_pages(seeds.limit(0), fetch).count() == 0


def test_one_file(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"one")
    source = lambda root: documents.one_pdf(spark, str(tmp_path / "a" / "x.pdf"), root).first()["source"]
    assert (source(str(tmp_path)), source("/elsewhere"), source(None)) == ("a/x.pdf", "x.pdf", "x.pdf")


def test_title_given_for_a_seed(spark):
    from quern.plans.ingest import web_documents

    pages = spark.createDataFrame([(1, "http://h/", "<title>T</title><body>a</body>"), (2, "http://h/b", "<title>U</title><body>b</body>")], "page_id long, url string, html string")
    given = spark.createDataFrame([("http://h/", "Given"), ("http://h/b#top", "No"), ("http://h/b", "")], "url string, title string")
    assert {r["url"]: r["title"] for r in web_documents(pages, given).collect()} == {"http://h/": "Given", "http://h/b": "U"}


def test_table_is_made_once(spark, tmp_path):
    t = store.ChunkTable(spark, str(tmp_path / "t"))
    assert t.ensure("source string, text string").count() == 0
    t.publish(spark.createDataFrame([("a", "x")], "source string, text string"))
    assert t.ensure("source string, text string").count() == 1


def test_pages_are_read_in_slices():
    import pyarrow as pa

    from quern.sources import html

    n = 3 * html.PAGES + 1
    pages = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["http://a.b/c"] * n), pa.array([f"<body><p>t{i}</p><a href='/{i}'>l</a></body>" for i in range(n)])], ["page_id", "url", "html"])
    out = list(html._extract(iter([pages])))
    assert max(b.num_rows for b in out) <= html.PAGES
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["page_id"], r["text"], r["links"]) for r in rows] == [(i, f"t{i}\nl", [f"http://a.b/{i}"]) for i in range(n)]
