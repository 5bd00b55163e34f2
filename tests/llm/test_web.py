"""WARC archives, URL reputation and main text of pages."""

from __future__ import annotations

import base64
import hashlib
import io
import time

import pytest
from pyspark.sql import functions as F

import parity
from quillspark.llm import hosts, htmlmain, queries, warc
from quillspark.llm.scratch import Scratch

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b/\nz", ""), (5, "u", "é" * 70000), (None, "n", "<p>x</p>"), (None, "n", "only"), (1, "http://a/1", "<p>x</p>")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("rotate", [1 << 20, 100])
def test_archives_read_back(spark, pages, rotate):
    index = warc.write_archives(pages, Scratch(spark, "t"), rotate=rotate)
    got = sorted(map(tuple, warc.read_archives(index).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        revisit = first is not None and first != page
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0), Scratch(spark, "t"))).count() == 0


def test_small_payloads_are_not_revisited(spark, pages):
    got = warc.read_archives(warc.write_archives(pages, Scratch(spark, "t"), min_bytes=1000))
    assert got.filter("record_type = 'revisit'").count() == 0


def test_a_frame_alone_is_a_record(spark, pages):
    import zstandard

    row = warc.write_archives(pages, Scratch(spark, "t")).filter("page_id = 5").first()
    with warc._open(row["path"], "r") as stream:
        data = stream.read()
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    plain = zstandard.ZstdDecompressor(dict_data=warc._dictionary(data[8 : 8 + size])).decompress(data[row["offset"] : row["offset"] + row["length"]])
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and plain.endswith("é".encode() + b"\r\n\r\n")


def test_dictionaries_of_few_and_many_records():
    assert warc.train_dictionary([]) == b"" and warc.train_dictionary([b"abc"]) == b"abc"
    many = [warc.build_record(i, f"http://h/{i}", b"<html>" + b"text of a page %d " % i * 40) for i in range(300)]
    assert len(warc.train_dictionary(many, 4096)) <= 4096


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"12345678 not an archive")))
    assert list(warc.read_records(io.BytesIO(b""))) == []


URLS = ["https://WWW.Example.COM/en/1?x", "http://a.net/es/2", "net/es/", "x://net/es/#f", "http://other.org?a/b", "http://h.co.uk", None, "", "http://com/x", "http://evilexample.com/en/", "http://a.example.com/en", "p://q://r/s"]


def test_hosts_and_paths(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").select(hosts.host_of(F.col("url")).alias("h"), hosts.path_of(F.col("url")).alias("p"))
    want = [("www.example.com", "/en/1"), ("a.net", "/es/2"), ("", ""), ("net", "/es/"), ("other.org", ""), ("h.co.uk", ""), ("", ""), ("", ""), ("com", "/x"), ("evilexample.com", "/en/"), ("a.example.com", "/en"), ("q:", "//r/s")]
    assert [tuple(r) for r in df.collect()] == want


def test_rules_and_posteriors(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(50 + i, f"http://bad.site.org/{i}") for i in range(40)] + [(200 + i, f"http://good.site.org/{500 + i}") for i in range(40)] + [(None, "http://bad.site.org/3")]
    labels = [(i, 0, 1) for i in range(30)] + [(500 + i, 1, 0) for i in range(30)] + [(1, 0, None), (None, 1, 0), (3, None, None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = hosts.judge_urls(pages, frame, queries.URL_RULES)
    by = {r["page_id"]: r for r in got.collect()}
    assert [by[i]["rule"] for i in range(len(URLS))] == ["www.example.com/en/", "net/es/", None, "net/es/", None, None, None, None, "com/", "com/", "com/", None]
    assert by[60]["verdict"] == "block" and by[210]["verdict"] == "allow" and by[None]["verdict"] == "block" and by[0]["verdict"] == "allow"
    assert got.count() == len(rows)
    for name, df in (("pages", pages), ("labels", frame)):
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    import duckdb

    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    assert parity.canonical(got.toPandas()) == parity.canonical(con.execute(queries.OP8_SQL).df())
    assert hosts.judge_urls(pages.limit(0), frame.limit(0), queries.URL_RULES).count() == 0
    assert hosts.judge_urls(pages, frame.limit(0), queries.URL_RULES).count() == len(rows)


def test_quantiles_of_beta_distributions(spark):
    import numpy as np

    pairs = [(0.5, 0.5), (0.5, 40.0), (1.0, 1.0), (2.5, 7.0), (30.0, 2.0), (200.0, 300.0), (900.0, 100.0), (5000.0, 5000.0)]
    df = spark.createDataFrame(pairs, "a double, b double").withColumn("q", hosts.upper_quantile(F.col("a"), F.col("b")))
    rng = np.random.default_rng(17)
    for r in df.collect():
        assert abs(r["q"] - np.quantile(rng.beta(r["a"], r["b"], 400_000), 0.95)) < 0.004, r


def test_what_a_level_lends_is_learned_from_the_counts(spark):
    import numpy as np

    rng = np.random.default_rng(18)
    for strength in (2.0, 20.0, 200.0):
        rows = [(f"g{k % 5}", int(n), int(rng.binomial(n, rng.beta(0.3 * strength, 0.7 * strength)))) for k, n in enumerate(rng.integers(1, 400, 3000))]
        df = spark.createDataFrame(rows, "above string, n long, good long")
        lent = hosts.lent_pages(df, ["above"], hosts.Reputation()).first()["lent"]
        assert strength / 1.4 < lent < strength * 1.4
    same = spark.createDataFrame([("g", 100, 50)] * 50, "above string, n long, good long")
    assert hosts.lent_pages(same, ["above"], hosts.Reputation()).first()["lent"] == 10_000
    for rows in ([("g", 100, 50)], [("g", 0, 0)], [("g", 9, 9), ("g", 3, 3)]):
        assert hosts.lent_pages(spark.createDataFrame(rows, "above string, n long, good long"), ["above"], hosts.Reputation()).first()["lent"] == 8


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op6_warc_archive", "op8_url_filter"])
def test_queries_equal_their_sql(spark, tiny, name):
    ok, said = parity.compare(spark, parity.connect(tiny), tiny, name)
    assert ok, said


PAGE = (
    '<html><body><header><h1>Site</h1></header><div id=wrap class="l2 main12"><div class="cookie-notice">We use</div><main><article class=post><h2>T &amp; U</h2><p>One<b>two</b> three<p>Four<br>five'
    ' <a href=x>link</a><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class="comments"><p>nice!</p></div><aside>s</aside><form><input>go</form></article></main><div class=sidebar>side</div></div><footer>f</footer>'
)


def text_of(source):
    return htmlmain.extract(htmlmain.parse(source), None)


def test_main_text_of_a_page():
    page = htmlmain.parse(PAGE)
    assert htmlmain.extract(page, None) == "T & U Onetwo three Four five link a b c d"
    assert page.path(htmlmain.best_container(page)) == "html/body/div.l#.main#/main/article.post"


@pytest.mark.parametrize("source, want", [("", ""), ("<", "<"), ("a < b", "a < b"), ("<p>x", "x"), ("<script>x", ""), ("<!-- open", ""), ("t &lt;b&gt; &nope; &#233;", "t <b> &nope; é"), ("<p>a</p>\n\n<p> b\n c </p>", "a b c"), ("<style>p{}</style><p>q", "q")])
def test_odd_pages(source, want):
    assert text_of(source) == want


def test_names_of_whole_pages_are_not_taken_for_their_parts():
    story = "<p>the story</p>"
    assert text_of(f"<div class='page has-sidebar no-comments'>{story}<div class=sidebar>s</div></div>") == "the story"
    assert htmlmain.main_text(f"<div class=sidebar>{story}<nav>n</nav></div>", None) == "the story"
    assert htmlmain.main_text("<nav>n</nav>", None) == ""


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>Hello world it is <a title='it's' href=x>a link</a> and don't stop</p>", "Hello world it is a link and don't stop"),
        ('<p>one <a title="it\'s > here">two</a> three <a href=x title="open>four</a> five</p>', "one two three four five"),
        ("<p title=>a</p><p =x y>b</p><p/class=c>c</p><a b='c>d</a> e", "a b c d e"),
        ("<p>5 </p 3 > 4</p> </> <! x> <?php y ?> z", "5 4 </> z"),
        ("<article><p>one</p><p class=\"lead notice-board\">the board</p><div class='social-history'>of towns</div></article>", "one the board of towns"),
        ("<article><p>one</p><div class='hinweis-box'>h</div><div class=articleComments>c</div><div class='comment-list'>c</div><div class='cookieBanner'>k</div></article>", "one"),
        ("<article><div class='post-header'>title</div><p>one</p><div class='related-towns'><a href=x>a town</a> <a href=y>b</a></div></article>", "title one"),
        ("<article><p>one<script>if (a < b) x('</p>')</script> two</p><SCRIPT>y</Script x>three</article>", "one two three"),
    ],
)
def test_quotes_and_names(source, want):
    assert text_of(source) == want


@pytest.mark.parametrize("piece", ["<a b=", "<a b=>", "<a b=\"", "<a b='\">", "<a b=\">'", "<!--", "<!-- >", "<script>", "<a ", "< ", "<a\t=", "</", "<p class='x y'", "<a b='<a c=\"", "&", "<b>", "</b>", "<li><p>", "<td>"])
def test_long_odd_pages_take_linear_time(piece):
    began = time.process_time()
    htmlmain.main_text(piece * (1_000_000 // len(piece)), None)
    htmlmain.main_text(piece * (1_000_000 // len(piece)) + "\"'>", None)
    assert time.process_time() - began < 20


LEAD, STORY = "lead " * 7, "story " * 11


@pytest.mark.parametrize(
    "source",
    [
        f"<body><div class=lead>{LEAD}</div><div class=body>{STORY}</div></body>",
        f"<body><div class=x><main><div class=lead>{LEAD}</div><div class=body>{STORY}</div></main><div>x</div></div></body>".replace("<div>x</div>", "<nav>x</nav>"),
        f"<body><table><tr><td>{LEAD}<td>{STORY}</table></body>",
        f"<p>{LEAD}</p><div class=body>{STORY}</div>",
        f"<body><p>{LEAD}</p><div class=body>{STORY}</div></body>",
    ],
)
def test_text_beside_the_largest_container_is_kept_without_article(spark, source):
    want = f"{LEAD}{STORY}".strip()
    assert text_of(source) == want
    pages = spark.createDataFrame([(i, f"http://h/{i}", source) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in htmlmain.extract_main_text(pages, Scratch(spark, "t")).collect()} == {want}


def test_a_path_with_little_of_a_page_is_not_followed():
    page = htmlmain.parse(f"<body><div class=a>by me</div><div class=b>{STORY * 9}</div></body>")
    assert htmlmain.extract(page, "body/div.a") == (STORY * 9).strip()
    assert htmlmain.extract(page, "body/div.b") == (STORY * 9).strip()


def test_deep_and_unclosed_pages_end():
    assert text_of("<div>" * 30000 + "q") == "q"
    assert text_of("<b>" * 30000 + "q" + "</i>" * 30000) == "q"
    assert text_of("<p>w " * 20000).startswith("w w w")


def test_hosts_outvote_a_page(spark):
    usual = "<body><div class=story1><p>" + "long text of the story. " * 10 + "</p></div><div class=extra><p>box</p></div></body>"
    short = "<body><div class=story2><p>short story</p></div><div class=extra><p>" + "a much longer box of other things " * 5 + "</p></div></body>"
    rows = [(i, f"http://h/{i}", usual) for i in range(5)] + [(9, "http://h/9", short), (10, "http://alone/1", "<p>only</p>"), (11, None, None), (12, "http://h/12", "<body><article>else</article></body>"), (9, "http://h/9", short)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for limit in (50_000, 0):
        got = htmlmain.extract_main_text(pages, Scratch(spark, "t"), broadcast_hosts=limit).collect()
        by = {r["page_id"]: r for r in got}
        assert len(got) == len(rows) and by[9]["text"] == "short story" and by[10]["text"] == "only" and by[11]["text"] == "" and by[12]["text"] == "else"
        assert by[9]["n_chars"] == len("short story")
    assert htmlmain.extract_main_text(pages.limit(0), Scratch(spark, "t")).count() == 0


def test_the_whole_table_against_its_template(spark, tiny):
    import html as entities
    import re

    got = {r["page_id"]: r["text"] for r in queries.op10_html_extraction(spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " "))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)
