import random
import time

import numpy as np
import pytest

from fleetwright.llm import html_extract, url_cascade
from fleetwright.llm.queries import URL_RULES

URLS = [
    "http://www.example.org/es/1", "https://EXAMPLE.org/en/12?x", "https://example.org/en/2", "http://a.com/fr/", "http://a.com/fr",
    "http://com/de/9", "http://x.net/de/1", None, "no scheme /es/", "ftp://example.org", "http://notexample.org/es/1",
    "http://a://b.org/x", "http://exa\nmple.org/\n", "://org/", "http://sub.a.b.org/#f", "http://ÉX.com/de/é?q", "", "http://org",
]


def plain_judge(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, default)


def test_judge(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)] * 2,
                                  "page_id long, url string, keys string, host string")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    got = url_cascade.judge(pages, rules).collect()
    want = [(i, *plain_judge(u, URL_RULES)) for i, u in enumerate(URLS)] + [(None, *plain_judge(URLS[0], URL_RULES))] * 2
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_judge_without_rules_or_pages(spark):
    kind = "verdict string, host string, path string"
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert [r["verdict"] for r in url_cascade.judge(pages, spark.createDataFrame([], kind), "block").collect()] == ["block"]
    rules = spark.createDataFrame([*URL_RULES, ("block", "org", "/"), (None, "x", "/")], kind)
    assert url_cascade.judge(pages.limit(0), rules).collect() == []
    assert [r["verdict"] for r in url_cascade.judge(pages, rules).collect()] == ["block"]


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-2**63, 2**63, 30_000))
    listed = set(rng.choice(keys, 3000, replace=False).tolist())
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    cascade = url_cascade.build(spark.createDataFrame([(k,) for k in listed], "key long"), frame)
    assert len(cascade.levels) > 2
    said = cascade.listed(keys.astype(np.uint64))
    assert set(keys[said].tolist()) == listed
    bits = sum(level[0] for level in cascade.levels)
    assert bits < 16 * 3000  # far less than the keys themselves


def test_filter_size_is_bounded():
    with pytest.raises(ValueError):
        url_cascade.shape(10**10, 0.01)


PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>'
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="ad">Buy</div>'
        '<article><h1>Head &amp; more</h1><p>One <b>bo</b>ld&nbsp;\n two<br>three<p>Unclosed <i>x<p>Quoted line</article>'
        '<section class="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>')


def test_main_text_by_marks():
    assert html_extract.main_text(PAGE, set()) == "Head & more One bold two three Unclosed x Quoted line"
    assert html_extract.main_text("", set()) == "" and html_extract.main_text("<p>a<p>b&lt;", set()) == "a b<"
    assert html_extract.main_text("<div id=x><span>a</span>b</div><form>f</form>&#x41;", set()) == "ab A"
    assert html_extract.main_text("<article><p>open <table><tr><td>1<td>2</article> <p>after", set()) == "open 1 2"
    assert html_extract.main_text("a < b <3 <!-- open", set()) == "a < b <3"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_extract.main_text(deep, set()) == "deep"


@pytest.mark.parametrize("page,text", [
    ("one <svg/> two", "one two"), ("one <iframe src='x'/> two", "one two"), ("one <object> two", "one two"),
    ("one <svg><path/></svg> two <svg> three", "one two three"), ("one <!--> two", "one two"), ("one <!---> two", "one two"),
    ("one <!-- x --> two <!-- open", "one two"), ("<p title=\"x>link</p> two", "link two"), ("<div <p>one</p> two", "one two"),
    ("one <script>x < y</script> two <script> open", "one two"), ("a <b title='>'>c</b> d", "a c d"), ("one </svg> two", "one two"),
    ("<button>no</button> yes <button> open", "yes open"), ("1 < 2 and <3 >", "1 < 2 and <3 >")])
def test_broken_markup(page, text):
    assert html_extract.main_text(page, set()) == text


@pytest.mark.parametrize("part", ['<a "', "<a '", "<svg>", "<!--", "<a " + "n" * 200, "</", "<div ", '<p "">', "<p><div>", "<a b='c\"d' "])
def test_long_broken_pages_are_read_in_time(part):
    started = time.perf_counter()
    html_extract.read_tree(part * (1_000_000 // len(part)))
    html_extract.read_tree("<" + "x" * 1_000_000 + ' "')
    assert time.perf_counter() - started < 10


def test_templates_are_found_per_host(spark):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(10**6)
    rows = []
    for i in range(40):
        host = "a.org" if i % 2 else "b.org"
        text = " ".join(word() for _ in range(30))
        body = (f"<div>{'Menu A' if host == 'a.org' else 'Menu B'} <p>Tagline</p></div><div><p>{text}</p>"
                f"<p>A line that many pages quote.</p></div>")
        rows.append((i, f"http://{host}/{i}", f"<html><body>{body}</body></html>", text))
    rows += [(100, None, None, ""), (101, "http://a.org/x", "", ""), (102, "http://c.org/", "<div>Menu A</div><p>alone</p>", "Menu A alone")]
    pages = spark.createDataFrame([(i, u, h, "t", "d") for i, u, h, _ in rows],
                                  "page_id long, url string, html string, template string, digest string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for i, url, _, want in rows:
        assert got[i]["text"] == (want if i >= 100 else want), (i, got[i]["text"])
        assert got[i]["url"] == url and got[i]["n_chars"] == len(got[i]["text"])
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_article_paragraphs_and_copies_are_no_template(spark):
    page = "<nav>N</nav><article><div><p>Same article</p><p>everywhere</p></div><div class=x>Share this</div></article>"
    pages = spark.createDataFrame([(i, "http://h/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(pages).collect()} == {"Same article everywhere"}


def test_copies_without_article_keep_their_text(spark):
    text = "<p>First of the text</p><p>Second of it</p><p>Third of it</p>"
    rows = [(i, f"http://h/a?v={i}", f"<div>{text}</div>") for i in range(6)]
    rows += [(10 + i, f"http://h/{i}", f"<div>Menu</div><div><p>Only here {i} and here</p></div>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {i: "First of the text Second of it Third of it" if i < 10 else f"Only here {i - 10} and here" for i, *_ in rows}


def test_real_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for row in html_extract.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source[row["page_id"]], re.DOTALL)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert row["text"] == " ".join(html.unescape(plain).split())
