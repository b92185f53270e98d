import re
import time
from html import unescape

import duckdb
import numpy as np
import pytest

from groundling.llm import html_text, queries
from groundling.llm.html_text import extract, extract_main_text


def plain(html):
    """Article of the test pages, whose markup is known."""
    body = re.search(r"(?s)<article>(.*?)</article>", html)[1]
    return " ".join(unescape(re.sub(r"</?(?:h1|p|b|br|i|a)\b[^>]*>", lambda m: " " if m[0][1:3] in ("h1", "p>", "br", "/h", "/p") else "", body)).split())


def test_query(spark):
    d = "/root/testdata/sf0.01"
    pages = dict(duckdb.sql(f"select page_id, html from '{d}/pages.parquet'").fetchall())
    rows = queries.op8_main_text(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


LONG = "A sentence of the story that goes on for quite a while. " * 3
CASES = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    ("just text &amp; more", "just text & more"),
    (f"<body><header>Site</header><div id=content><p>{LONG}<p>Short.<form>Name</form></div><div class=sidebar>{LONG}</div></body>", f"{LONG.strip()} Short."),
    (f"<div class='page no-sidebar'><article><header><h1>T</h1><p>by me</p></header><p>x<b>y</b>\n z<br>w</p><div class='comments'><article>{LONG}</article></div></article></div>", "T xy z w"),
    ("<article><p>a</p><script>var x='</p><p>bad'</script><!-- c --><aside>no</aside><ul><li>1<li>2</ul><footer>f</footer></article>", "a 1 2"),
    ("<main><div class='cookie-notice'>ok?</div><p>caf&eacute;&nbsp;&#x1F600;</p></main>", "café 😀"),
    (f"<body><div><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div><div><h1>Title</h1></div><div><p>{LONG}</p><p>{LONG}</p></div><p>End <a>link</a>.</p></div></body>", f"Title {LONG.strip()} {LONG.strip()} End link."),
    (f"<body><div class='content with-sidebar'><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div class=sidebar>Other words</div></body>", f"{LONG.strip()} {LONG.strip()} Short."),
    (f"<body><form id=aspnet><nav><a>x</a></nav><div><p>{LONG}</p><p>{LONG}</p></div></form><footer>{LONG}</footer></body>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<body><article><p>{LONG}</p><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article></body>", f"{LONG.strip()} {LONG.strip()} One Two"),
    ("<body><nav>a b</nav><article><h1>Tiny.</h1></article><footer>Words of a footer that are longer than all else here.</footer></body>", "Tiny."),
    ("<article><p>unclosed <b>bold<p>next<div>and <i>more", "unclosed bold next and more"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    assert extract(html)[0] == text


def test_table(spark):
    df = spark.createDataFrame([(1, h, "x") for h, _ in CASES] + [(1, "<article>" + "<p>w</p>" * 50_000, "x")], "page_id long, html string, text string")
    rows = extract_main_text(df).collect()
    assert [r.main.text for r in rows][: len(CASES)] == [t for _, t in CASES]
    assert len(rows[-1].main.text) == 99_999
    assert extract_main_text(df.limit(0)).count() == 0
    clash = extract_main_text(df, out_col="Text")
    assert clash.columns == ["page_id", "html", "Text_1", "Text"] and {r.Text_1 for r in clash.collect()} == {"x"}


def test_without_article_elements():
    """The content lines alone find nearly all articles."""
    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    plain_pages = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]
    assert sum(extract(h)[0] != plain(p) for h, p in zip(plain_pages, pages, strict=True)) <= 0.02 * len(pages)


def test_ratios_decide(monkeypatch):
    """With random numbers in their place other texts come out, even where the page has an article element."""
    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smoothed", lambda ratio, sigma=1.0: rng.random(len(ratio)))
    assert sum(extract(h)[0] != plain(h) for h in pages) >= 0.03 * len(pages)


@pytest.mark.parametrize("make", [lambda n: "<div>x" * n, lambda n: "<span>" * n + "<h1>a</h1>" * n, lambda n: "<li><div>" + "<span>" * n + "<li>a</li>" * n, lambda n: "<b>" * n + "x</i>" * n])
def test_deep_pages(make):
    """Four times the page, about four times the time."""

    def took(n):
        began = time.perf_counter()
        extract(make(n))
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 10 * min(took(10_000) for _ in range(2)) + 0.5
