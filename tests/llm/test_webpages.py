"""Main text of pages of several layouts, of broken and hostile markup, and of the whole test table against its known template."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roiscore.llm.queries import QUERIES
from roiscore.llm.webpages import extract, main_text, smoothed, threshold

SF = "/root/testdata/sf0.001"
LONG = [" ".join(f"word{k}" for k in range(n, n + 40)) + "." for n in (0, 100, 200)]
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(8)) + "</ul>"


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article><h1>Title</h1>{paragraphs(*LONG)}</article><footer>© 2020 Somebody</footer></body></html>",
        f"<body><div id='menu'>{MENU}</div><div id=content><h1>Title</h1>{paragraphs(*LONG)}</div><div class='sidebar-right'><p>{LONG[0]}</p></div><div id='comments'><p>{LONG[1]}</p></div></body>",
        f"<body><header><h2>Site</h2><p>Slogan</p></header><main><header><h1>Title</h1><p>By us</p></header>{paragraphs(*LONG)}<aside>{LONG[0]}</aside><form><p>Send us {LONG[0]}</p><input></form></main></body>",
        f"<table><tr><td>{MENU}</td><td><h1>Title</h1>{paragraphs(*LONG)}</td></tr></table>",
        f"<div class='cookie-notice'>{LONG[2]}</div><h1>Title</h1><p>{LONG[0]}<p>{LONG[1]}<p>{LONG[2]}<div class=ad>Buy</div>",
        f"<form action=x><div class='has-sidebar'><article><h1>Title</h1>{paragraphs(*LONG)}</article></div></form><section class=comments><article><p>{LONG[0]}</p></article></section>",
        f"<body>{MENU}<h1>Title</h1>{paragraphs(*LONG)}{MENU}<p>Copyright 2020 Somebody</p></body>",
        f"<article><h1>Title</h1><script>var a='<p>{LONG[0]}</p>';</script><noscript>{LONG[0]}</noscript>{paragraphs(*LONG)}<!-- {LONG[0]} --><div style='display: none'>{LONG[0]}</div></article>",
    ],
)
def test_layouts(page):
    assert main_text(page) == "\n\n".join(["Title", *LONG])


def test_blocks_white_space_and_references():
    page = "<article><h1>A &amp;&nbsp;B</h1><p>one<br>two\n\t three <b>fo</b>ur &lt;x&gt; &#233; &eacute</p>bare <i>text</i><ul><li>first<li>second</ul><p>  </p><p>x</p></article>"
    assert main_text(page) == "A & B\n\none two three four <x> é é\n\nbare text\n\nfirst\n\nsecond\n\nx"


def test_short_paragraphs_between_long_ones_stay():
    assert main_text(f"<nav>{MENU}</nav><div><p>{LONG[0]}</p><p>No.</p><p>{LONG[1]}</p><p>Yes.</p></div>") == f"{LONG[0]}\n\nNo.\n\n{LONG[1]}\n\nYes."


def test_what_has_no_text():
    for page in ("", "   ", "<p></p>", f"<nav>{MENU}</nav>", "<script>x</script>", "<!-- x", "<a <a <a", "<p"):
        assert main_text(page) == ""
    assert main_text("just text &amp; no tags") == "just text & no tags"
    assert main_text(f"<div class=widget><p>{LONG[0]}</p></div>") == LONG[0]  # names around all there is count for nothing


@pytest.mark.parametrize("unit", ["<a ", '<a b=">" ', "<!--", "<", "&", "&#", "</", "<![", "<?", "<div>", "</div>", "<p>x", "<table><tr><td>x", "<article><p>", "<a href='", "<b>", "<ul><li>x", "<br>x "])
def test_hostile_pages_take_linear_time(unit):
    began = time.perf_counter()
    main_text(unit * 20_000)
    assert time.perf_counter() - began < 8


def test_ratios_are_smoothed_and_cut_between_two_clusters():
    x = np.array([1.0, 2, 30, 40, 1])
    weights = np.exp(-0.5 * np.arange(-2, 3.0) ** 2)
    plain = [sum(weights[2 + j - i] * x[j] for j in range(5) if abs(j - i) <= 2) / sum(weights[2 + j - i] for j in range(5) if abs(j - i) <= 2) for i in range(5)]
    assert np.allclose(smoothed(x), plain)
    spread = lambda t: sum(((p - p.mean()) ** 2).sum() for p in (x[x >= t], x[x < t]) if len(p))
    assert spread(threshold(x)) == min(spread(t) for t in (1.5, 16, 35)) and threshold(np.array([3.0, 3.0])) == 3


def test_rows(spark):
    page = f"<article><p>{LONG[0]}</p></article>"
    rows = [(1, "u", page, 0, "x"), (1, "u", page, 0, "x"), (None, None, None, 0, None), (2, "v", "", 0, "y"), (3, "w", "<p>é" + "日本 " * 200_000, 1, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    assert extract(df).count() == 5 and extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert got[1, "u"] == (LONG[0], len(LONG[0])) and got[None, None] == got[2, "v"] == ("", 0) and got[3, "w"][1] == 600_000
    assert extract(df.limit(0)).count() == 0


def test_whole_table(spark):
    def expected(page):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
        return "\n\n".join(x for x in parts if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op11_main_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == {k: expected(v) for k, v in pages.items()} and all(r.n_chars == len(r.text) for r in got)
    plan = QUERIES["op11_main_text"](spark, SF).select(F.col("n_chars"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
