"""The extractor on layouts written by hand, with their main text beside them, and on odd tables."""

import time

import pytest

from corpusaudit.llm import html

SMALL = "/root/testdata/sf0.01"
ONE = "The council met on Monday to talk about the new bridge over the river, and it did not agree on a plan."
TWO = "A second meeting has been called for next week, at which the engineers will show three other designs."
THREE = "Most people in the town say that they would be glad of any bridge at all, whatever it looks like."
ALL = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = [ONE, TWO, THREE]
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav>"
FOOT = "<footer>&copy; 2024 The Paper</footer>"
LAYOUTS = [
    (f"{MENU}<article>{ALL}</article>{FOOT}", TEXT),
    (f"{MENU}<main><h1>A bridge</h1>{ALL}</main>{FOOT}", ["A bridge", *TEXT]),
    (f"{MENU}<div class=post>{ALL}</div>{FOOT}", TEXT),
    (f"{MENU}<div id=story>{ONE}<br><br>{TWO}<br><br>{THREE}</div>{FOOT}", [f"{ONE} {TWO} {THREE}"]),
    (f"{MENU}<div id='blog-entry'><h2>A bridge</h2>{ALL}</div>{FOOT}", ["A bridge", *TEXT]),
    (f"<article><p>{ONE}</p><aside><p>Read also what the mayor said about it last year in our long talk.</p></aside><p>{TWO}</p><p>{THREE}</p></article>", TEXT),
    (f"<article><p>{ONE}</p><div class=advertisement><p>Buy our bread now, it is the best bread that you have had.</p></div><p>{TWO}</p><p>{THREE}</p></article>", TEXT),
    (f"<article>{ALL}<div class='user-remarks'><p>I think that the old bridge was good enough for all of us.</p></div></article>", TEXT),
    (f"<article>{ALL}<section class=comments><h3>Comments</h3><p>No, it was not, and everyone knows it very well.</p></section></article>", TEXT),
    (f"<div class=cookie-notice><p>We use cookies to make this page work, and to count our readers.</p><button>OK</button></div><article>{ALL}</article>", TEXT),
    (f"<header><a href=/>The Paper</a></header><section class=story>{ALL}</section><div class=related><ul><li><a href=x>Other news of the day</a></ul></div>", TEXT),
    (f"<div class=sidebar><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class='article-body'>{ALL}</div>", TEXT),
    (f"<article><h1>A &amp; B</h1><p>x &lt; y, she&nbsp;said:   {ONE}</p><script>var p='<p>no</p>'</script>{ALL}</article>", ["A & B", f"x < y, she said: {ONE}", *TEXT]),
    (f"<form><label>Search</label><input name=q><p>Type a word and press the key.</p></form><main>{ALL}</main>", TEXT),
    (f"<main><blockquote><p>{ONE}</p></blockquote><p>{TWO}</p><ul><li>{THREE}</li></ul></main>{FOOT}", TEXT),
    (f"<table><tr><td class=menu><a href=1>Home</a> <a href=2>News</a></td><td class=content>{ALL}</td></tr></table>", TEXT),
    (f"<article>{ALL}<form class=newsletter><p>Get our letter every day, at no cost to you.</p></form></article>", TEXT),
    (f"<body><div class=wrapper><div class='entry-content'>{ALL}</div><div id=comments><ol class=commentlist><li>So it is, my friend, so it is, and more.</li></ol></div></div>", TEXT),
    (f"<article>{ALL}</article><div class=share><a href=f>Share</a> <a href=t>Send</a></div><div class=copyright>All rights kept</div>", TEXT),
    (f"<style>p{{}}</style><noscript><p>Turn on scripts to read this page as it should be.</p></noscript><article>{ALL}</article>", TEXT),
    (f"<main><article>{ALL}</article><aside><h3>Most read</h3><ul><li><a href=1>Fire in the old mill</a></ul></aside></main>", TEXT),
    (f"{MENU}<div class='xkq plom'><div>{ALL}</div></div>{FOOT}", TEXT),
]


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_layouts_written_by_hand(model):
    wrong = [(page, model.extract(page)) for page, want in LAYOUTS if model.extract(page) != "\n".join(want)]
    assert len(LAYOUTS) >= 20 and not wrong


def table(spark, pages):
    return spark.createDataFrame([(i, "u", p, 1) for i, p in enumerate(pages)], "page_id bigint, url string, html string, rank int")


def long_page(i, paragraphs):
    text = [f"Paragraph {k} of page {i} says that the river is high, and that it will rise for some days more." for k in range(paragraphs)]
    return f"<html><body>{MENU}<article>" + "".join(f"<p>{t}</p>" for t in text) + f"</article>{FOOT}", "\n".join(text)


@pytest.mark.parametrize("paragraphs", [200, 1500])
def test_tables_of_long_pages(spark, paragraphs):
    """Pages of many blocks are trained on in stretches and extracted whole."""
    pages = [long_page(i, paragraphs) for i in range(8)]
    df = table(spark, [p for p, _ in pages] * 2)
    got = {r["page_id"]: r["text"] for r in html.extract(df, html.fit(df)).collect()}
    assert got == {i: pages[i % 8][1] for i in range(16)}


def test_tables_without_labels_and_without_text(spark):
    pages = [f"<body>{MENU}<div class=post><p>{i} {ONE}</p><p>{TWO}</p><p>{THREE}</p></div>{FOOT}" for i in range(20)]
    df = table(spark, pages)
    got = [r["text"] for r in html.extract(df, html.fit(df)).orderBy("page_id").collect()]
    assert got == [f"{i} {ONE}\n{TWO}\n{THREE}" for i in range(20)]
    empty = table(spark, ["", None, "<div></div>"])
    assert [r["text"] for r in html.extract(empty, html.fit(empty)).collect()] == [""] * 3


@pytest.mark.parametrize("unit", ["<script ", '<a x="', "<div>x", "<div><select>", "<svg ", "<svg>", "<!--", "</x>", "<ul><li>", "<select>"])
def test_time_follows_the_length(unit):
    page = unit * (300_000 // len(unit))
    start = time.process_time()
    html.blocks(page)
    assert time.process_time() - start < 4
