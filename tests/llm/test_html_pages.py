"""Main text of hand-labelled pages whose shapes and names the built training pages do not have.

In each page the article's text is marked by hand with double square brackets, which are taken out before reading.
"""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import html_extract
from tallyframe.llm.dom import read_page

PAGES = {
    "news": """<html><body class="fonts-loaded"><div class="site-top"><a href="/">Gazette</a> <a href="/login">Log in</a></div>
<main><article><header><h1>[[River defences to be raised]]</h1></header><p>[[The council voted on Monday to raise the river wall by half a metre.]]</p>
<figure><img src="x.jpg"><figcaption>[[The wall at low tide.]]</figcaption></figure><p>[[Work starts in spring, <em>weather permitting</em>, and ends before winter.]]</p>
<aside class="promo"><a href="/s">Subscribe for more</a></aside></article></main><footer><a href="/i">Imprint</a> <a href="/p">Privacy</a></footer></body></html>""",
    "blog": """<body><div id="wrap-7"><div class="branding"><h2>Notes</h2></div><div class="entry-content"><h1>[[On bread]]</h1>
<p>[[Flour, water, salt and time.]]<p>[[Let it rest overnight; then shape it.]]<ul><li>[[500 grams of flour are enough for one loaf.]]<li>[[350 grams of water make a soft dough.]]</ul></div>
<div class="comments"><div class="comment"><p>Great recipe, thank you!</p></div></div></div></body>""",
    "paper": """<body><nav><ol><li><a href="#1">1</a><li><a href="#2">2</a></ol></nav><article><section class="abstract"><h2>[[Abstract]]</h2><p>[[We study sums.]]</p></section>
<section class="related-work"><h2>[[Related work]]</h2><p>[[Earlier papers study products instead of sums.]]</p></section><section id="social-history"><p>[[Sums have a long social history.]]</p></section></article></body>""",
    "table": """<body><main><h1>[[Opening hours]]</h1><table><tr><td>[[Monday]]</td><td>[[9 to 5]]</td></tr><tr><td>[[Sunday]]</td><td>[[closed all day]]</td></tr></table></main>
<div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>Accept</button></div></body>""",
    "wrapped": """<body><div><div><div><div><div id="q9"><article><p>[[Deeply wrapped text is text all the same.]]</p><noscript><p>[[It needs no scripts to be read.]]</p></noscript></article></div></div></div></div></div>
<footer>&copy; Nobody</footer></body>""",
    "quote": """<body><header class="masthead"><p>Daily words</p></header><article><blockquote><p>[[To be read aloud.]]</p></blockquote><pre>[[line of code]]</pre><p>[[A closing word &mdash; the last.]]</p></article>
<form><label>Search</label><input name="s"><button>Go</button></form></body>""",
    "bare": """<body><article>[[Text may stand in the article itself, without a paragraph around it.]]<br>[[A second line follows.]]</article><nav><a href="/">Home</a></nav></body>""",
}


def wanted(source):
    """Words of the marked parts, tags taken off and character references decoded."""
    import html

    marked = " ".join(re.findall(r"\[\[(.*?)\]\]", source, re.S))
    return html.unescape(re.sub(r"<[^>]+>", "", marked)).split()


def test_hand_labelled_pages():
    unary, pair = html_extract._built_in(html_extract.ExtractRules())
    hit = said = want = 0
    for name, source in PAGES.items():
        text = html_extract.main_texts([read_page(source.replace("[[", "").replace("]]", ""))], unary, pair, 0.5)[0].split()
        goal = wanted(source)
        common = sum(min(text.count(w), goal.count(w)) for w in set(goal))
        hit, said, want = hit + common, said + len(text), want + len(goal)
        print(name, common, len(text), len(goal))
    assert hit / said >= 0.95 and hit / want >= 0.95, (hit, said, want)


@pytest.mark.parametrize("deep", [600, 3000])
def test_nesting_has_no_limit(deep):
    unary, pair = html_extract._built_in(html_extract.ExtractRules())
    inner = "<p>deep one</p><svg>no text</svg>"
    page = f"<body><article>{'<div>' * deep}{inner}{'</div>' * deep}<p>after it</p></article></body>"
    assert html_extract.main_texts([read_page(page)], unary, pair, 0.5) == ["deep one after it"]
    assert html_extract.main_texts([read_page("<div>" * deep + inner)], unary, pair, 0.5) == ["deep one"]


def test_names_tell_only_as_a_whole():
    assert html_extract.name_kinds("related-work social-history") == set()
    assert html_extract.name_kinds("related-posts comment-list") == {"side", "comment", "body"} or html_extract.name_kinds("related-posts comment-list") == {"side", "comment"}
    assert html_extract.name_kinds("") == set()


def test_repeated_rows_and_ties(spark):
    source = "<body><article><p>same text here</p></article></body>"
    pages = spark.createDataFrame([(1, "u", source), (1, "u", source), (None, None, source)], "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == 3 and {r.text for r in got} == {"same text here"}
    # a marginal equal to the threshold is content
    none = html_extract.np.zeros(len(html_extract.FEATURES)), html_extract.np.zeros((len(html_extract.KINDS), 2, 2))
    assert html_extract.main_texts([read_page("<p>half</p>")], *none, 0.5) == ["half"]
