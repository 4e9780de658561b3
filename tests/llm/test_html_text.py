import html
import re
import time
from collections import Counter

from marketloom.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<div id="cookie-notice">We use cookies on this site and you agree to all of them.</div>
<header class="site-header"><h1>The Daily</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href=/b>World</a></li></ul></nav>
<!-- <p>comment</p> --><aside>Read also this one</aside>
%s
<section id="comments"><article class="comment"><p>I think that this is the best of all the articles that I have read so far, and more.</p></article></section>
<form><p>Subscribe to the newsletter and get the news of the day</p></form><footer>&copy; 2024 &middot; all rights reserved in the end.</footer></body></html>"""
BODY = ["A heading", "It is a long sentence with the words that all of us use in the text of a page &amp; more, and it goes on so that it is over the limit of a long block, which is two hundred characters or so at the least.", "Short.", "Another one of the paragraphs that are in the page, with all of the words\n that  we have &#233;t&eacute; used for it and for the others; it has a <a href='x'>link</a> in it and <b>bold</b><br>text, and that is all that there is to it, I say."]
WANT = "\n\n".join(re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:a|b)\b[^>]*>", "", b.replace("<br>", " ")))).strip() for b in BODY)


def test_article_element():
    body = "<article><h2>" + BODY[0] + "</h2>" + "".join(f"<p>{b}</p>" for b in BODY[1:]) + "</article>"
    assert main_text(PAGE % body) == WANT


def test_plain_divs():
    body = "<div class='wrap'><h2>" + BODY[0] + "</h2>" + "".join(f"<div>{b}</div>" for b in BODY[1:]) + "</div><div class='ad'>Buy this and that now, it is the best of all.</div>"
    assert main_text(PAGE % body) == WANT


def test_unclosed_tags_as_in_the_table():
    page = '<body><nav><ul><li><a href="/x">x</a></ul></nav><div class="ad">Was ist das für ein Tag.</div><article><h1>Title &amp; more</h1><p><b>First one.<br><p>Second.</p><p>X</article><footer>&copy; a &middot; Und das.</footer>'
    assert main_text(page) == "Title & more\n\nFirst one.\n\nSecond.\n\nX"
    assert main_text(page.split("<footer>")[0].removesuffix("</article>") + " &am") == "Title & more\n\nFirst one.\n\nSecond.\n\nX &am"


def test_edge_cases(spark):
    odd = [None, "", "<", "<p", "just text", "<script>never closed <p>x</p>", "<p>" * 3000 + "x", "<a href='" * 500, "</div></p>", "<p>" + "word and the " * 60_000]
    df = spark.createDataFrame([(i, "u", x, 5) for i, x in enumerate(odd)] + [(None, None, "<p>x</p>", None)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == len(odd) + 1 and got[0].text == got[1].text == got[5].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert got[9].text == ("word and the " * 60_000).strip()
    assert extract(df.limit(0)).count() == 0


def test_whole_table(spark, sf_small):
    """Every page's article, cut out by the table's own markup."""
    for r, page in ((r, r.html) for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", " ", x))).strip() for x in parts]
        assert main_text(page) == "\n\n".join(x for x in want if x), r.page_id


def test_density_decides_where_no_article_is_marked(spark):
    """250 pages without their article tags, and without the names of their adverts: recall and precision of blocks."""
    for advert in ('class="ad"', ""):
        right = wanted = found = 0
        for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
            bare = re.sub(r"</?article>", "", r.html).replace('class="ad"', advert)
            want, got = (Counter(main_text(x).split("\n\n")) for x in (r.html, bare))
            right, wanted, found = right + (want & got).total(), wanted + want.total(), found + got.total()
        assert right >= 0.9 * wanted and right >= 0.9 * found, advert


def test_blocks_of_links_within_an_article():
    """A long list of links goes, wherever it stands; a short linked line follows its neighbours."""
    links = "<p>" + " ".join(f"<a href='/{i}'>some other story {i}</a>" for i in range(20)) + "</p>"
    line = "<p>See <a href=x>the first part</a></p>"
    rare = "<p>" + "Xylophone quartz " * 8 + "</p>"
    kept = main_text(f"<article><p>{BODY[1]}</p><p>{BODY[3]}</p></article>")
    assert main_text(f"<article><p>{BODY[1]}</p>{links}<p>{BODY[3]}</p></article>") == kept
    assert main_text(f"<div><p>{BODY[1]} {BODY[1]}</p>{links}<p>{BODY[3]}</p></div>") == main_text(f"<div><p>{BODY[1]} {BODY[1]}</p><p>{BODY[3]}</p></div>") != ""
    assert "See the first part" in main_text(f"<article><p>{BODY[1]}</p>{line}<p>{BODY[3]}</p></article>")
    assert "Xylophone" in main_text(f"<article><p>{BODY[1]}</p>{rare}<p>{BODY[3]}</p></article>")
    assert "Xylophone" not in main_text(f"<article><p>{BODY[1]}</p>{links}{rare}{links}</article>")


def test_short_pages_links_and_stray_tags():
    assert main_text("<p>Text one</p><p>Hello there</p>") == "Text one\n\nHello there"
    linked = "<article><p>See <a href=x>all of this long link text here that is most of it</a></p><p>The cat of the house is on the mat and that was it for the day, they said to all of us.</p></article>"
    assert main_text(linked).startswith("See all of this long link text")
    listed = "<div>" + "".join(f"<div><a href={i}>Some title of a page that is long enough to be read and of the kind {i}</a></div>" for i in range(4)) + "</div>"
    assert main_text(listed + f"<p>{BODY[1]} {BODY[1]}</p>" + listed) == main_text(f"<p>{BODY[1]} {BODY[1]}</p>") != ""
    started = time.time()
    assert main_text("<div>" * 20_000 + "x" + "</section>" * 20_000) == "x" and time.time() - started < 5
