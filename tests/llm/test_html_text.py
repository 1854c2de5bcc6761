"""Text extraction from pages built around a known article."""

import html
import random
from html.parser import HTMLParser

import pytest

from marlstone.llm.html_text import extract, main_text, op2_html_text

from ..oracle import FOLDER

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">menu</a><li><a>b</a></ul></nav><div class="cookie-notice">We use cookies on this page, which is a long line of text that is no article</div>
<article><header><h1>Title &amp; more</h1></header><p class="ad">buy<p>First  para <a href="x>y">link</a> with
newline<br>and break &nbsp; &eacute;&#8212;</p><aside>side</aside><div class=comments><p>c1</p></div><form><p>f</p></form><script>var a="</p>"; if(a<b){}</script><p>Last <b>one</p></article>
<section id="comments"><p>A reader said something at length, again and again, at length</p></section><footer>foot</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == ["Title & more", "First para link with newline and break é—", "Last one"]


class Plain(HTMLParser):
    """The blocks inside a page's article, for pages made of few elements."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks.append("") if tag in ("article", "h1", "p") else self.handle_data(" ") if tag == "br" else None

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("folder", ["0.001", "0.01"])
def test_whole_table_equals_plain_parser(spark, folder):
    """Every page of the table, parsed apart; and found by windows alone, with the article element renamed."""
    path = FOLDER.replace("0.001", folder)
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    found = op2_html_text(spark, path).collect()
    assert len(found) == len(pages)
    for r in found:
        page = pages[r["page_id"]]
        want = [" ".join(b.split()) for b in Plain(page).blocks if b.split()]
        assert r["text"] == "\n\n".join(want) and r["n_chars"] == len(r["text"])
        assert main_text(page.replace("<article", "<div").replace("</article", "</div")) == want


def test_nothing_else_is_dropped():
    page = """<article><p>before</p><p hidden>kept</p><p style="display:none">this too</p><math><mi>x</mi> = <mn>1</mn></math><svg><text>drawn</text></svg>
<h2 id="related-work">Related work</h2><section class="social-history"><p>Society</p></section><p id="form-and-function">Form</p><p class="search-algorithms">Search</p>
<object>fallback</object><select><option>one</option></select><textarea>typed</textarea><div class="cookie-banner">no</div><div id="comments">no</div><div class="ad-slot"><p>no</p></div></article>"""
    assert main_text(page) == ["before", "kept", "this too", "x = 1drawn", "Related work", "Society", "Form", "Search", "fallback"]


def test_planted_articles():
    random.seed(1)
    for _ in range(200):
        blocks = [" ".join(random.choice(["ab", "<c>", "d&e", "é", '"q"']) for _ in range(random.randint(1, 40))) for _ in range(random.randint(1, 9))]
        body = "".join(f"<p>{html.escape(b).replace(' ', random.choice([' ', '  ', chr(10)]))}</p>" for b in blocks)
        page = f"<nav>m</nav><div class='ad'>buy now</div><article>{body}</article><!-- <p>x</p> --><footer>f</footer>"
        assert main_text(page) == [" ".join(b.split()) for b in blocks]


def test_without_article_element():
    page = "<div><a href=1>One</a> <a href=2>Two</a></div><div><h1>Big title</h1><div>" + "word " * 40 + "</div><p>short end.</p></div><div><a href=q>l1</a><a>l2</a></div>"
    assert main_text(page) == ["Big title", ("word " * 40).strip(), "short end."]


def test_article_beside_the_text():
    body = [f"Paragraph {k} of the text proper, " + "which goes on for a good while and says something " * 3 for k in range(4)]
    card = "<article class='card'><p>A teaser of a few words</p></article>"
    gap = "".join(f"<div><a href='/{k}'>link {k}</a></div>" for k in range(4))
    text = "".join(f"<div>{b}</div>" for b in body)
    want = [" ".join(b.split()) for b in body]
    assert main_text(card + gap + text) == main_text(text + gap + card) == want
    assert [b for b in main_text(card + text) if b in want] == want


def test_windows_decide_inside_and_outside_articles():
    long, gap = "word " * 40, "<div>stray words</div>" + "".join(f"<div><a href='/{k}'>link {k}</a></div>" for k in range(4))
    page = f"<article><p>{long}</p></article>{gap}<article><p>card</p></article>"
    assert main_text(page) == [long.strip()]


def test_edges():
    assert main_text(None) == main_text("") == []
    assert main_text("<p>unclosed <b attr='x") == ["unclosed"]
    assert main_text("<p>a<script>never closed") == ["a"]
    assert main_text("<p>a<!-- never closed") == ["a"]
    assert main_text("just a few words") == ["just a few words"]


def test_columns(spark):
    pages = spark.createDataFrame([(1, PAGE, "old"), (2, None, None)], "page_id long, html string, text string")
    rows = {r["page_id"]: r for r in extract(pages).collect()}
    assert rows[1]["n_blocks"] == 3 and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] == "" and rows[2]["n_chars"] == 0
    assert extract(pages.limit(0)).count() == 0
