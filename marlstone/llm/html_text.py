"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element with text of its own. Lines are weighed by their characters
outside links. Sums over ``WINDOW`` consecutive lines surge where the main text begins and dive to nothing where it ends;
the lines between are the text, joined in page order.

What the windows cannot see is told beforehand. Elements that never hold the article give no lines: navigation, headers,
footers, sidebars, menus, notices, forms and their controls, scripts and styles, by their tag or role; adverts, notices,
reader comments and the like also by a class or id that consists of such words alone (``ad``, ``cookie-banner``), while one
that merely contains such a word (``related-work``, ``social-history``) decides nothing, and ids of headings and
paragraphs, which are made from their text, are not looked at. Article elements are a check on the weights: where they
hold most of a page's text outside links, lines outside them count nothing and lines of links inside them count one;
otherwise they are elements like others. Nothing else is left out: hidden text, formulas, drawings' texts and fallback
contents of embedded objects are text like other.

Defined results: a null or empty page gives an empty text; white space inside a block, references and line breaks
turn into one space; malformed markup (unclosed elements, stray ends, quotes) is read as browsers mostly do, and an
unclosed comment or script runs to the end of the page; a very long page takes a few times its size; equal pages give equal texts; an empty table gives an empty
result; other columns are carried along and those named like an added column are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried, numbered, small_batches

WINDOW, SURGE = 3, 86

_SKIP = frozenset("nav header footer aside form button menu dialog fieldset label input datalist select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark an element as no part of the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager search form alert".split()
)
#: Words that may stand beside them and say nothing about the content.
_BESIDE = frozenset(
    "area bar block blocks body bottom box center col column container content group holder inner item items left list main module outer page panel post posts right row "
    "section side site slot story stories text thread top unit user users widgets wrap wrapper zone google article articles global primary secondary".split()
)
#: Elements whose ids are made from their text.
_NAMED_BY_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure table dl dt".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z](?P<loose>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def _outside(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element and all in it are no part of the article."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in _SKIP and not (tag == "header" and in_article):
        return True
    if "=" not in attrs:
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "class" or name == "id" and tag not in _NAMED_BY_TEXT:
            for word in value.split():
                parts = {p.lower() for p in _PARTS.findall(word)}
                if parts & _NAMES and parts <= _NAMES | _BESIDE and not (in_article and parts & {"header"}):
                    return True
    return False


def lines(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines: text, characters outside links, and whether the line lies in an article."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is outside
    held: list[tuple[str, bool]] = []
    skipping = articles = links = at = 0

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                plain = len(" ".join(html.unescape("".join(t for t, in_link in held if not in_link)).split()))
                out.append((text, plain, articles > 0))
            held.clear()

    def pop(to: int) -> None:
        nonlocal skipping, articles, links
        while len(stack) > to:
            tag, outside = stack.pop()
            skipping -= outside
            articles -= tag in ("article", "main")
            links -= tag == "a"

    for m in _TOKEN.finditer(page):
        if m.start() > at and not skipping:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        if m["raw"] and m["raw"].lower() in ("iframe", "textarea"):
            held.append((" ", False))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in _BLOCK:
            close()
        elif tag == "br":
            held.append((" ", False))
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK and tag not in ("html", "body"):  # a block ends an open paragraph, a list item the one before
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or tag == "li" and stack[k][0] == "li":
                    pop(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        outside = tag == "head" or _outside(tag, m["attrs"], articles > 0)
        if tag == "body":  # a body begins whatever the head left open
            pop(0)
        stack.append((tag, outside))
        skipping += outside
        articles += tag in ("article", "main")
        links += tag == "a"
    if at < len(page) and not skipping:
        held.append((page[at:], links > 0))
    close()
    return out


def main_text(page: str | None) -> list[str]:
    """The main text's blocks, in page order."""
    found = lines(page or "")
    plain_inside = sum(plain for _, plain, inside in found if inside)
    article = 2 * plain_inside > sum(plain for _, plain, _ in found)
    # inside an article every line counts, links or not
    weights = [(max(1, plain) if inside else 0) if article else plain for _, plain, inside in found]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    surge = SURGE if max(sums, default=0) >= SURGE else 1  # a page of few words is all text
    out, i, after = [], 0, 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        while i < len(weights) and not weights[i]:  # the surge is felt before the first line with text
            i += 1
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        while i > after and weights[i - 1]:  # short lines just before the surge belong to it
            i -= 1
        out += [t for (t, _, _), w in zip(found[i:end], weights[i:end]) if w]
        i = after = end
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The rows, or their columns in ``keep``, with text, n_chars (code points) and n_blocks."""
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())]
    small_batches(pages.sparkSession)
    kept = carried(pages, (f.name for f in added), keep)
    schema = T.StructType([*pages.select(*kept).schema.fields, *added])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                blocks = [main_text(page) for page in part.column(part.num_columns - 1).to_pylist()]
                texts = ["\n\n".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int64())], schema.names)

    return pages.select(*numbered(kept), F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
