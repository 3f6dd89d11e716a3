"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words outside menus, adverts and the like score positive, tags and words of
such parts negative; the contiguous run of greatest sum, found in one linear scan, is the content region. Its blocks,
whole, without those that stand in a part that is no content (a list inside the article of related pages, for instance),
are the text.

Scores are log odds of a tag or kind of word inside and outside of main texts. They are counted on labelled pages: those of
the table with exactly one <article> or <main> element, at most `FIT_PAGES` of them (the smallest hashes of id and
address), and a few pages below, so that there are weights without labels too. What <article> and <main> mark is used for
labels, and that the title in the head of an article is text; a region may begin and end anywhere.

Null or empty pages have no text, nor have pages without positive words. Markup that is cut off ends with the page. White
space is what Python's `str.split` takes for it. Character references are decoded once, those without a semicolon as HTML
has it. A page is a task's row, whatever its length, and is scanned once. Repeated rows give repeated results; an empty
table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches

FIT_PAGES = 2000
LEAST, MOST = 0.1, 6.0  # bounds of a score's size

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.IGNORECASE)
_WORD_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = set("article aside body blockquote dd details dialog div fieldset figure footer form header li main nav section table td th tr ul ol".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Parts of a page that are not its main text: by element, and by a word in class, id or role.
PART_OF_TAG = {tag: tag for tag in "nav header footer aside form button select dialog menu noscript template svg math object audio video canvas head".split()}
PART_HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager skip toolbar",
    "header": "header masthead banner topbar", "footer": "footer contentinfo copyright legal", "aside": "sidebar aside complementary widget rail related recommended recommendations",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion", "comment": "comment comments commentlist disqus reply replies respond responses",
    "notice": "notice notices cookie cookies consent gdpr alert notification popup modal overlay dialog banner", "form": "form search login signup newsletter subscribe subscription",
    "share": "share sharing social", "hidden": "hidden invisible",
}
_PART_OF_WORD = {word: part for part, words in PART_HINTS.items() for word in words.split()}
_ARTICLE_WORDS = {"article", "post", "entry", "story", "content", "main"}
KNOWN_TAGS = BLOCK | VOID | set("a b i em strong u s small sub sup span code abbr cite q label mark time font del ins kbd tt big".split())

LABELLED = [
    '<html><head><title>x</title></head><body><header><a href="/">Home page</a></header><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport today</a></li></ul></nav>'
    '<main><h1>A headline of some words</h1><p>Plain words of a first paragraph with <a href="/c">a link</a> in the middle of it, and more words.</p><p>Then another one that goes on for '
    'a while, <b>bold</b> and <i>slanted</i>.</p><ul><li>an item of a list</li><li>one more item</li></ul></main><aside><h3>Related</h3><a href="/d">Another story</a></aside>'
    '<form>Your address <input> <button>Send</button></form><footer><p>All rights reserved</p></footer></body></html>',
    '<body><div class="cookie-notice">We use cookies here. <a href="#">Accept all</a></div><div id="menu"><a href="/1">One</a> | <a href="/2">Two</a> | <a href="/3">Three</a></div>'
    '<div class="ad">Buy this fine thing now</div><div id="content"><article><h2>Some title</h2><div>Text in a plain division without paragraphs, as older pages have it.<br><br>It goes '
    'on after two breaks, with words and words and words.</div><table><tr><td>cell</td><td>another</td></tr></table></article><div class="comments"><p>First!</p><p>I do not agree with '
    'this at all, sorry.</p></div></div><div class="sidebar"><ul><li><a href="/4">Most read</a></li><li><a href="/5">Archive</a></li></ul></div><div id="footer">Imprint</div></body>',
    '<body><table><tr><td><a href="/1">Start</a><br><a href="/2">Map</a><br><a href="/3">Contact</a></td><td><main><h1>Old layout</h1><p>Words stand in a cell of a table that makes up '
    'the page.</p><blockquote>Somebody said these words once.</blockquote><p>And more of them follow here.</p></main></td></tr></table><div><a href="/x">top</a> <a href="/y">up</a></div></body>',
]


class Page:
    """What a scan of a page finds: features with their numbers, and the blocks of text they belong to."""

    def __init__(self, html: str) -> None:
        self.features: list[tuple[str, int, int, bool]] = []  # feature, number, block, inside a labelled element
        self.blocks: list[list[str]] = [[]]
        self.labels = 0
        self._open: list[tuple[str, str | None, bool]] = []  # element, part of the page it opens, whether it is a label
        self._where: dict[str, list[int]] = defaultdict(list)
        self._containers: list[int] = []
        self._parts: list[str] = []
        self._inside = 0
        at = 0
        while at < len(html):
            token = _TOKEN.match(html, at)
            at = token.end()
            tag = token["tag"] or token["tag2"]
            if tag:
                tag = tag.lower()
                if token["end"] or token["end2"]:
                    self._ended(tag)
                elif tag in RAW:
                    # nothing in these is markup, nothing is text
                    close = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.IGNORECASE).search(html, at)
                    ended = html.find(">", close.end())
                    at = len(html) if close.end() == len(html) or ended < 0 else ended + 1
                else:
                    self._started(tag, token["attributes"] or token["attributes2"] or "")
            elif token["text"] or token["data"]:
                self._said(entities.unescape(token["text"]) if token["text"] else token["data"])

    def _said(self, text: str) -> None:
        n = len(text.split())
        part = self._parts[0] if self._parts else None
        if part == "header" and self._inside:
            # the head of an article: its title is text, what stands beside it is neither text nor a reason to end it
            if not any(self._where[h] for h in HEADINGS):
                return
            part = None
        if n:
            kind = f"words in {part}" if part else "words of links" if self._where["a"] else "words"
            self._found(kind, n)
        if part is None:
            self.blocks[-1].append(text)

    def _found(self, feature: str, n: int) -> None:
        self.features.append((feature, n, len(self.blocks) - 1, self._inside > 0))

    def _tag(self, tag: str) -> None:
        if tag in BLOCK and self.blocks[-1]:
            self.blocks.append([])
        if tag not in ("article", "main"):
            self._found(f"<{tag}>" if tag in KNOWN_TAGS else "<?>", 1)

    def _part_of(self, tag: str, attributes: str) -> str | None:
        if tag in PART_OF_TAG:
            return PART_OF_TAG[tag]
        if not attributes or tag in ("html", "body", "article", "main"):
            return None
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
                return "hidden"
            if name in ("class", "id", "role"):
                words = [w.lower() for w in _WORD_PARTS.findall(value)]
                for word in words:
                    part = _PART_OF_WORD.get(word)
                    if part and not (part == "header" and _ARTICLE_WORDS & set(words)):
                        return part
        return None

    def _started(self, tag: str, attributes: str) -> None:
        container = self._containers[-1] if self._containers else -1
        if tag in BLOCK and tag != "br" and self._where["p"] and self._where["p"][-1] > container:
            self._close(self._where["p"][-1])
        if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and self._where[tag]:
            place = self._where[tag][-1]
            # the same element in the same list or table ends here
            if not any(w and w[-1] > place for w in (self._where[t] for t in ("ul", "ol", "dl", "table", "select", "menu"))):
                self._close(place)
        if tag == "a" and self._where["a"]:
            self._close(self._where["a"][-1])
        self._tag(tag)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            return
        part = self._part_of(tag, attributes)
        label = tag in ("article", "main")
        self._where[tag].append(len(self._open))
        if tag in CONTAINERS:
            self._containers.append(len(self._open))
        self._open.append((tag, part, label))
        if part:
            self._parts.append(part)
        if label:
            self.labels += self._inside == 0
            self._inside += 1

    def _ended(self, tag: str) -> None:
        if tag not in VOID and self._where[tag]:
            self._close(self._where[tag][-1])
        self._tag(tag)

    def _close(self, place: int) -> None:
        """Ends the element at this place of the stack and all inside it."""
        while len(self._open) > place:
            tag, part, label = self._open.pop()
            self._where[tag].pop()
            if self._containers and self._containers[-1] == len(self._open):
                self._containers.pop()
            if part:
                self._parts.pop()
            if label:
                self._inside -= 1


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of greatest positive sum, the earliest and then shortest of equal ones; (0, 0) without one."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def main_text(html: str, weights: dict[str, float]) -> str:
    """The text of the blocks that the best region touches with words."""
    page = Page(html)
    begin, end = best_region([weights.get(feature, -MOST) * n for feature, n, _, _ in page.features])
    touched = [block for feature, _, block, _ in page.features[begin:end] if feature in ("words", "words of links")]
    if not touched:
        return ""
    blocks = (" ".join("".join(b).split()) for b in page.blocks[touched[0]:touched[-1] + 1])
    return " ".join(b for b in blocks if b)


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Scores from numbers inside and outside of main texts: words of the open page never negative, everything else negative."""
    found = {}
    inside, outside = (sum(c[i] for c in counts.values()) + len(counts) for i in (0, 1))
    for feature in {*counts, "words", "words of links"}:
        a, b = counts.get(feature, (0, 0))
        odds = math.log((a + 1) / inside) - math.log((b + 1) / outside)
        if feature == "words":
            found[feature] = min(max(odds, LEAST), MOST)
        elif feature == "words of links":
            found[feature] = min(max(odds, -MOST), -LEAST)
        elif feature.startswith("words"):
            found[feature] = -MOST
        else:
            found[feature] = -min(max(-odds, LEAST), MOST)
    return found


def _counts(pages: Iterator[str]) -> dict[str, list[int]]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for html in pages:
        page = Page(html)
        if page.labels == 1:
            for feature, n, _, inside in page.features:
                counts[feature][0 if inside else 1] += n
    return counts


def learned(pages: DataFrame, fit_pages: int = FIT_PAGES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> dict[str, float]:
    """Scores of tags and kinds of words; only one row per feature comes to the driver, and there are as many as tags in HTML."""
    key = F.xxhash64(F.col(id_column).cast("string"), F.col(url_column).cast("string"))
    labelled = pages.where(F.col(html_column).rlike("(?i)<(article|main)[\\s>]"))
    chosen = labelled.select(key.alias("_key")).distinct().orderBy("_key").limit(fit_pages)
    # at most `fit_pages` numbers
    sample = labelled.select(key.alias("_key"), F.col(html_column).alias("html")).join(F.broadcast(chosen), "_key", "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(h for batch in batches for h in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))],
                                         names=["feature", "inside", "outside"])

    counts = _counts(iter(LABELLED))
    for row in sample.mapInArrow(run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside"), F.sum("outside")).collect():
        for i in (0, 1):
            counts[row[0]][i] += row[i + 1]
    return weights_of({f: (c[0], c[1]) for f, c in counts.items()})


def extracted(pages: DataFrame, fit_pages: int = FIT_PAGES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    weights = learned(pages, fit_pages, id_column, url_column, html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
