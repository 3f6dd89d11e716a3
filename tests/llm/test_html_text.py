import html
import os
import random
import re

import pytest

from tenderloom.llm.html_text import LABELLED, _counts, best_region, extracted, main_text, weights_of
from tenderloom.llm.queries import op13_html_text
from tests.conftest import FOLDER

SCHEMA = "page_id long, url string, html string, text string, n_chars string, feature long, inside double"


@pytest.fixture(scope="module")
def weights():
    return weights_of({f: (c[0], c[1]) for f, c in _counts(iter(LABELLED)).items()})


def test_best_region_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [float(rng.randrange(-4, 4)) for _ in range(rng.randrange(12))]
        begin, end = best_region(scores)
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert sum(scores[begin:end]) == best and (best > 0 or (begin, end) == (0, 0))


P = "<p>Words of a paragraph that is long enough to be one.</p>"
T = "Words of a paragraph that is long enough to be one."
PAGES = [
    ("", ""), (None, ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<!-- only --><script>var a = '<p>x</p>';</script>", ""),
    ("<nav>menu</nav><div class='ad'>buy</div>", ""),
    (f"<body><nav><a href='/'>Home</a></nav><div>{P}<div class='share-buttons'>Tell all</div>{P}</div><footer>us</footer>", f"{T} {T}"),
    (f"<div id=content><h1>A &amp; B&nbsp;&copy &am</h1>{P}<ul class=\"relatedPosts\"><li><a href=x>Other</a></ul></div>", f"A & B © &am {T}"),
    (f"<main>{P}<form><p>Your name</p></form>{P}<section id='comments'><p>I think so too, and more of it.</p></section></main>", f"{T} {T}"),
    (f"<article><header><h1>The title</h1><p>by somebody</p></header>{P}</article>", f"The title {T}"),
    (f"<div class='post-header'><h1>Title</h1></div>{P}<p hidden>no</p><p style='display: none'>no</p><p>wo<b>r</b>d 1 < 2", f"Title {T} word 1 < 2"),
    (f"{P}<p>See <a href='/x'>here</a></p>", f"{T} See here"),
    (f"<title>no</title><style>p {{}}</style><p>a <!-- no --> b</p><textarea><p>no</textarea>{P}<script>if (a</b) x", f"a b {T}"),
    ("<p>a</p><![CDATA[b &lt;]]><a \"><i '", "a b &lt;"),
    ("<p>" + "word " * 50_000 + "</p>", "word " * 49_999 + "word"),
    ("<b>" * 20_000 + "<p>" * 20_000 + "end", "end"),
    ("<div>" * 30_000 + "deep" + "</div>" * 30_000, "deep"),
    ("a\x00b \x1f c", "a\x00b c"),
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_layouts(weights, page):
    given, expected = PAGES[page]
    assert main_text(given or "", weights) == expected


def test_pages_with_labels_are_recovered(weights):
    for page in LABELLED:
        inside = re.search(r"<(article|main)>(.*)</\1>", page)[2]
        expected = " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:a|b|i)\b[^>]*>", "", inside)).split())
        assert main_text(page, weights) == expected


def test_table(spark, weights):
    rows = [(i, f"http://x/{i}", h, "t", "n", 1, 2.0) for i, (h, _) in enumerate(PAGES)] + [(None, None, P, None, None, None, None), (3, "http://x/3", "just text", "", "", 1, 1.0)]
    got = extracted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    expected = [(i, f"http://x/{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, None, T, len(T)), (3, "http://x/3", "just text", 9)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_articles_of_the_pages(spark):
    """What the pages mark as their article is found without looking at the mark."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(os.path.join(FOLDER, "pages.parquet")).collect()}
    rows = op13_html_text(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for row in rows:
        blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.search(r"<article>(.*?)</article>", pages[row["page_id"]], re.DOTALL)[1])
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert row["text"] == " ".join(t for t in texts if t) and row["n_chars"] == len(row["text"])
