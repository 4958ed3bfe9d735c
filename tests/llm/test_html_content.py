"""Articles keep lists, tables, links and short last paragraphs under learned weights."""

import random
import time

import pytest

from sextile.llm import html

WORDS = "some plain words of prose that go on for a while "
NAV = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"


def page(content, box="article"):
    return f"<html><body>{NAV}<div class=ad>buy this</div><{box}>{content}</{box}><footer>us</footer></body></html>"


ITEMS = "<ul>" + "".join(f"<li>item {i} has six words here</li>" for i in range(5)) + "</ul>"
TABLE = "<table><tr><td>left cell</td><td>right cell</td></tr></table>"
CONTENT = (
    f"<h1>Title</h1><p>{WORDS * 12}</p>{ITEMS}<p>{WORDS * 2}</p>{TABLE}"
    "<p>More on <a href=z>this page</a> soon.</p><p>The end.</p>"
)


@pytest.mark.parametrize("labelled", [20, 2000])
@pytest.mark.parametrize("box", ["article", "div"])
def test_content_stays(spark, labelled, box):
    plain = page(f"<h1>Title</h1><p>{WORDS * 20}</p><p>{WORDS * 9}<br><b>bold</b></p>")
    pages = spark.createDataFrame([(i, plain) for i in range(labelled)], "page_id long, html string")
    text = html.main_text(page(CONTENT, box), html.learn(pages))
    for part in ("Title", "item 0 has", "item 4 has", "left cell", "right cell", "this page soon", "The end."):
        assert part in text
    for part in ("Home", "buy this", "us"):
        assert part not in text.split("\n\n")


PROSE = "".join(f"<p>Sentence {i} {WORDS}</p>" for i in range(60))
MENU = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
WEIGHTS = {"word": 1.0, "link word": 0.1, "inline": -0.3} | dict.fromkeys((*html.BLOCKS, "a"), -1.0)


@pytest.mark.parametrize(
    "body",
    [
        f"<nav>{MENU}</nav><div id=content class='with-sidebar'>{PROSE}</div>",
        f"<nav>{MENU}</nav><div class='layout no-sidebar'>{PROSE}</div>",
        f"<nav>{MENU}</nav><div class='related-science post'>{PROSE}</div>",
        f"<nav>{MENU}</nav><main><div class='opinion comment'>{PROSE}</div></main>",
        f"<form action=x><nav>{MENU}</nav><div>{PROSE}</div></form>",
        f"<div class=nav>{MENU}<div>{PROSE}</div>",
        f"<nav>{MENU}<div>{PROSE}</div>",
        f"<nav>{MENU}</nav><p class=notice>We use cookies.<div class=post-header><h1>T</h1></div>{PROSE}",
    ],
)
def test_layout_names_cost_no_article(body):
    text = html.main_text(f"<html><body>{body}<footer>us</footer></body></html>", WEIGHTS)
    assert [x.split()[1] for x in text.split("\n\n") if x.startswith("Sentence")] == [*map(str, range(60))]
    assert not {"Home", "News", "us", "We use cookies."} & set(text.split("\n\n"))


@pytest.mark.parametrize("box", ["section class=comments", "div id='comment-list'", "div class=commentThread"])
def test_comments_longer_than_the_article(box):
    short = "A short article of no more than a few words, which counts."
    page = f"<body><div class=post><h1>T</h1><p>{short}</p></div><{box}>{PROSE}</{box.split()[0]}></body>"
    assert html.main_text(page, WEIGHTS) == f"T\n\n{short}"


@pytest.mark.parametrize(
    "unit", ["<a ", '<a ">"', "<svg>", "<p>x", "<div>text ", "<li><b>", "<!", "<", "<form>x", "<!--x", "<td><b>"]
)
def test_time_is_linear(unit):
    for end in ("", ">"):
        started = time.perf_counter()
        html.main_text(unit * (300_000 // len(unit)) + end, WEIGHTS)
        assert time.perf_counter() - started < 3


def test_best_run_is_the_maximum():
    rng = random.Random(4)
    for _ in range(300):
        values = [rng.randrange(-3, 4) for _ in range(rng.randrange(12))]
        sums = {(i, j): sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)}
        begin, end = html.best_run(values)
        assert sum(values[begin:end]) == max([0, *sums.values()])


def test_run_decides_between_regions():
    """Without an article, the region with the better run is the text, whatever comes first."""
    links = "<div>" + "".join("<div><a href=x>two words</a></div>" for _ in range(80)) + "</div>"
    text = html.main_text(f"<body>{links}<div><h1>T</h1>{PROSE}</div>{links}</body>", WEIGHTS)
    assert text.count("Sentence") == 60 and "two words" not in text and text.startswith("T")
