import random
import time

import pytest

from lexisieve.llm import extraction
from lexisieve.llm.extraction import main_text

LONG = "Running prose of the article that goes on for a while, with several words."
VERY = "prose " * 2000


@pytest.mark.parametrize("html,text", [
    ("".join(f"<article><p>{LONG} {k}</p></article>" for k in range(12)), " ".join(f"{LONG} {k}" for k in range(12))),
    (f"<main><p>Short lead.</p><article>{f'<p>{LONG}</p>' * 30}</article></main>", " ".join(["Short lead.", *[LONG] * 30])),
    (f"<div class='menu'><a>x</a></div><div><h1>Head</h1><p>{LONG}</p><h2>Next</h2><p>Brief.</p><p>{VERY}</p><p>End.</p></div>",
     f"Head {LONG} Next Brief. {VERY.strip()} End."),
    (f"<div class='layout has-sidebar'><p>Site</p><article><h1>T</h1><p>{LONG}</p></article><div class='sidebar'>{LONG}</div></div>", f"T {LONG}"),
    (f"<article class='post no-comments'><h1>T</h1><p>{LONG}</p></article>", f"T {LONG}"),
    (f"<p>Site</p><div class='page has-sidebar'><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></div>",
     f"T {LONG} {LONG}"),
    (f"<div><h1>T</h1><p>{LONG}</p><p>Short.</p></div><div id='comments'>{f'<p>{LONG} no</p>' * 5}</div>", f"T {LONG} Short."),
    (f"<h1>T</h1><p>Short.</p><p>{VERY}</p><p>End.</p>", f"T Short. {VERY.strip()} End."),
])
def test_no_line_of_the_content_is_lost(html, text):
    assert main_text(html) == text


def test_names_of_subjects_do_not_mark_an_article():
    page = """<html><body><nav class="menu"><a href="/">Home</a></nav><article><h1>On markets</h1>
    <p>First paragraph of the article, long enough to be content by any measure.</p>
    <h2 id="share-prices">Share prices</h2><p>They rose on Monday, and they fell on Tuesday for no reason.</p>
    <section class="related-work"><h3>Related work</h3><p>Others have written about markets before us, at length.</p></section>
    <p class="social">Social effects of prices were not looked at in this short study.</p>
    <p>See <a id="legal" href="#l">the legal note</a> at the end.</p>
    <div class="related-articles"><a href="/a">Ten things about gold</a> <a href="/b">Oil for beginners</a></div>
    <div class="share-buttons"><a href="/t">Tweet this page</a></div>
    <div class="comments"><p>I do not agree with a word of this article, says a reader.</p></div>
    </article><footer>Imprint</footer></body></html>"""
    text = extraction.main_text(page)
    for part in ("Share prices", "Related work Others have", "Social effects", "the legal note", "First paragraph", "On markets"):
        assert part in text
    for part in ("Ten things", "Tweet", "says a reader", "Imprint", "Home"):
        assert part not in text


def test_unmatched_tags_take_linear_time():

    times = []
    for n in (15_000, 60_000):
        for page in ("<b>" * n + "x" + "</i>" * n, "<i><div>" + "<b>" * n + "x" + "</i>" * n, "<b>" * n + "<p>x" * n):
            start = time.process_time()
            assert "x" in extraction.main_text(page)
            times.append(time.process_time() - start)
    assert all(b < 10 * a + 0.5 for a, b in zip(times[:3], times[3:]))


@pytest.mark.parametrize("seed", range(8))
def test_every_text_of_an_article_without_side_parts_is_kept(seed):
    rng = random.Random(seed)
    words = []

    def block(depth):
        made = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "h2", "ul", "section", "div", "blockquote", "table"])
            name = rng.choice(["", ' class="body-text"', ' id="share-of-it"' if kind in ("p", "h2") else ""])
            if kind in ("section", "div") and depth:
                made.append(f"<{kind}{name}>{block(depth - 1)}</{kind}>")
                continue
            said = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(1, 30))]
            words.extend(said)
            text = " ".join(f"<em>{w}</em>" if rng.random() < 0.1 else w for w in said)
            made.append({"ul": f"<ul><li>{text}</li></ul>", "table": f"<table><tr><td>{text}</td></tr></table>"}.get(
                kind, f"<{kind}{name}>{text}</{kind}>"))
        return "\n".join(made)

    page = f"<html><head><title>t</title></head><body><nav>menu</nav><article>{block(3)}</article><footer>f</footer></body></html>"
    assert extraction.main_text(page).split() == words
