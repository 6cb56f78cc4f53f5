"""Tag-path ratios against plain sums, names, and pages that are long or broken."""

import time

import numpy as np
import pytest

from weirline.llm import html_text as h

PARAGRAPHS = "".join(f"<p>Sentence number {i}, which goes on for a while, and more. It ends here.</p>" for i in range(6))


def page(inside="", beside="", wrapper="article"):
    return f"<html><body><{wrapper}><h1>Title</h1>{PARAGRAPHS}{inside}</{wrapper.split()[0]}>{beside}</body></html>"


@pytest.mark.parametrize(
    "name", "post-comments related-posts ad-slot share-buttons article-ad comment-body page-footer cookie-law-info user-reviews author-bio".split()
)
def test_unwanted_names(name):
    bad = f"<div class='{name}'><p>Unwanted words, quite long ones, too. Really long, you see.</p></div>"
    for html in (page(inside=bad), page(beside=bad), page(inside=bad, wrapper="div class='text'")):
        got = h.content(html)
        assert "Unwanted" not in got and "Sentence number 5" in got and got.startswith("Title")


def test_articles_are_judged_by_class():
    inside = "<article class='comment'><p>Unwanted words of a reader, quite long. Yes, they are.</p></article><article class='advert sidebar'>Unwanted too.</article>"
    got = h.content(page(inside=inside))
    assert "Unwanted" not in got and "Sentence number 5" in got
    first = "<article class='comment'><p>Unwanted words of a reader, quite long. Yes, they are.</p></article>" + page()
    assert "Unwanted" not in h.content(first)


@pytest.mark.parametrize("name", ["page has-sidebar", "content-with-sidebar", "no-sidebar", "site has-header", "post-search-result", "main-thread"])
def test_names_around_the_article(name):
    assert "Sentence number 5" in h.content(f"<html><body><div class='{name}'>{PARAGRAPHS}</div></body></html>")


PLAIN = (
    "<html><body><div><ul>" + "".join(f"<li><a>Link {i}</a></li>" for i in range(12)) + "</ul></div><section><div><h2>Heading</h2>" + PARAGRAPHS
    + "<ul><li>short item</li></ul></div></section><div><div><span>Small print</span></div></div></body></html>"
)


def test_ratios_decide_where_names_say_nothing():
    got = h.content(PLAIN)
    assert "Sentence number 0" in got and "Heading" in got and "short item" in got
    assert "Link" not in got and "Small print" not in got
    every = h.content(PLAIN, lambda found: {p for p, _ in found})
    assert "Link 3" in every and "Small print" in every
    assert h.content(PLAIN, lambda found: set()) == ""


def test_ratios_by_plain_sums():
    parsed = h.Page(PLAIN)
    found = [((parsed.path[e], h.FREE), said) for _, e, said in parsed.blocks]
    paths = list(dict.fromkeys(p for p, _ in found))
    mean = lambda values: sum(values) / len(values)
    ratio = [mean([len(t) for p, t in found if p == q]) for q in paths]
    marks = [mean([sum(t.count(c) for c in ".,;:!?") for p, t in found if p == q]) for q in paths]

    def smooth(v):
        out = []
        for i in range(len(v)):
            near = [(j, 2 if j == i else 1) for j in (i - 1, i, i + 1) if 0 <= j < len(v)]
            out.append(sum(v[j] * w for j, w in near) / sum(w for _, w in near))
        return out

    fused = [a * (1 + b) for a, b in zip(smooth(ratio), smooth(marks))]
    limit = min(np.std(fused), np.mean(fused))
    assert h.chosen_paths(found) == {p for p, v in zip(paths, fused) if v >= limit}
    assert 0 < len(h.chosen_paths(found)) < len(paths)


@pytest.mark.parametrize(
    "unit", ["<a '", "<!", "<div>x", "<b><div>", "</b>", "<i></b>", "</script", "<script", "<p>x<li>y", "<td><table>", "<div class='", "<!--", "<a x=\">", "<i>x"]
)
def test_time_grows_with_the_length(unit):
    began = time.perf_counter()
    h.content(unit * (500_000 // len(unit)))
    assert time.perf_counter() - began < 5


def test_broken_markup_keeps_the_text():
    assert h.content("<p>one, two. three</p><p class='x>four, five. six</p><p>seven, eight. nine</p>").count("\n\n") == 2
    assert "a < b" in h.content("<p>a < b, said the page. And so on.</p>")
    assert h.content("<script>var x = '<p>no</p>';") == "" and h.content("") == "" and h.content("<!-- no <p>no</p>") == ""
