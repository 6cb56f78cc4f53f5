"""Main text of pages by tag-path ratios.

A page is cut into text blocks, each under a path of open tags from the root to
the leaf. For every path the text length, punctuation and number of blocks are
summed; the paths' ratios (characters, and punctuation, per block) are smoothed
over neighbouring paths, fused, and compared with a threshold from the page's own
values. Paths above it are content; a page without such a path has no text. Shorter blocks of the article (headings,
lists) stand beside them: a block is taken, too, when it lies in the smallest
element that holds nearly all of the content (in the article or main around it, if
there is one), or is a heading just before or after that element. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are never taken;
they are known by tag, role, class and id. A token of a class or id says so with its
first or last word ("site-header", "comment-body"); with a word in the middle it
leaves its blocks to the path ratios, and with "has", "no" or "with" it says nothing of
the element itself. No name, form or fieldset removes what holds the page's first
article or main that is not so named or, without any, most of its text.

The scanner reads every character a bounded number of times and elements know their parents
by number, so that a page takes time in proportion to its length, whatever its
markup: unclosed quotes and tags end at the next ">", or are text without one.

Per page, without shuffle. Nulls: a null html is empty and gives empty text; a
null page_id and url are kept. A page without content blocks gives empty text.
Repeated rows are extracted alike, very long pages are taken whole, an empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from weirline.llm.common import map_texts

ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Elements of HTML by their part in a page: fixed values of the standard.
RAW = frozenset("script style template noscript svg math iframe object canvas textarea select title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
APART = frozenset("nav header footer aside form button dialog menu figure figcaption head fieldset".split())
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
APART_WORD = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebars?|side|aside|widgets?|comments?|replies|reply|respond|disqus"
    r"|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|toolbar"
    r"|pagination|pager|copyright|legal|disclaimer|skip\w*|toc|hidden|sr|only|user-?content|ugc|thread|reviews?|bio",
    re.I,
)
#: A token with one of these words tells of something else on the page.
STATE_WORD = frozenset("has have no not with without is".split())
APART_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKS = re.compile(r"[.,;:!?…。，、；：！？·¿¡]")


#: What a tag or name says of an element: part of the article, perhaps not (its paths decide), not by its name, not at all.
FREE, DOUBTFUL, NAMED, APART_ALWAYS = range(4)


def named(value: str) -> int:
    """What the class or id says: NAMED by the first or last word of a token, DOUBTFUL by one in between."""
    most = FREE
    for token in value.split():
        if APART_WORD.fullmatch(token):
            return NAMED
        words = [w for w in re.split(r"[_-]+", token) if w]
        if not words or any(w.lower() in STATE_WORD for w in words):
            continue
        if APART_WORD.fullmatch(words[0]) or APART_WORD.fullmatch(words[-1]):
            return NAMED
        if any(APART_WORD.fullmatch(w) for w in words):
            most = DOUBTFUL
    return most


def apart(tag: str, rest: str, within_main: bool) -> int:
    """Whether an element is no part of the article. A header within the article is its heading."""
    most = FREE
    if tag in ("form", "fieldset"):
        most = NAMED
    elif tag in APART and not (tag in ("header", "figure", "figcaption") and within_main):
        return APART_ALWAYS
    if tag in ("html", "body", "main") or not rest:
        return most
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            most = max(most, named(value))
        if name == "role" and value.lower() in ("form", "search"):
            most = NAMED
        elif name == "role" and value.lower() in APART_ROLE or name == "style" and HIDDEN.search(value):
            return APART_ALWAYS
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return APART_ALWAYS
    return most


class Scanner:
    """Tags and texts of a page from left to right."""

    def __init__(self, html: str) -> None:
        self.html, self.missing = html, set()

    def find(self, what: str, at: int) -> int:
        """Place of what, or -1; what is missing once is missing for good."""
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ">" that ends a tag, quotes skipped; -1 without one."""
        start = at
        while self.find(">", at) >= 0:
            m = TAG_STOP.search(self.html, at)
            if not m:
                return -1
            if m[0] == ">":
                return m.start()
            closing = self.find(m[0], m.end())
            if closing < 0:  # a quote that never closes
                return self.find(">", start)
            at = closing + 1
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("open", tag, attributes) and ("close", tag, "")."""
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            less = self.find("<", at)
            if less < 0:
                yield "text", html[at:], ""
                return
            if less > at:
                yield "text", html[at:less], ""
            after = html[less + 1 : less + 2]
            if html.startswith(("<!--", "<![CDATA["), less):
                close = "-->" if html.startswith("<!--", less) else "]]>"
                end = self.find(close, less + 4)
                at = size if end < 0 else end + 3
                continue
            if self.find(">", less) < 0:  # no tag from here on
                yield "text", html[less:], ""
                return
            m = TAG_NAME.match(html, less + 1)
            end = self.tag_end(m.end()) if m else self.find(">", less) if after and after in "!?" else -1
            if end < 0:
                yield "text", "<", ""
                at = less + 1
                continue
            at = end + 1
            if not m:
                continue
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, ""
                continue
            rest = html[m.end() : end]
            if tag in RAW:
                if not rest.endswith("/"):
                    shut = RAW_END[tag].search(html, at)
                    over = self.find(">", shut.end()) if shut else -1
                    at = over + 1 if over >= 0 else size
                continue
            yield "open", tag, rest


TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile("[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9])", re.I) for tag in RAW}


class Page:
    """Elements by number in the order they open (0: the page itself), and blocks of text under them.

    The elements within k are those from k to last[k]. path is a number per chain of tags that are not inline.
    """

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.kind, self.path, self.last = [""], [-1], [FREE], [0], [0]
        self.always = [False]  # within an element that is never part of the article
        self.block_of = [0]  # the element itself or the nearest around it that is not inline
        self.blocks: list[tuple[int, int, str]] = []  # innermost element, innermost that is not inline, text
        self.first = 0  # the first article or main that no name sets apart
        paths: dict[tuple[int, str], int] = {}
        stack: list[int] = [0]
        at_of: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        solid = [0]  # places of elements that are not inline
        text: list[str] = []

        def flush() -> None:
            if text:
                said = " ".join(unescape("".join(text)).split())
                text.clear()
                if said:
                    self.blocks.append((stack[-1], stack[solid[-1]], said))

        def pop(to: int) -> None:
            if solid[-1] >= to:
                flush()
            while len(stack) > to:
                k = stack.pop()
                self.last[k] = len(self.tag) - 1
                at_of[self.tag[k]].pop()
                if solid[-1] == len(stack):
                    solid.pop()

        def highest(tags) -> int:
            return max((at_of[t][-1] for t in tags if at_of[t]), default=0)

        for what, tag, rest in Scanner(html):
            if what == "text":
                text.append(tag)
            elif what == "close":
                if at_of[tag]:
                    if tag not in INLINE or at_of[tag][-1] > solid[-1]:
                        pop(at_of[tag][-1])
                elif tag not in INLINE:
                    flush()
            elif tag == "br":
                text.append(" ")
            else:
                if tag not in INLINE:
                    flush()
                if tag in VOID:
                    continue
                if tag in CLOSED_BY_BLOCK and self.tag[stack[solid[-1]]] == "p":
                    pop(solid[-1])
                if tag in SAME and highest(SAME[tag]) > highest(SCOPE[tag]):
                    pop(highest(SAME[tag]))
                if rest.endswith("/") and tag in INLINE:
                    continue
                kind, up, k = apart(tag, rest, bool(at_of["article"] or at_of["main"])), stack[-1], len(self.tag)
                self.tag.append(tag)
                self.parent.append(up)
                self.kind.append(kind)
                self.always.append(self.always[up] or kind == APART_ALWAYS)
                self.path.append(self.path[up] if tag in INLINE else paths.setdefault((self.path[up], tag), len(paths) + 1))
                self.block_of.append(self.block_of[up] if tag in INLINE else k)
                self.last.append(k)
                if tag in ("article", "main") and not self.first and kind < NAMED and not self.always[k]:
                    self.first = k
                at_of[tag].append(len(stack))
                if tag not in INLINE:
                    solid.append(len(stack))
                stack.append(k)
        flush()
        while stack:
            self.last[stack.pop()] = len(self.tag) - 1

    def sums(self, sizes: dict[int, int]) -> list[int]:
        """Sizes of elements, what lies in them included."""
        out = [0] * len(self.tag)
        for k, n in sizes.items():
            out[k] += n
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def settled(self) -> list[int]:
        """The kind of every element with what is around it. A name does not count on an element that holds the
        first article or main, or without any, most of the text."""
        holds = [False] * len(self.tag)
        if self.first:
            k = self.first
            while k > 0:
                holds[k], k = True, self.parent[k]
        else:
            sizes: dict[int, int] = defaultdict(int)
            for k, _, said in self.blocks:
                if not self.always[k]:
                    sizes[k] += len(said)
            whole = self.sums(sizes)
            holds = [2 * n > whole[0] for n in whole]
        out = [FREE] * len(self.tag)
        for k in range(1, len(out)):
            own = FREE if holds[k] and self.kind[k] != APART_ALWAYS else self.kind[k]
            out[k] = max(out[self.parent[k]], own)
        return out

    def solid_parent(self, k: int) -> int:
        return self.block_of[self.parent[k]] if k > 0 else 0


def chosen_paths(found: list[tuple[tuple[int, int], str]], width: int = 1) -> set[tuple[int, int]]:
    """The paths (with the kind of their blocks) whose fused ratio reaches the page's threshold."""
    sums: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, said in found:
        s = sums[path]
        s[0] += len(said)
        s[1] += len(MARKS.findall(said))
        s[2] += 1
    paths = list(sums)
    if not paths:
        return set()
    value = np.array([sums[p] for p in paths])
    ratio, marks = value[:, 0] / value[:, 2], value[:, 1] / value[:, 2]
    kernel = np.array([1.0, 2.0, 1.0])[: 2 * width + 1]
    if len(paths) > 2:
        weight = np.convolve(np.ones(len(paths)), kernel, "same")
        ratio, marks = np.convolve(ratio, kernel, "same") / weight, np.convolve(marks, kernel, "same") / weight
    fused = ratio * (1.0 + marks)
    limit = min(fused.std(), fused.mean())
    return {p for p, v in zip(paths, fused, strict=True) if v >= limit}


def content(html: str, choose: Callable[[list], set] = chosen_paths) -> str:
    """The page's main text, blocks joined by an empty line."""
    page = Page(html)
    kinds = page.settled()
    found = [(e, (page.path[e], kinds[k]), kinds[k], said) for k, e, said in page.blocks if kinds[k] <= DOUBTFUL]
    chosen = choose([(path, said) for _, path, _, said in found])
    sizes: dict[int, int] = defaultdict(int)
    for e, path, _, said in found:
        if path in chosen:
            sizes[e] += len(said)
    whole = page.sums(sizes)
    if not whole[0]:
        return ""
    # The deepest element that holds nearly all: elements open in order, so of those on one way down it is the last.
    home = max(k for k, n in enumerate(whole) if n >= NEARLY_ALL * whole[0] and page.block_of[k] == k)
    # A single paragraph may hold most of a page: its siblings belong to the article as well.
    if page.tag[home] in LEAF and home in sizes:
        home = page.solid_parent(home)
    article, around = home, -1
    while article > 0 and page.tag[article] not in ("article", "main"):
        article = page.parent[article]
    if article > 0:
        home = article
    elif home > 0:
        around = page.solid_parent(home)

    def taken(e: int, path: tuple[int, int], kind: int) -> bool:
        if path in chosen:
            return True
        beside = page.tag[e] in HEADING and page.solid_parent(e) == around
        return kind == FREE and (home <= e <= page.last[home] or beside)

    return "\n\n".join(said for e, path, kind, said in found if taken(e, path, kind))


#: Share of the chosen text that the article's element holds.
NEARLY_ALL = 0.9
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre".split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points)."""

    def work(htmls: list[str]) -> dict:
        texts = [content(h) for h in htmls]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages, ["page_id", "url"], ["html"], {"text": "string", "n_chars": "long"}, work)
