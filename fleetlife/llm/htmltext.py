"""Main text of web pages by composite text density.

Every element has characters and tags, and some of either belong to links. Its density is characters per
tag, lowered by the share of links. The element whose children's densities have the largest sum holds the
article; the lowest density on the path from there to the body (or to the page's one article element) is
the threshold that neighbours outside must reach. Elements that name themselves as something else (menus,
adverts, comments and so on) are left out before anything is measured, unless they hold the article: an
article or main element, or half of the text. Those are left to the densities.

Pages are independent: one pass over Arrow batches, no shuffle. The tree is a few lists, built without
recursion, so deep nesting doesn't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlife.llm.textparts import Texts, with_results

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - set("body head html li dd dt td th tr tbody thead tfoot caption option optgroup legend".split())
#: An open element of the second set ends at a start tag of the first, unless one of the third stands between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_LIMITS = set("table td th caption button object html".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
NOT_CONTENT = (RAW - {"noscript"}) | set("head nav footer aside form button select template svg canvas object dialog menu noscript".split())
NOT_CONTENT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOT_CONTENT_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
    "notification alert comment comments disqus respond replies sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead popup modal overlay newsletter subscribe share sharing social related recommended widget "
    "pagination pager login signup search toolbar".split()
)
#: Left out even beside a name of content.
STRONG_NAMES = set("comment comments ad ads advert sidebar".split())
CONTENT_NAMES = set("article post entry content story main text body page wrapper container layout site".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|"
    # Attributes: quotes in pairs, or (if they don't pair up) whatever there is before the next bracket.
    r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/><]*+)"
    r"(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^<>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?", re.S)
_NAME = re.compile(r"[A-Za-z]+")
#: Whole names that tell how an element is laid out and not what it is: no-sidebar, ad-free, comments-open.
_STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:free|open|closed)")
#: Whole names of comments and lists of comments.
_COMMENT = re.compile(r"(?:[a-z]+[-_])?comments?(?:[-_].*)?")

RESULT = [T.StructField("main_text", T.StringType()), T.StructField("density", T.DoubleType())]


class _Page:
    """Elements by number (parents before children), and runs of text: element and characters."""

    def __init__(self, html: str):
        self.tags, self.parents, self.left_out, self.landmark = ["#page"], [-1], [False], [""]
        self.named = [""]  # elements that name themselves as something else: "other" or "comment"
        self.events: list[tuple[int, str | None]] = []  # element and its text; None: a block begins or ends
        self.open: Counter[str] = Counter()  # open elements by name: nothing is searched for in vain
        stack, at = [0], 0
        for tag in _TAG.finditer(html):
            if tag.start() < at:
                continue
            if tag.start() > at:
                self.events.append((stack[-1], html[at : tag.start()]))
            at = tag.end()
            name = (tag["name"] or "").lower()
            if not name:
                continue
            if tag["end"]:
                self._close(stack, name)
                continue
            self._make_room(stack, name)
            if name in BLOCKS:
                self.events.append((stack[-1], None))
            elif name == "br":
                self.events.append((stack[-1], " "))
            number = len(self.tags)
            self._add(name, stack[-1], tag["attributes"])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
            # HTML ignores the slash of <div/>, but not of drawings.
            if name not in VOID and not (name in {"svg", "path"} and tag["attributes"].endswith("/")):
                stack.append(number)
                self.open[name] += 1
        if at < len(html):
            self.events.append((stack[-1], html[at:]))

    def _pop(self, stack: list[int], depth: int) -> None:
        for number in stack[depth:]:
            self.open[self.tags[number]] -= 1
        del stack[depth:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == name:
                self._pop(stack, depth)
                if name in BLOCKS:
                    self.events.append((stack[-1], None))
                return
            if tag in BLOCKS and name not in BLOCKS or tag == "table" and name != "table" and name in {"p", "div"}:
                return  # the end tag of an inline element doesn't end blocks

    def _make_room(self, stack: list[int], name: str) -> None:
        closes, limits = SIBLINGS.get(name, (set(), set()))
        for closes, limits in ((closes, limits), ({"p"}, P_LIMITS) if name in CLOSES_P or name in SIBLINGS else (set(), set())):
            if not any(self.open[c] for c in closes):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[depth]]
                if tag in closes:
                    self._pop(stack, depth)
                    self.events.append((stack[-1], None))
                    if name not in {"tr"}:
                        break
                elif tag in limits:
                    break

    def _add(self, name: str, parent: int, attributes: str) -> None:
        own = {}
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                own.setdefault(key.lower(), unescape(next((v for v in values if v), "")).lower())
        role, named = own.get("role", ""), ""
        mark = ""
        if name == "article" or role == "article" or own.get("itemprop") == "articlebody":
            mark = "article"
        elif name == "main" or role == "main":
            mark = "main"
        in_article = name == "header" and bool(self._within(parent))
        out = name in NOT_CONTENT or name == "header" and not in_article or role in NOT_CONTENT_ROLES
        out |= "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
        if name not in {"html", "body"}:
            named = _named(own.get("class", "") + " " + own.get("id", ""), bool(mark))
        self.tags.append(name)
        self.parents.append(parent)
        self.left_out.append(self.left_out[parent] or out and name not in {"html", "body"})
        self.landmark.append(mark if not self.left_out[-1] else "")
        self.named.append(named)

    def leave_out_named(self, own: list[int]) -> None:
        """Leave out what names itself as something else and doesn't hold the article.

        ``own`` has the characters of each element without those below it. Comments can be articles
        themselves: they only stay if they hold the largest article or main element of the page.
        """
        if not any(self.named):
            return
        count = len(self.tags)
        chars, marks, largest = list(own), [0] * count, [False] * count
        for k in range(count - 1, 0, -1):
            chars[self.parents[k]] += chars[k]
        found = [k for k in range(count) if self.landmark[k] and chars[k] and self.named[k] != "comment"]
        for k in found:
            marks[k] = 1
        if found:
            largest[max(found, key=lambda k: (chars[k], -k))] = True
        for k in range(count - 1, 0, -1):
            marks[self.parents[k]] += marks[k]
            largest[self.parents[k]] |= largest[k]
        body = next((k for k in range(count) if self.tags[k] == "body" and chars[k]), 0)
        out = list(self.left_out)
        for k in range(1, count):
            half = 2 * chars[k] >= chars[body]
            if self.named[k] == "comment":
                stays = largest[k] or half and marks[k] == len(found)
            else:
                stays = not self.named[k] or marks[k] or half
            out[k] = out[k] or out[self.parents[k]] or not stays
        if any(n and not o for n, o in zip(own, out)):  # else names are no help on this page
            self.left_out = out
            self.landmark = [m if not o else "" for m, o in zip(self.landmark, out)]

    def _within(self, number: int) -> str:
        while number > 0:
            if self.landmark[number]:
                return self.landmark[number]
            number = self.parents[number]
        return ""


def _named(classes: str, landmark: bool) -> str:
    """What the names of an element say it is: "comment", "other" than content, or nothing."""
    whole = {n for n in classes.split() if not _STATE.fullmatch(n)}
    if not whole:
        return ""
    comment = any(_COMMENT.fullmatch(n) for n in whole)
    if landmark:
        return "comment" if comment and not whole & CONTENT_NAMES else ""
    names = set(_NAME.findall(" ".join(whole)))
    if names & STRONG_NAMES or names & NOT_CONTENT_NAMES and not names & CONTENT_NAMES:
        return "comment" if comment else "other"
    return ""


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Characters per tag, times the logarithm of how little of them are links.

    The base of the logarithm grows with the links of the element and of the body.
    """
    if not chars:
        return 0.0
    linked, plain = max(link_chars, 1), max(chars - link_chars, 1)
    base = log(chars / plain * link_chars + body_links / max(body_chars, 1) * chars + e)
    share = (chars / linked) * (max(tags, 1) / max(link_tags, 1))
    return chars / max(tags, 1) * log(share + 1) / log(base + 1)


def main_text(html: str | None) -> tuple[str, float]:
    """The article's blocks joined by empty lines, and the density threshold. Null or empty: ("", 0)."""
    if not html:
        return "", 0.0
    page = _Page(html)
    count = len(page.tags)
    chars, tags, links, link_tags = [0] * count, [0] * count, [0] * count, [0] * count
    texts: list[tuple[int, str | None]] = []
    for number, text in page.events:
        if text is None:
            texts.append((number, None))
        elif not page.left_out[number]:
            text = unescape(text)
            texts.append((number, text))
            chars[number] += len("".join(text.split()))
    page.leave_out_named(chars)
    chars = [n if not out else 0 for n, out in zip(chars, page.left_out)]
    in_link = [False] * count
    for k in range(1, count):
        in_link[k] = page.tags[k] == "a" or in_link[page.parents[k]]
    for k in range(count - 1, 0, -1):
        parent = page.parents[k]
        if page.left_out[k]:
            continue
        if page.tags[k] == "a" and not in_link[parent]:
            links[k] = chars[k]
        chars[parent] += chars[k]
        links[parent] += links[k]
        tags[parent] += tags[k] + 1
        link_tags[parent] += link_tags[k] + (page.tags[k] == "a")
    body = next((k for k in range(count) if page.tags[k] == "body"), 0)
    if not chars[body]:
        body = 0
    density = [composite_density(chars[k], tags[k], links[k], link_tags[k], chars[body], links[body]) for k in range(count)]
    top = _top(page, chars, body)
    inside = [False] * count
    inside[top] = True
    sums = [0.0] * count
    for k in range(1, count):
        if not page.left_out[k] and page.parents[k] >= 0:
            inside[k] = inside[k] or inside[page.parents[k]]
            sums[page.parents[k]] += density[k]
    best = max((k for k in range(count) if inside[k]), key=lambda k: (sums[k], -k))
    path = [best]
    while path[-1] != top:
        path.append(page.parents[path[-1]])
    threshold = min(density[k] for k in path)
    kept = _kept(page, inside, path, density, threshold, chars, links, top != body)
    return _join(texts, kept), threshold


def _top(page: _Page, chars: list[int], body: int) -> int:
    """Where the article is looked for: the page's one article, else its main element, else the body."""
    for mark in ("article", "main"):
        found = [k for k, m in enumerate(page.landmark) if m == mark and chars[k] and page._within(page.parents[k]) != mark]
        if found:
            largest = max(found, key=lambda k: chars[k])
            if 2 * chars[largest] >= sum(chars[k] for k in found):
                return largest
    return body


def _kept(page, inside, path, density, threshold, chars, links, marked: bool) -> list[bool]:
    """Elements of the article: all below the best one, and outside it what reaches the threshold."""
    on_path, best = set(path), path[0]
    kept = [False] * len(page.tags)
    for k in range(len(page.tags)):
        if not inside[k] or page.left_out[k]:
            continue
        parent = page.parents[k]
        if k in on_path:
            kept[k] = True
        elif not kept[parent]:
            continue
        elif parent not in on_path:
            kept[k] = True
        else:
            linked = 2 * links[k] > chars[k]
            dense = density[k] >= threshold or page.tags[k] in HEADINGS or page.tags[k] not in BLOCKS
            kept[k] = not linked or page.tags[k] not in BLOCKS if parent == best or marked else dense and not linked
            if linked and page.tags[k] in HEADINGS | {"p"}:
                kept[k] = True  # a linked heading or paragraph is no menu
    return kept


def _join(texts: list[tuple[int, str | None]], kept: list[bool]) -> str:
    blocks, run = [], []
    for number, text in [*texts, (0, None)]:
        if text is None:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run = []
        elif kept[number]:
            run.append(text)
    return "\n\n".join(blocks)


def _extract(part: Texts) -> list:
    found = [main_text(part.text(d)) for d in range(len(part))]
    return [pa.array([t for t, _ in found], pa.string()), pa.array([d for _, d in found], pa.float64())]


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` (empty if there is none) and ``density``, the threshold used.

    Null and empty pages give the empty text; plain text without markup is one block; repeated rows are
    read one by one. Results replace columns of the same names, other columns pass through.
    """
    return with_results(pages, html, RESULT, _extract)
