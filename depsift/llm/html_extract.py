r"""Main text of web pages: flat text blocks and a decision tree (op 9).

A page becomes a flat list of text blocks: text runs until the next tag that starts
or ends a block.  A block has its word count and link density and those of its two
neighbours, and what its surroundings say: whether a main element is around it, whether
a navigation, header, footer, side or form element is, whether a class, id or role
around it names boilerplate, whether it is a heading, a list item or in the header of an
article, and whether the page has a main element at all.  A decision tree says which
blocks belong to the article.  It is grown by Gini impurity, on the driver, each time the
operator is set up, from the blocks of a small labelled table: pages written by hand
below, and ``MADE`` pages that a rule puts together.

Where a page has a main element that no boilerplate is around, other main elements
inside boilerplate (teasers, comments) are boilerplate too; where it has none, frames and
names around the main element are those of the whole page and say nothing.  An article
inside an article is a comment or a teaser.  A form that holds headers, navigation or
articles is one around the whole page, and no frame.  Names are words of class and id:
``article-header``, ``no-sidebar`` or ``comments-open`` name no boilerplate.

Pages are read by one scan over their tags; the work is linear in the page, also
where comments, scripts, quotes or elements are left open.  An end tag closes the
last open element of its name, however many are open within it; a list item, cell
or row also ends where the next one of its list, row or table starts.

Defined cases: a null or empty page, or one without main text, gives an empty
string; a page of any length is read whole; text outside any element counts as a block;
what is inside script, style and similar elements, or hidden by an attribute of its own,
is no text, whatever it looks like; a comment, script or tag that never ends reaches to
the end of the page.  Repeated rows give the same; an empty table gives an empty one.
Of the other columns, all are carried along, but for one with the name of ``out``.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.llm.shared import ship

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav noscript ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements that stay open around others until their end tag.
_HOLDER = frozenset("article aside blockquote button details dialog div dl fieldset figure footer form header li main menu nav ol section select table td th tr ul".split())
_NO_TEXT = frozenset("script style noscript template textarea title iframe svg math object canvas audio video noframes noembed xmp".split())
_FRAME = frozenset("aside button dialog fieldset footer header menu nav select".split())
#: Kinds of open elements that an element ends, the outermost first, and its own kind.
_ENDS = {"li": ("li",), "td": ("cell",), "th": ("cell",), "tr": ("row", "cell")}
_KIND = {"li": "li", "td": "cell", "th": "cell", "tr": "row"}
_MAIN = frozenset("article main".split())
#: What a form around the whole page holds.
_OF_PAGES = frozenset("article aside footer h1 header main nav".split())
_FRAME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id that name boilerplate, and those that do so as the first or only word.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer form gdpr header "
    "legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promotion related replies reply search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription tags toolbar topbar".split()
)
_FIRST_NAMES, _ONLY_NAMES = frozenset(["widget"]), frozenset(["side", "toc"])
#: First words that tell of a page's layout or a post's kind, last words that tell of a state, and what has headers of its own.
_LAYOUT, _STATE = frozenset("category format has is no non not status tag type with without".split()), frozenset("by closed disabled enabled off on open".split())
_HEADED = frozenset("article content entry page post story title".split())
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"[\"'>]")


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, name, attributes) of each tag; end tags have a / before the
    name, and the text after the last tag comes with an empty name."""
    at, text_from, n, pieces = 0, 0, len(page), []
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pieces.append(page[text_from:at])
            at = text_from = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pieces.append(page[text_from:at])
            at = text_from = n if end < 0 else end + 1
        elif name := _TAG_NAME.match(page, at + 1):
            end, last = name.end(), ""
            while (stop := _TAG_END.search(page, end)) and stop[0] != ">":
                # A quote counts as one only where a value may start: after = and blanks.
                last = page[end : stop.start()].rstrip()[-1:] or last
                close = page.find(stop[0], stop.end()) if last == "=" else -1
                end, last = (stop.end() if close < 0 else close + 1), stop[0]
            close = stop.start() if stop else n
            pieces.append(page[text_from:at])
            yield "".join(pieces), name[0].lower(), page[name.end() : close]
            pieces = []
            at = text_from = close + 1
            low = name[0].lower()
            if low in _NO_TEXT and not page[name.end() : close].endswith("/"):
                found = re.compile(rf"(?i)</{low}(?=[\s/>]|$)").search(page, at)
                at = text_from = found.start() if found else n
        else:
            at += 1
    yield "".join(pieces) + page[text_from:], "", ""


class Says(NamedTuple):
    """What the attributes of an element say."""

    named: bool = False
    hidden: bool = False
    main: bool = False
    frame: bool = False


def _names_boilerplate(name: str) -> bool:
    words = [w.lower() for w in _WORDS_OF_NAME.findall(name)]
    if not words or words[0] in _LAYOUT or words[-1] in _STATE:
        return False
    found = _NAMES.intersection(words)
    if found == {"header"} and _HEADED.intersection(words):
        return False
    return bool(found) or words[0] in _FIRST_NAMES or (len(words) == 1 and words[0] in _ONLY_NAMES)


@lru_cache(4096)
def _says(attributes: str) -> Says:
    if not attributes.strip("/ "):
        return Says()
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    role = found.get("role", "").lower()
    named = any(_names_boilerplate(x) for c in ("class", "id") for x in found.get(c, "").split())
    return Says(named, "hidden" in found or bool(_HIDDEN.search(found.get("style", ""))), role in ("main", "article"), role in _FRAME_ROLES)


class Block(NamedTuple):
    """Text of a block, words in links, and what surrounds it."""

    text: str
    linked: int
    main: bool
    outer: bool
    framed: bool
    named: bool
    heading: bool
    item: bool
    head: bool
    attributes: str


class _Open(NamedTuple):
    """An open element: what it counts as, what a main element found around it, and the
    places of the open item, row and cell."""

    name: str
    kinds: tuple[str, ...]
    found: tuple[int, int, int, bool] | None
    seen: dict[str, int]


def blocks(page: str) -> list[Block]:
    out: list[tuple] = []  # blocks and the form around each
    holders: list[_Open] = []
    opened: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    around = Counter(dict.fromkeys(("main", "article", "framed", "named", "head", "li"), 0))
    forms: list[int] = []  # open forms; pages holds those around a whole page
    pages: set[int] = set()
    in_link, outer, made = False, False, 0
    mute, deep = "", 0  # a hidden element within a line
    tag, attributes = "", ""

    def close() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        own = _says(attributes)
        if text:
            linked = sum(len(html.unescape(p).split()) for p, in_a in pieces if in_a)
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            named = around["named"] > 0 or own.named or own.hidden
            out.append((Block(text, linked, around["main"] > 0, outer, around["framed"] > 0 or own.frame, named, heading, around["li"] > 0, around["head"] > 0, attributes), forms[-1] if forms else -1))
        pieces.clear()

    def shut(place: int) -> None:
        nonlocal outer
        while len(holders) > place:
            held = holders.pop()
            opened[held.name] -= 1
            around.subtract(held.kinds)
            if held.name == "form":
                forms.pop()
            if held.found:
                around["framed"], around["named"], around["head"], outer = held.found

    for text, name, attrs in tags(page):
        if text and not mute:
            pieces.append((text, in_link))
        bare = name.lstrip("/")
        if bare in _OF_PAGES and forms:
            pages.update(forms)
        if bare == "a":
            in_link = name == "a"
        elif bare == "br":
            pieces.append((" ", False))
        elif name and bare not in _BLOCK:
            if mute == bare:
                deep += 1 if name == bare else -1
                mute = mute if deep else ""
            elif not mute and name == bare and not attrs.endswith("/") and attrs and _says(attrs).hidden:
                mute, deep = bare, 1
        else:
            close()
            in_link, mute = False, ""
            tag, attributes = (name, attrs) if name and name[0] != "/" and name != "body" else ("", "")
            if name in _HOLDER and not attrs.endswith("/"):
                for kind in _ENDS.get(name, ()):
                    if holders and (place := holders[-1].seen.get(kind)) is not None:
                        shut(place)
                        break
                said = _says(attrs)
                seen = holders[-1].seen if holders else {}
                if name == "table":
                    seen = {}
                elif name == "tr":
                    seen = {"row": len(holders)}
                elif name in _KIND:
                    seen = {**seen, _KIND[name]: len(holders)}
                if "li" in seen and name not in ("li", "div"):  # items end through div elements only
                    seen = {k: v for k, v in seen.items() if k != "li"}
                kinds, found = [], None
                if name == "header" and around["main"]:
                    kinds.append("head")
                elif name in _FRAME or said.frame or (name == "article" and around["article"]):
                    kinds.append("framed")
                elif name in _MAIN or said.main:
                    kinds += ["main", "article"] if name == "article" else ["main"]
                    found = around["framed"], around["named"], around["head"], outer
                    outer = outer or around["framed"] > 0 or around["named"] > 0
                    around["framed"] = around["named"] = around["head"] = 0
                if said.named or said.hidden:
                    kinds.append("named")
                if name == "li":
                    kinds.append("li")
                if name == "form":
                    made += 1
                    forms.append(made)
                holders.append(_Open(name, tuple(kinds), found, seen))
                opened[name] += 1
                around.update(kinds)
            elif name[:1] == "/" and opened[bare]:
                place = len(holders) - 1
                while holders[place].name != bare:
                    place -= 1
                shut(place)
    return [b._replace(framed=b.framed or (form >= 0 and form not in pages)) for b, form in out]


def table_of(found: list[Block]) -> np.ndarray:
    """A row of numbers a block."""
    words = np.array([len(b.text.split()) for b in found], float)
    density = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    around = [np.concatenate([[0], x, [0]]) for x in (words, density)]
    clean = any(b.main and not b.outer for b in found)
    flags = np.array([[b.main, b.framed or (b.outer and clean), b.named, b.heading, b.item, b.head] for b in found], float).reshape(len(found), 6)
    some_main = np.full(len(found), any(b.main for b in found), float)
    return np.column_stack([words, density, around[0][:-2], around[1][:-2], around[0][2:], around[1][2:], flags, some_main])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A tree: a share of ones, or (column, threshold, tree up to it, tree above it)."""
    share = float(y.mean())
    if share in (0.0, 1.0) or depth == 0:
        return share
    best = None
    for column in range(x.shape[1]):
        order = np.argsort(x[:, column], kind="stable")
        values, ones = x[order, column], np.cumsum(y[order])
        cut = np.flatnonzero(np.diff(values) > 0)
        if len(cut):
            n, left = cut + 1.0, ones[cut]
            m, right = len(y) - n, ones[-1] - left
            impurity = left * (n - left) / n + right * (m - right) / m
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0] - 1e-12:
                best = (impurity[i], column, (values[cut[i]] + values[cut[i] + 1]) / 2)
    if best is None:
        return share
    _, column, at = best
    low = x[:, column] <= at
    return column, at, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    column, at, low, high = tree
    below = x[:, column] <= at
    out = np.empty(len(x), bool)
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


_LONG = "The committee met for the third time this spring and agreed that the old bridge should be repaired before winter comes."
_MORE = "Nobody in the valley had expected the work to take so long, but the engineers asked for patience and for another season."
_SHORT = "It was late."
#: Labelled pages; blocks of the article carry data-y.
LABELLED = [
    f"<nav><ul><li><a href=a>Home</a></li><li><a href=b>World</a></li></ul></nav><div class=ad>Buy these shoes today and save.</div><article><h1 data-y>The old bridge</h1>"
    f"<p data-y><b>{_LONG}<br><p data-y>{_MORE}</p><p data-y>{_SHORT}</p><p data-y>Yes.</p><p data-y>{_LONG}</p></article><footer>&copy; example &middot; All rights reserved here.</footer>",
    f"<header><a href=/>The Daily</a><p>News since 1901 for the whole valley and beyond</p></header><main><h1 data-y>Water</h1><p data-y>{_LONG}</p><h2 data-y>Later</h2><ul><li data-y>first a pump</li>"
    f"<li data-y>then a pipe of <a href=x>copper</a></li></ul><p data-y>{_MORE} <a href=y>See the map</a>.</p><p data-y>Done.</p><aside><p>{_MORE}</p></aside></main>"
    f"<aside><h3>Most read</h3><ul><li><a href=1>One story of many</a></li><li><a href=2>Another story</a></li></ul></aside><footer><p>{_LONG}</p></footer>",
    f"<div id=menu><a href=a>A</a> <a href=b>B</a> <a href=c>C</a></div><div class=content><h1 data-y>Fields in spring</h1><p data-y>{_LONG}</p><p data-y>{_MORE}</p><p data-y>{_SHORT}</p><p data-y>{_LONG}</p></div>"
    f"<div class=sidebar><p>{_MORE}</p><p><a href=z>Read more about it here</a></p></div><div class=comments><h3>Comments</h3><p>{_LONG}</p><p>{_SHORT}</p></div><div id=footer>Contact us at the office.</div>",
    f"<div class='cookie-notice'><p>We use cookies to make this site better for you and for all our partners.</p><button>Accept</button></div><article><header><h1 data-y>Site of the year</h1><p>By the editors</p></header><p data-y>{_MORE}</p>"
    f"<div class=advert>{_LONG}</div><p data-y>{_SHORT}</p><blockquote data-y>{_LONG}</blockquote><p data-y>{_MORE}</p><section class=comments><p>{_MORE}</p><p>{_SHORT}</p></section>"
    f"<form><label>Your mail address</label><p>Subscribe to our letter and read it each week.</p></form></article>",
    "<nav><a href=a>Start</a> <a href=b>Shop</a></nav><ul><li><a href=1>First offer</a></li><li><a href=2>Second offer</a></li><li><a href=3>Third offer of the day</a></li></ul><footer>Imprint</footer>",
    f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><p data-y>{_LONG}</p><p data-y>{_MORE}</p><p data-y>{_LONG}</p></td></tr></table><p><a href=3>Back to the start</a></p><p>Mail us.</p>",
    f"<p data-y>{_LONG}</p><p data-y>{_MORE}</p><p data-y>{_SHORT}</p><p data-y>{_MORE}</p><p><a href=a>Next</a> | <a href=b>Last</a></p>",
    f"<main><div class=breadcrumb><a href=a>Home</a> / <a href=b>Valley</a></div><article><h1 data-y>Snow</h1><p data-y>Snow fell.</p><p data-y>{_MORE}</p><figure><figcaption data-y>The pass in May</figcaption></figure>"
    f"<pre data-y>10 cm 20 cm 30 cm</pre><table><tr><td data-y>May</td><td data-y>10</td></tr></table><div class=share><a href=f>Share this</a></div><div class='related'><h2>Related</h2><p><a href=r>Ice on the lake</a></p></div></article></main>",
    f"<div class=header><p>{_SHORT}</p></div><div class=post><h2 data-y>A walk</h2><p data-y>{_MORE}</p><p data-y>{_LONG} <a href=l>Map</a></p><p data-y>{_SHORT}</p><p data-y>{_MORE}</p></div><div class=newsletter><p>{_LONG}</p></div><p>Copyright 2020</p>",
    f"<nav><ul><li><a href=a>the</a></li><li><a href=b>and</a></li><li><a href=c>of</a></li></ul></nav><article><p data-y>Word.</p></article><footer>{_MORE}</footer>",
    f"<article><p data-y>{_LONG}</p></article>",
    f"<article><h1 data-y>One</h1><p data-y>{_MORE}</p><p data-y>Short.</p></article>",
    f"<main><p data-y>{_SHORT}</p><p data-y>No.</p></main><div>Contact us at the office.</div><p>Mail us.</p>",
    f"<article><p data-y>{_LONG}</p><p data-y>{_SHORT}</p></article><p>{_MORE}</p>",
    f"<p data-y>{_LONG}</p><p data-y>{_SHORT}</p>",
    f"<div data-y>{_LONG}</div>",
    f"<div data-y>{_SHORT}</div>",
    f"<h1 data-y>Ice</h1><p data-y>{_MORE}</p><p data-y>{_LONG}</p><ul><li><a href=a>Back</a></li></ul>",
    f"<div class=topbar>{_SHORT}</div><article><h1 data-y>Two</h1><p data-y><a href=q>{_SHORT}</a></p><ol><li data-y>{_LONG}</li><li data-y>{_SHORT}</li></ol><p data-y>{_MORE}</p></article><div class=popup><p>{_MORE}</p></div>",
]

#: Blocks of any length inside an article, and others of any length before and after it.
LABELLED += [
    f"<p>{' '.join(_MORE.split()[:b])}</p><article><p data-y>{' '.join(_LONG.split()[:a])}</p><p data-y>{' '.join(_LONG.split()[:b])}</p></article><p>{' '.join(_MORE.split()[:a])}</p>"
    for a in (1, 2, 5, 9, 20)
    for b in (1, 2, 5, 9, 20)
]


def made_pages(many: int, seed: int = 1) -> list[str]:
    """Labelled pages put together by a rule: boilerplate, an article, boilerplate.  Half
    of them have a main element, where blocks of any length are the article's; in the
    others it starts and ends with prose, and no name or element tells it."""
    r = random.Random(seed)
    pool = f"{_LONG} {_MORE}".split()

    def say(low: int, high: int) -> str:
        return " ".join(r.choices(pool, k=r.randint(low, high)))

    def links(tag: str, least: int = 2) -> str:
        one = lambda: f"<a href=x>{say(1, 9)}</a>"
        if tag == "p":
            return f"<p>{' | '.join(one() for _ in range(r.randint(least, 6)))}</p>"
        return f"<ul>{''.join(f'<li>{one()}</li>' for _ in range(r.randint(least + 1, 8)))}</ul>"

    def framed() -> str:
        inside = r.choice([f"<p>{say(1, 60)}</p>", links("ul"), f"<h3>{say(1, 5)}</h3><p>{say(3, 30)}</p>", f"{say(2, 40)}"])
        tag, name = r.choice([("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), *(("div", n) for n in ("sidebar", "ad", "cookie-notice", "comments", "site-footer", "related", "menu"))])
        return f"<{tag} class='{name}'>{inside}</{tag}>"

    def inner() -> str:
        inside = f"<p>{say(1, 60)}</p>" * r.randint(1, 2)
        return r.choice([f"<aside>{inside}</aside>", f"<form>{inside}</form>", f"<footer>{inside}</footer>", f"<section class=comments>{inside}</section>", f"<div class=ad>{inside}</div>", links("ul"), links("p", 3)])

    def outside(main: bool) -> str:
        loose = [links("ul"), links("p")]
        if main:
            loose.append(f"<p>{say(1, 60)}</p>")
        return "".join(r.choice([framed(), framed(), *loose]) for _ in range(r.randint(0, 3)))

    def prose(low: int, high: int) -> str:
        text = say(low, high)
        if r.random() < 0.2 and high > 12:
            text += f" <a href=x>{say(1, 3)}</a> {say(2, 6)}"
        tag = r.choice(["p", "p", "p", "p", "blockquote", "div", "pre"])
        return f"<{tag} data-y>{text}</{tag}>"

    out = []
    for i in range(many):
        main = i % 2 == 0
        body = [f"<h{r.choice('12')} data-y>{say(1, 9)}</h1>"] if r.random() < 0.8 else []
        if not main:
            body.append(prose(15, 60))
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            kind = r.random()
            if kind < 0.55:
                body.append(prose(*r.choice([(1, 3), (4, 14), (15, 60)])))
            elif kind < 0.65:
                body.append(f"<h3 data-y>{say(1, 6)}</h3>{prose(15, 60)}")
            elif kind < 0.75:
                body.append("<ul>" + "".join(f"<li data-y>{say(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>" + prose(15, 60))
            elif kind < 0.8 and main:
                body.append(f"{prose(8, 60)}<p data-y><a href=x>{say(1, 6)}</a></p>{prose(8, 60)}")
            elif main:
                body.append(inner())
        if not main:
            body.append(prose(15, 60))
        name = r.choice(["article", "main", "div role=main"]) if main else r.choice(["div", "section", "div class=content"])
        tail = "" if main else r.choice(["", f"<p>{say(1, 4)}</p>", f"<div>&copy; {say(2, 7)}</div>"])
        out.append(f"{outside(main)}<{name}>{''.join(body)}</{name.split()[0]}>{outside(main)}{tail}")
    return out


#: Pages that are put together by the rule.
MADE = 1000


def learn():
    rows, marks = [], []
    for page in LABELLED + made_pages(MADE):
        found = blocks(page)
        rows.append(table_of(found))
        marks += ["data-y" in b.attributes for b in found]
    return grow(np.concatenate(rows), np.array(marks, float))


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, table_of(found)), strict=True) if keep)


def extract(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the main text as ``out``."""
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html_col, out)]
    tree = learn()

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), tree) for x in batch.column("__html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), texts], ["__row", "__text"])

    rows = pages.select(F.struct(*(f"`{c}`" for c in rest)).alias("__row"), F.col(html_col).alias("__html"))
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(run, f"__row {kind}, __text string").select("__row.*", F.col("__text").alias(out))


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


SQL = None
