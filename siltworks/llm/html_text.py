"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level tags, each
with its open elements. A block's features are its ancestors' tags and the
words of their class, id and role, its nearest ancestor, the share of the
page's prose that its container holds, and of its text and its two neighbours'
the length and the share inside links, the end, and cues of boilerplate. The
field labels the blocks of a page as main text or not and is decoded by
Viterbi; main blocks are joined.

The field is trained here, by gradient ascent on the exact conditional
likelihood (forward-backward), on labelled pages that :func:`labelled_page`
writes: articles of many kinds amid menus, headers, footers, sidebars, notices,
adverts, forms and reader comments. Texts are random on both sides, so it is
structure that it learns; on every third page no name tells a part from
another, so that texts, links and containers have to. Training is seeded and
takes some seconds.

A page of any size and nesting is read in one pass: the end of a tag, the
closing tag of a script and the elements that a tag closes are found without
going over the same characters or elements again.

Defined cases: null or empty html gives the empty text; scripts, styles,
templates and comments never give blocks, also if unclosed; what follows a
``<`` that opens a tag and is never ended is markup; white space inside a block
becomes one space; character references are decoded; blocks are joined in page
order by one space; nothing is cut; null ids, repeated rows and other columns
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The end of a tag, or the quote that opens an attribute's value.
TAG_END = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, unless one of the stated containers lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: The sets of elements above, each with what it is looked for: the innermost open element of a set is kept at hand.
WATCHED = sorted({(ends, walls) for ends, walls in IMPLIED.values()})
WATCH_OF = {name: WATCHED.index(pair) for name, pair in IMPLIED.items()}
SETS_OF: dict[str, list[int]] = {}
for _i, (_ends, _walls) in enumerate(WATCHED):
    for _name in _ends + _walls:
        SETS_OF.setdefault(_name, []).append(_i)
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a text rather than a part of the page.
TEXTUAL = HEADINGS | frozenset("p li ul ol menu dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr caption address hr br center".split())
#: Words by which short texts show themselves as boilerplate.
CUES = re.compile(r"©|\b(cookies?|privacy|newsletter|subscribe|sign ?up|log ?in|copyright|rights reserved|advertisements?|advert|sponsored|promoted|comments?|repl(?:y|ies)|related|read more|follow us|share)\b", re.I)
#: Marks the main blocks of labelled pages.
FLAG = "\ue000"


class Element:
    """An open element; ``parent`` is None above the root."""

    __slots__ = ("container", "known", "near", "parent", "prose", "tag", "words")

    def __init__(self, parent: Element | None, tag: str, words: frozenset[str], depth: int) -> None:
        self.parent, self.tag, self.words = parent, tag, words
        self.container = parent.container if parent and tag in TEXTUAL else self
        # the depth of the innermost open element of each watched set, or -1
        self.near = parent.near if parent else (-1,) * len(WATCHED)
        if tag in SETS_OF:
            near = list(self.near)
            for i in SETS_OF[tag]:
                near[i] = depth
            self.near = tuple(near)
        self.prose = 0
        self.known = None


class Block:
    """A run of text, the element it lies in and the share of its letters inside links."""

    __slots__ = ("element", "links", "text")

    def __init__(self, text: str, element: Element, links: float) -> None:
        self.text, self.element, self.links = text, element, links


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order."""
    root = Element(None, "", frozenset(), 0)
    stack, count = [root], Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked, links = 0, 0
    at, end, last = 0, len(page), page.rfind(">")
    plain = False  # a quoted value ran to the end of the page: quotes mean nothing from there on
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join(html.unescape("".join(parts)).split())
        share = linked / max(1, sum(map(len, parts)))
        parts.clear()
        linked = 0
        if text:
            out.append(Block(text, stack[-1], share))
            stack[-1].container.prose += round(len(text) * (1 - share))

    def drop_to(i: int) -> None:
        for x in stack[i:]:
            count[x.tag] -= 1
        del stack[i:]

    def tag_end(at: int) -> int:
        """Where the tag that is open at ``at`` has its >; there is one."""
        nonlocal plain
        i = at
        while not plain:
            m = TAG_END.search(page, i)
            if m and not m[1]:
                return m.start()
            i = page.find(m[1], m.end()) + 1 if m else 0
            plain = not i
        return page.find(">", at)

    while at < end:
        m = MARK.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        if at > last:
            break
        closing, name = m[1], m[2]
        if not name:
            at = page.find(">", at) + 1
            continue
        name = name.lower()
        close = tag_end(at)
        if close < 0:
            break
        rest, at = page[at:close], close + 1
        if name in HIDDEN and not closing:
            found = None if name in unclosed else re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if found:
                at = found.end()
            elif rest[-1:] == "/" and rest[-2:-1] in ("", " ", '"', "'"):  # an empty element of XHTML
                unclosed.add(name)
            else:
                at = end
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if closing:
            same = HEADINGS if name in HEADINGS else (name,)
            if any(count[x] for x in same):
                i = len(stack) - 1
                while stack[i].tag not in same:
                    i -= 1
                drop_to(i)
            continue
        if name in HEADINGS and stack[-1].tag in HEADINGS:
            drop_to(len(stack) - 1)
        if name in CLOSE_P and stack[-1].tag == "p":
            drop_to(len(stack) - 1)
        if name == "body" and count["head"]:
            while count["head"]:
                drop_to(len(stack) - 1)
        if name in WATCH_OF:
            ends, i = IMPLIED[name][0], WATCH_OF[name]
            while (depth := stack[-1].near[i]) > 0 and stack[depth].tag in ends:
                drop_to(depth)
                if name != "tr":
                    break
        if name not in VOID:
            stack.append(Element(stack[-1], name, attribute_words(rest), len(stack)))
            count[name] += 1
    flush()
    return out


@lru_cache(maxsize=65_536)
def _words(value: str) -> frozenset[str]:
    return frozenset(w.lower() for w in WORD.findall(value))


def attribute_words(rest: str) -> frozenset[str]:
    """The words of class, id and role."""
    if "=" not in rest:
        return frozenset()
    found = frozenset()
    for m in ATTRIBUTE.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        found |= _words(value) if len(value) < 200 else frozenset(w.lower() for w in WORD.findall(value))
    return found


def own_features(element: Element) -> list[str]:
    """What an element adds to the features of all blocks within."""
    return [f"in {element.tag}", *(f"word {w}" for w in element.words)]


def path_features(element: Element) -> set[str]:
    found, up = {f"at {element.tag}"}, element
    while up.parent:
        found.update(own_features(up))
        up = up.parent
    return found


def size_of(block: Block | None) -> str:
    if block is None:
        return "none"
    n = len(block.text)
    return f"{sum(n > most for most in (12, 40, 120, 400))}{'' if block.links < 0.05 else ' some links' if block.links < 0.6 else ' links'}"


def text_features(rows: list[Block]) -> list[list[str]]:
    """Of every block, what does not depend on the names of its ancestors."""
    sizes = ["none", *map(size_of, rows), "none"]
    total = max(1, sum({id(b.element.container): b.element.container.prose for b in rows}.values()))
    out = []
    for i, b in enumerate(rows):
        share = b.element.container.prose / total
        found = [f"size {sizes[i + 1]}", f"before {sizes[i]}", f"after {sizes[i + 2]}", f"share {sum(share > x for x in (0.03, 0.1, 0.3, 0.6))}", "stop" if b.text[-1] in ".!?…" else "no stop"]
        if len(b.text) < 200 and CUES.search(b.text):
            found.append("cue")
        out.append(found)
    return out


class Field:
    """Weights of a two-label chain: 1 is main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], start: np.ndarray, step: np.ndarray) -> None:
        self.weights, self.start, self.step = weights, start, step

    def _path(self, element: Element) -> tuple[frozenset[str], float, float]:
        """The features with weights of an element and those around it, and their sums; kept at the elements."""
        waiting = []
        while element.known is None:
            if element.parent is None:
                element.known = (frozenset(), 0.0, 0.0)
                break
            waiting.append(element)
            element = element.parent
        known = element.known
        for element in reversed(waiting):
            new = {n for n in own_features(element) if n in self.weights}.difference(known[0])
            if new:
                a, b = known[1:]
                for name in sorted(new):
                    w = self.weights[name]
                    a, b = a + w[0], b + w[1]
                known = (known[0] | new, a, b)
            element.known = known
        return known

    def label(self, rows: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        (s0, s1), ((t00, t01), (t10, t11)) = self.start.tolist(), self.step.tolist()
        came: list[tuple[int, int]] = []
        v0 = v1 = 0.0
        none = (0.0, 0.0)
        for i, (block, names) in enumerate(zip(rows, text_features(rows))):
            _, e0, e1 = self._path(block.element)
            for name in (f"at {block.element.tag}", *names):
                w = self.weights.get(name, none)
                e0, e1 = e0 + w[0], e1 + w[1]
            if not i:
                v0, v1 = s0 + e0, s1 + e1
                continue
            a, b, c, d = v0 + t00, v1 + t10, v0 + t01, v1 + t11
            came.append((int(b > a), int(d > c)))
            v0, v1 = max(a, b) + e0, max(c, d) + e1
        if not rows:
            return []
        out = [int(v1 > v0)]
        for back in reversed(came):
            out.append(back[out[-1]])
        return out[::-1]

    def extract(self, page: str | None) -> str:
        rows = blocks(page or "")
        return " ".join(b.text for b, y in zip(rows, self.label(rows)) if y)


def labelled_page(rng: random.Random) -> str:
    """A page whose main blocks start with FLAG."""
    letters = ["the", "of", "ing", "lor", "sam", "ver", "tio", "né", "ch", "ß", "ar", "qu"]
    cues = ["cookies", "privacy", "newsletter", "Subscribe", "Sign up", "Log in", "copyright", "All rights reserved", "Advertisement", "Sponsored", "Comments", "reply", "Related", "Read more", "Follow us", "Share"]
    nameless = rng.random() < 0.35  # no class, id or telling tag: texts, links and containers alone tell the parts

    def words(a: int, b: int) -> str:
        out = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b)))
        return out.capitalize() + rng.choice([".", ".", ".", "", "!", "?", "..."])

    def prose() -> str:
        text = words(*rng.choice([(1, 2), (3, 9), (10, 30), (40, 90)]))
        if rng.random() < 0.2:
            text += f" <{(t := rng.choice(['b', 'em', 'a href="/x"', 'span', 'strong']))}>{words(1, 4)}</{t.split()[0]}> {words(1, 9)}"
        return text

    def menu(tag: str, name: str) -> str:
        if nameless:
            tag = "div"
        kind = rng.choice(["ul", "ol", "div"])
        items = "".join(f"<li><a href='/{i}'>{words(1, 2)}</a></li>" if kind != "div" else f"<div><a href='/{i}'>{words(1, 2)}</a></div>" for i in range(rng.randint(2, 7)))
        return f"<{tag}{name}><{kind}>{items}</{kind}></{tag}>"

    def box(tag: str, name: str) -> str:
        if nameless:  # short texts, some with a cue
            return f"<{rng.choice(['div', 'p', 'section'])}{name}>{cued(words(*rng.choice([(1, 3), (4, 14)])))}</div>"
        inner = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "<li>{}</li>", "{}<br>", "<span>{}</span>"]).format(prose()) for _ in range(rng.randint(1, 3)))
        return f"<{tag}{name}>{cued(prose()) if rng.random() < 0.5 else inner}</{tag}>"

    def cued(text: str) -> str:
        return f"{rng.choice(cues)} {text}" if rng.random() < 0.5 else text

    def named(*names: str) -> str:
        if nameless:
            return rng.choice(["", "", f' class="{words(1, 1).strip(".!?").lower()}"'])
        n = rng.choice(names)
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "box ", "site-", "page-", "block-"])}{n}{rng.choice(["", "", "", "-text", "-body", "-content", "-box", "-inner", "-wrap", "-area", "-main"])}"'

    ads = lambda: f"<!-- ad {rng.randint(0, 99)} -->" + box(rng.choice(["div", "div", "aside", "section", "p"]), named("ad", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promotion", "commercial", "ad-slot"))
    notice = lambda: box(rng.choice(["div", "section", "p"]), named("notice", "notice", "cookies", "privacy", "warning", "message", "cookie", "cookie-notice", "consent", "alert", "gdpr", "popup", "modal", "disclaimer", "subscribe", "newsletter", "paywall"))
    side = lambda: rng.choice([box, menu])(*rng.choice([("aside", ""), ("aside", named("sidebar", "side", "widget")), ("div", named("sidebar", "widget", "related", "recommended", "trending", "rail"))]))
    share = lambda: menu("div", named("share", "social", "tags", "breadcrumb", "breadcrumbs", "pagination", "meta"))
    form = lambda: f"<form{rng.choice(['', named('search', 'login', 'signup', 'contact')])}><label>{words(1, 3)}</label><input name=q><p>{prose()}</p><select><option>{words(1, 1)}<option>{words(1, 2)}</select><textarea>{words(1, 5)}</textarea><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        kind = rng.choice(["div", "li", "article", "p"])
        items = "".join(f'<{kind} class="comment{rng.choice(["", "-body", " odd"])}">' + rng.choice(["{0}", "<p>{0}</p>", "<h4>{1}</h4><p>{0}</p>", "<span>{1}</span><div>{0}</div><p>{0}</p>"]).format(prose(), words(1, 2)) + f"</{kind}>" for _ in range(rng.randint(1, 4)))
        tag = rng.choice(["section", "div", "ol", "div"])
        return f"<{tag}{named('comments', 'comments', 'comment-list', 'responses', 'discussion', 'replies', 'feedback', 'reader-feedback', 'reader-comments', 'user-reviews', 'user-comments', 'disqus')}><h2>{words(1, 3)}</h2>{items}</{tag}>"

    def comment_list() -> str:
        return "" if nameless else comments()

    head = lambda: rng.choice([lambda: box("div" if nameless else "header", rng.choice(["", named("header", "masthead")])), lambda: menu("header", ""), lambda: box("div", named("header", "masthead", "topbar", "logo"))])()
    nav = lambda: rng.choice([lambda: menu("nav", rng.choice(["", named("menu", "nav", "navbar")])), lambda: menu("div", named("menu", "nav", "navigation", "navbar", "toc"))])()
    foot = lambda: rng.choice([lambda: f"<{'div' if nameless else 'footer'}>&copy; {words(1, 2)} &middot; {words(1, 9)}", lambda: box("footer", ""), lambda: menu("footer", ""), lambda: box("div", named("footer", "copyright", "legal", "bottom"))])() + ("" if nameless else rng.choice(["", "</footer>"]))

    def body() -> str:
        out = [rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", ""]).format(FLAG + words(1, 12))]
        for _ in range(rng.randint(1 + 2 * nameless, 12)):
            t = FLAG + (words(*rng.choice([(3, 9), (10, 30), (40, 90), (40, 90)])) if nameless else prose())
            if rng.random() < 0.06:  # an article may use the words of boilerplate, too
                t = FLAG + rng.choice(cues) + rng.choice([".", "", f" {prose()}"])
            kind = rng.random()
            out.append(
                f"<p>{t}</p>" if kind < 0.5 else f"<p><b>{t}<br>" if kind < 0.6 else f"<p>{t}<br>{FLAG}{prose()}</p>" if kind < 0.65 else f"<h{rng.randint(2, 4)}>{t}</h2>" if kind < 0.7
                else f"<blockquote><p>{t}</p></blockquote>" if kind < 0.74 else f"<ul><li>{t}</li><li>{FLAG}{words(1, 9)}</li></ul>" if kind < 0.8 else f"<pre>{t}</pre>" if kind < 0.83
                else f"<table><tr><td>{t}</td><td>{FLAG}{words(1, 3)}</td></tr></table>" if kind < 0.86 else f"<figure><img src=x><figcaption>{t}</figcaption></figure>" if kind < 0.89
                else f"<div>{t}</div>" if kind < 0.93 else f"<section><h2>{FLAG}{words(1, 5)}</h2><p>{t}</p></section>" if kind < 0.97 else t
            )
            if rng.random() < 0.08:
                out.append(rng.choice([ads, side, share, form, notice])())
        if rng.random() < 0.2:
            out.append(rng.choice([comment_list, share])())
        return "".join(out)

    around = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div{n}>{}</div>", "<div{n}><div>{}</div></div>", "<main{n}>{}</main>", "<article{n}>{}</article>", "<section{n}>{}</section>"])
    if nameless:
        around = rng.choice(["<div{n}>{}</div>", "<div{n}><div>{}</div></div>", "{}", "<section{n}>{}</section>", "<center>{}</center>", *[f"<table><tr><td>{menu('div', '')}</td><td>{{}}</td></tr></table>"] * 3])
    n = named("content", "main", "main-content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "text", "body")
    main = around.replace("{n}", n).format(body())
    before = [f() for f in (head, nav, ads, notice, form, side, share) if rng.random() < 0.4]
    after = [f() for f in (comment_list, side, ads, form, share, foot, notice) if rng.random() < 0.4]
    rng.shuffle(before)
    whole = "".join([*before, main, *after])
    if rng.random() < 0.3:
        whole = f'<div class="{rng.choice(["wrapper", "container", "page", "row", "site", "wrap", "outer"])}">{whole}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{whole}</body></html>"


def bare_page(rng: random.Random) -> str:
    """A page of an article with little or nothing around it: one to a few blocks, bare text, breaks, lists with short ends, a heading over comments."""
    letters = ["the", "of", "ing", "lor", "sam", "ver", "tio", "né", "ch", "ß", "ar", "qu"]

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b))).capitalize()

    def text(*sizes: tuple[int, int]) -> str:
        return FLAG + words(*rng.choice(sizes or ((10, 30), (40, 90), (40, 90)))) + rng.choice([".", ".", ".", "!", "?", ""])

    kind = rng.choice([0, 1, 2, 3, 4, 5, 5])
    if kind == 0:  # a few paragraphs, of any length
        main = "".join(f"<{t}>{text((2, 8), (10, 30), (40, 90))}</{t}>" for t in rng.choices(["p", "p", "p", "div"], k=rng.randint(1, 4)))
    elif kind == 1:  # lines parted by breaks, or text alone
        main = rng.choice(["<br>", "<br><br>", "<br/>\n"]).join(text((6, 20), (10, 30), (40, 90)) for _ in range(rng.randint(1, 5)))
    elif kind == 2:  # a list whose items are as short as they like
        items = [text((4, 12), (10, 30)), *[text((1, 1), (1, 3), (3, 9)) for _ in range(rng.randint(1, 5))]]
        main = f"<h1>{text((1, 6))}</h1><p>{text()}</p>" * rng.randint(0, 1) + "<{0}>{1}</{0}>".format(rng.choice(["ul", "ol"]), "".join(f"<li>{x}</li>" for x in items))
    elif kind == 3:  # headings and paragraphs
        main = "".join(f"<h{rng.randint(1, 3)}>{text((1, 6))}</h2><p>{text()}</p>" for _ in range(rng.randint(1, 3)))
    elif kind == 4:
        main = f"<pre>{text()}</pre>" if rng.random() < 0.3 else f"<blockquote><p>{text()}</p></blockquote><p>{text((3, 9), (10, 30))}</p>"
    else:
        main = "".join(f"<p>{text()}</p>" for _ in range(rng.randint(1, 4)))
    main = rng.choice(["{}", "{}", "<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<section>{}</section>"]).format(main)
    after = ""
    if kind == 5:  # what follows has a heading of its own, outside any box that names it
        said = rng.choice(["Comments", "{} Comments", "{} comments", "Comments ({})", "Leave a comment", "Responses", "{} replies", "Reader comments"]).format(rng.randint(0, 40))
        items = "".join(f'<{t} class="comment">{words(2, 25)}.</{t}>' for t in rng.choices(["div", "li", "p"], k=rng.randint(1, 4)))
        after = f"<h{(n := rng.randint(2, 4))}>{said}</h{n}>" + rng.choice(['<div class="comments">{}</div>', "<ol class=comment-list>{}</ol>", '<section id="comments">{}</section>']).format(items)
        news = "".join(f"<li><a href=/{i}>{words(2, 7)}</a></li>" for i in range(rng.randint(1, 5)))
        news = f'<section class="{rng.choice(["news", "more-news", "latest", "popular"])}"><h2>{rng.choice(["Other news", "More news", "Latest", "Most read"])}</h2><ul>{news}</ul></section>'
        after = rng.choice([after, after + news, news, news])
        if rng.random() < 0.4:
            main = "<nav class=menu><ul>" + "".join(f"<li><a href=/{i}>{words(1, 2)}</a></li>" for i in range(rng.randint(1, 5))) + "</ul></nav>" + main
    return rng.choice(["<html><body>{}</body></html>", "<body>{}</body>", "{}", "<!DOCTYPE html><html><head><title>x</title></head><body>{}</body></html>"]).format(main + after)


def train(pages: list[str], steps: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Adam on the mean conditional log-likelihood of the FLAG labels."""
    chains, labels = [], []
    for page in pages:
        rows = blocks(page)
        labels.append([int(FLAG in b.text) for b in rows])
        for b in rows:
            b.text = b.text.replace(FLAG, "") or "x"
        chains.append([sorted({*path_features(b.element), *names}) for b, names in zip(rows, text_features(rows))])
    names = sorted({name for c in chains for row in c for name in row})
    index = {name: i for i, name in enumerate(names)}
    count, most = len(chains), max(map(len, chains))
    chain, place = (np.array(x) for x in zip(*[(i, t) for i, c in enumerate(chains) for t in range(len(c))]))
    x = np.zeros((len(chain), len(names)), np.float32)
    for row, feats in enumerate(f for c in chains for f in c):
        x[row, [index[f] for f in feats]] = 1
    y = np.array([v for c in labels for v in c])
    length = np.array([len(c) for c in chains])
    w = np.zeros((len(names) + 3, 2))  # the last rows: start, and the step from either label
    m, v = np.zeros_like(w), np.zeros_like(w)
    each = np.arange(count)
    for k in range(1, steps + 1):
        emit = np.zeros((most, count, 2))
        emit[place, chain] = x @ w[:-3]
        start, step = w[-3], w[-2:]
        fore, back = np.zeros((most, count, 2)), np.zeros((most, count, 2))
        fore[0] = emit[0] + start
        for t in range(1, most):
            fore[t] = emit[t] + np.logaddexp(fore[t - 1][:, :1] + step[0], fore[t - 1][:, 1:] + step[1])
        for t in range(most - 2, -1, -1):
            nxt = emit[t + 1] + back[t + 1]
            step_back = np.stack([np.logaddexp(nxt[:, 0] + step[a, 0], nxt[:, 1] + step[a, 1]) for a in (0, 1)], axis=1)
            back[t] = np.where((t + 1 < length)[:, None], step_back, 0)
        z = np.logaddexp(fore[length - 1, each, 0], fore[length - 1, each, 1])
        p = np.exp(fore + back - z[None, :, None])[place, chain]
        grad = np.zeros_like(w)
        truth = np.eye(2)[y]
        grad[:-3] = x.T @ (truth - p)
        first = place == 0
        grad[-3] = (truth - p)[first].sum(axis=0)
        inner = np.flatnonzero(place > 0)
        t, c = place[inner], chain[inner]
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(fore[t - 1, c, a] + step[a, b] + emit[t, c, b] + back[t, c, b] - z[c]).sum()
                grad[-2 + a, b] = ((y[inner - 1] == a) & (y[inner] == b)).sum() - pair
        g = grad / count - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in index.items()}, w[-3], w[-2:])


@cache
def trained(seed: int = 11, pages: int = 900, bare: int = 300) -> Field:
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(pages)] + [bare_page(rng) for _ in range(bare)])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), field: Field | None = None) -> DataFrame:
    """The ``keep`` columns with text and n_chars of every page."""
    mine = field or trained()
    shared = pages.sparkSession.sparkContext.broadcast((mine.weights, mine.start, mine.step))
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("html"))
    kinds = [f.dataType.simpleString() for f in rows.schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            texts = [own.extract(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*[f"k{i}" for i in range(len(keep))], "text", "n_chars"])

    found = rows.mapInArrow(run, ", ".join([*[f"k{i} {k}" for i, k in enumerate(kinds)], "text string", "n_chars long"]))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
