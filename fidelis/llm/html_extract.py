"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a node with one of three states: outer (holds both kinds), content or
boilerplate; text that stands in no block gets a node of its own. Unary potentials come from the hints
in a node's class, id and role, its amount of text, its share of links and how many siblings look the
same; parent-child potentials from how states follow each other for a kind of tag and for the child's
part in the page: whether it holds most of its parent's plain text, little of it or none, or stands
outside the page's article. Both are estimated from labelled pages. Sum-product messages go upward and downward once,
level by level over all pages of a batch, and the marginals of content decide. The labelled pages
that the default model learns from are made by ``labelled_pages``.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, strings, text_groups

OUTER, CONTENT, BOILERPLATE = range(3)
#: Kinds of block elements (fixed values of HTML).
KINDS = {
    "article": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset",
    "box": "div section center details summary", "paragraph": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "item": "li dd dt", "quote": "blockquote pre figure figcaption address",
    "list": "ul ol dl", "table": "table thead tbody tfoot caption colgroup", "cell": "tr td th", "page": "html body frameset noframes",
}
KIND_OF = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never shown as part of a page's text.
UNSEEN = set("head title script style template noscript iframe select option textarea button datalist".split())
CLOSES_P = set(KIND_OF) - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"} | {"hr"}
#: A start tag closes an open element of these, up to the bound.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
GOOD = re.compile(r"\b(article|content|main|post|entry|story|text|body|prose)")
BAD = re.compile(r"\b(nav|menu|side|rail|foot|head|mast|ad|ads|adv|advert\w*|sponsor\w*|banner|cookie|consent|gdpr|paywall|copyright|disclaimer|alert|discussion|cmt|cmts|responses|notice|comment|comments|reply|replies|disqus|promo|related|share|social|log-?in|sign-?up|search|subscribe|newsletter|breadcrumb|pagination|pager|widget|popup|modal|toolbar|tags)\b|\b(nav|menu|sidebar|footer|header|masthead|comment|cookie|banner)")
#: Kinds of the root and of text in no block.
ROOT, LOOSE = len(KINDS), len(KINDS) + 1
TEXT_BOUNDS, FEATURES = (0, 24, 99), (len(KINDS) + 2, 4, 4, 4, 2, 3)
#: A child's part in the page, for its parent-child potential.
NO_TEXT, MOST, LITTLE, OUTSIDE = range(4)
#: An element of the kind "article" is the page's article if it has this share of its plain text.
ARTICLE_SHARE = 0.3


#: Text right below these stands in no block.
KINDS_OF_PAGE = [k in ("page", "root") for k in (*KINDS, "root", "loose")]


class Page(HTMLParser):
    """Block elements of a page as a tree, and the runs of text in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds, self.hints, self.hidden, self.labels, self.looks = [-1], [ROOT], [0], [0], [None], [""]
        self.runs: list[tuple[int, list[str]]] = []
        self.chars, self.linked = [0], [0]
        self.stack: list[tuple[str, int, bool]] = []  # open elements, their nodes and whether their text is unseen
        self.open: dict[str, list[int]] = {}  # where in the stack elements of a tag are
        self.blocks: list[int] = []  # and those of KINDS
        self.unseen = self.links = 0
        self.fresh = True
        self.feed(html)
        self.close()

    def node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in CLOSES_P:
                self.close_to({"p"}, set())
            if tag in ("br", "hr"):
                self.handle_data(" ")
            return
        if tag in CLOSES_P:
            self.close_to({"p"}, {"td", "th", "button", "object", "table"})
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag])
        values = {k: v or "" for k, v in attrs}
        style = values.get("style", "").replace(" ", "").lower()
        dark = tag in UNSEEN or tag not in ("html", "body") and ("hidden" in values or "display:none" in style or "visibility:hidden" in style)
        if dark:
            self.unseen += 1
        elif tag == "body":
            self.unseen = 0
        self.links += tag == "a"
        at = self.node()
        if tag in KIND_OF:
            words = re.sub(r"[_\s]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(values.get(k, "") for k in ("class", "id", "role", "itemprop")))).lower()
            self.parents.append(at)
            self.kinds.append(KIND_OF[tag])
            self.hints.append((GOOD.search(words) is not None) + 2 * (BAD.search(words) is not None))
            self.hidden.append(int(values.get("aria-hidden") == "true"))
            self.labels.append(values.get("data-label"))
            self.looks.append(f"{tag} {values['class']}" if values.get("class") else "")
            self.chars.append(0)
            self.linked.append(0)
            at = len(self.parents) - 1
            self.fresh = True
        if tag in KIND_OF:
            self.blocks.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, at, dark))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def pop(self) -> str:
        tag, _, dark = self.stack.pop()
        self.open[tag].pop()
        self.unseen = max(0, self.unseen - dark)
        self.links -= tag == "a"
        if tag in KIND_OF:
            self.fresh = True
            self.blocks.pop()
        return tag

    def innermost(self, tags: set[str]) -> int:
        """Place in the stack of the innermost open element of ``tags``, -1 without one."""
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=-1)

    def close_to(self, tags: set[str], bounds: set[str]) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``bounds`` is inside it."""
        at = self.innermost(tags)
        if at < 0 or self.innermost(bounds) > at or not bounds and self.blocks and self.blocks[-1] > at:
            return
        while len(self.stack) > at:
            self.pop()

    def handle_endtag(self, tag):
        at = self.innermost({tag})
        while len(self.stack) > at >= 0:
            self.pop()

    def handle_data(self, data):
        if self.unseen:
            return
        at = self.node()
        if KINDS_OF_PAGE[self.kinds[at]]:  # text in no block: a node for it, up to the next block
            begins = self.fresh or self.kinds[-1] != LOOSE or self.parents[-1] != at
            if begins and not data.strip():
                return
            if begins:
                for values, value in ((self.parents, at), (self.kinds, LOOSE), (self.hints, 0), (self.hidden, 0), (self.labels, None), (self.looks, ""), (self.chars, 0), (self.linked, 0)):
                    values.append(value)
            at = len(self.parents) - 1
        if self.fresh or not self.runs or self.runs[-1][0] != at:
            self.runs.append((at, []))
            self.fresh = False
        self.runs[-1][1].append(data)
        n = len("".join(data.split()))
        self.chars[at] += n
        self.linked[at] += n if self.links > 0 else 0

    def features(self) -> np.ndarray:
        chars, linked = np.array(self.chars), np.array(self.linked)
        share = np.where(chars == 0, 0, np.where(linked == 0, 1, np.where(3 * linked < chars, 2, 3)))
        looks = [(p, x) for p, x in zip(self.parents, self.looks, strict=True)]
        same = Counter(looks)
        alike = np.array([np.searchsorted((1, 3), same[x] if x[1] else 0) for x in looks])
        return np.stack([np.array(self.kinds), np.array(self.hints), np.searchsorted(TEXT_BOUNDS, chars), share, np.array(self.hidden), alike], axis=1)

    def parts(self) -> np.ndarray:
        """Each node's part in the page: NO_TEXT, MOST, LITTLE or OUTSIDE."""
        plain = np.array(self.chars) - np.array(self.linked)
        for i in range(len(plain) - 1, 0, -1):  # parents stand before their children
            plain[self.parents[i]] += plain[i]
        above = plain[np.maximum(self.parents, 0)]
        out = np.where(plain == 0, NO_TEXT, np.where(2 * plain >= above, MOST, LITTLE))
        kinds = np.array(self.kinds)
        main = (kinds == KIND_OF["article"]) & (np.array(self.hints) < 2) & (plain >= ARTICLE_SHARE * plain[0]) & (plain > 0)
        if main.any():
            within, holds = main.copy(), main.copy()
            for i in range(1, len(plain)):
                within[i] |= within[self.parents[i]]
            for i in range(len(plain) - 1, 0, -1):
                holds[self.parents[i]] |= holds[i]
            out[~(within | holds)] = OUTSIDE
        return out

    def text(self, content: np.ndarray) -> str:
        blocks = (" ".join("".join(parts).split()) for at, parts in self.runs if content[at])
        return " ".join(b for b in blocks if b)


class TreeModel:
    """Potentials by add-one estimates from labelled pages."""

    def __init__(self, pages: list[str]):
        self.unary = [np.ones((n, 3)) for n in FEATURES]
        counts = np.zeros((FEATURES[0], 4, 3, 3))  # by the child's kind and part in the page: parent's and child's state
        for page in map(Page, pages):
            state = [OUTER]
            parts = page.parts()
            for i in range(1, len(page.parents)):
                state.append({"content": CONTENT, "boilerplate": BOILERPLATE}.get(page.labels[i], state[page.parents[i]]))
                if page.kinds[i] == LOOSE and state[i] == OUTER:  # loose text of a labelled page is content
                    state[i] = CONTENT
                counts[page.kinds[i], parts[i], state[page.parents[i]], state[i]] += 1
            for k, column in enumerate(page.features().T):
                np.add.at(self.unary[k], (column, np.array(state)), 1)
        # What a parent's state says of a child: its kind, its part and its state.
        self.pair = np.log((counts + 0.5) / (counts + 0.5).sum(axis=(0, 1, 3), keepdims=True))
        # What the parent and the kind of tag imply is in the pair potential; the tag's own column is left out.
        self.unary = [np.zeros((FEATURES[0], 3))] + [np.log(u / u.sum(axis=0)) for u in self.unary[1:]]
        for k in (2, 3):  # a node without text of its own says nothing by its text
            self.unary[k] = np.log(np.vstack([np.ones(3), np.exp(self.unary[k][1:]) / np.exp(self.unary[k][1:]).sum(axis=0)]))

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content of each node, by sum-product over the forest of all pages."""
        sizes = np.array([len(p.parents) for p in pages])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + o) for p, o in zip(pages, offsets, strict=False)])
        features = np.concatenate([p.features() for p in pages])
        own = sum(u[features[:, k]] for k, u in enumerate(self.unary))
        own[offsets[:-1]] += np.array([0.0, -50.0, -50.0])  # the root stands above the page
        pair = self.pair[features[:, 0], np.concatenate([p.parts() for p in pages])]
        depth = np.zeros(len(parents), np.int64)
        for i, p in enumerate(parents.tolist()):  # parents stand before their children
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        up = np.zeros((len(parents), 3))
        inside = own.copy()
        for level in levels[:0:-1]:
            up[level] = np.logaddexp.reduce(pair[level] + inside[level][:, None, :], axis=2)
            np.add.at(inside, parents[level], up[level])
        belief = inside.copy()
        for level in levels[1:]:
            above = belief[parents[level]] - up[level]  # the parent without what this child told it
            above -= np.logaddexp.reduce(above, axis=1)[:, None]
            belief[level] += np.logaddexp.reduce(pair[level] + above[:, :, None], axis=1)
        belief -= np.logaddexp.reduce(belief, axis=1)[:, None]
        return np.split(np.exp(belief[:, CONTENT]), offsets[1:-1])

    def extract(self, htmls: list[str]) -> list[tuple[str, int]]:
        """Text and number of content nodes of each page."""
        pages = [Page(h) for h in htmls]
        return [(p.text(m >= 0.5), int((m >= 0.5).sum())) for p, m in zip(pages, self.marginals(pages), strict=True)] if pages else []


def labelled_pages(n: int = 800, seed: int = 5) -> list[str]:
    """Made-up pages whose regions carry a data-label: the sample that the default model learns from."""
    rng = random.Random(seed)

    def words(low, high):
        return " ".join("x" * rng.randint(2, 9) for _ in range(rng.randint(low, high)))

    def name(*usual):
        """A class of a region: one of the usual names, or one that says nothing."""
        return rng.choice(usual) if rng.random() < 0.6 else rng.choice(["blk", "c-12", "region", "x7f", "inner", "row", "unit", "panel-3", "box"])

    def link(low=1, high=3):
        return f'<a href="#">{words(low, high)}</a>'

    def paragraph():
        inner = words(*rng.choice([(1, 6), (8, 40), (40, 160)]))
        return rng.choice([f"<p>{inner}</p>", f"<p>{inner} <b>{words(1, 3)}</b> {link()} {words(3, 20)}", f"<p>{inner}<br>{words(2, 9)}</p>"])

    def listed():
        tag, linked = rng.choice(["ul", "ul", "ol"]), rng.random() < 0.4
        items = "".join(f"<li>{link(1, 5) if linked and rng.random() < 0.6 else words(1, 12)}</li>" for _ in range(rng.randint(2, 6)))
        return f"<{tag}>{items}</{tag}>"

    def inside():
        kinds = [paragraph, paragraph, paragraph, lambda: f"<h2>{words(1, 6)}</h2>", listed, listed, lambda: f"<blockquote><p>{words(4, 30)}</p></blockquote>", lambda: f"<pre>{words(3, 30)}</pre>", lambda: f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", lambda: f"<section>{paragraph()}</section>", lambda: f"<div>{paragraph()}</div>", lambda: f"<figure><figcaption>{words(2, 9)}</figcaption></figure>"]
        parts = [f"<h1>{words(1, 9)}</h1>"] * (rng.random() < 0.9) + [rng.choice(kinds)() for _ in range(rng.randint(0, 9))]
        if len(parts) > 3 and rng.random() < 0.3:
            parts.insert(rng.randint(1, len(parts)), rng.choice([ad, form, aside])())
        said = comments() if len(parts) > 4 and rng.random() < 0.25 else ""
        text = "".join(parts)
        if rng.random() < 0.3:  # all of it in one more element
            text = rng.choice(["<div>{}</div>", '<div class="{}">{{}}</div>'.format(name("content", "body", "text")), "<section>{}</section>"]).format(text)
        return text + said

    skip = 'data-label="boilerplate"'

    def nav():
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        return rng.choice([f"<nav {skip}><ul>{items}</ul></nav>", f'<div class="{name("menu", "nav", "breadcrumb", "navbar")}" {skip}><ul>{items}</ul></div>', f'<ul class="menu" {skip}>{items}</ul>', f"<nav {skip}>{link()} {link()}</nav>"])

    def ad():
        return f'<div class="{name("ad", "advert", "banner", "promo", "sponsored", "ad-box")}" {skip}>{rng.choice([words(2, 25), f"<p>{words(2, 25)}</p>", link(2, 6)])}</div>'

    def aside():
        return rng.choice([f"<aside {skip}><h3>{words(1, 3)}</h3><p>{words(3, 30)}</p></aside>", f'<div class="{name("sidebar")}" {skip}><h3>{words(1, 3)}</h3><p>{words(10, 50)}</p></div>', f'<div {skip}><h3>{words(1, 3)}</h3><p>{words(5, 40)}</p><p>{words(3, 20)}</p></div>', f'<div class="{name("sidebar")}" {skip}><h3>{words(1, 3)}</h3><ul><li>{link()}</li><li>{link()}</li></ul><p>{words(3, 30)}</p></div>', f'<div id="related" {skip}>{link(3, 8)}{link(3, 8)}</div>'])

    def form():
        return f"<form {skip}><p>{words(1, 9)}</p><label>{words(1, 2)}</label><input><button>{words(1, 1)}</button></form>"

    def notice():
        return f'<div class="{name("cookie-notice", "notice", "cookie", "consent", "popup", "newsletter")}" {skip}><p>{words(4, 40)}</p>{link()}</div>'

    def comments():
        one, every = name("comment", "reply"), name("comments", "replies")
        items = "".join(f'<div class="{one}"><p>{words(2, 60)}</p></div>' for _ in range(rng.randint(1, 4)))
        said = "".join(f'<li class="{one}"><b>{words(1, 2)}</b><p>{words(2, 60)}</p></li>' for _ in range(rng.randint(1, 5)))
        return rng.choice([f'<ol class="{every}" {skip}>{said}</ol>', f'<section class="{every}" {skip}><h3>{words(1, 2)}</h3>{items}</section>', f'<div id="comments" {skip}><ul><li><p>{words(2, 60)}</p></li></ul></div>'])

    def main():
        hint = name("content", "main", "post", "entry-content", "article-body", "story")
        return rng.choice([f'<article data-label="content">{inside()}</article>'] * 3 + [f'<main data-label="content">{inside()}</main>', f'<main data-label="content"><div>{inside()}</div></main>', f'<main><div data-label="content">{inside()}</div></main>', f'<div class="{hint}" data-label="content"><div>{inside()}</div></div>', f'<main><article data-label="content">{inside()}</article></main>', f'<div class="{hint}" data-label="content">{inside()}</div>', f'<div id="{hint}" data-label="content"><h1>{words(2, 8)}</h1>{inside()}</div>', f'<div data-label="content"><h1>{words(2, 8)}</h1><p>{words(40, 120)}</p>{inside()}</div>', f'<table><tr><td {skip}>{link()}{link()}</td><td data-label="content"><h1>{words(2, 8)}</h1><p>{words(30, 90)}</p>{inside()}</td></tr></table>'])

    pages = []
    for _ in range(n):
        head = [f"<header {skip}><h1>{words(1, 4)}</h1><p>{words(1, 8)}</p></header>"] * (rng.random() < 0.5) + [nav()] * (rng.random() < 0.9) + [notice()] * (rng.random() < 0.3) + [ad()] * (rng.random() < 0.6)
        tail = [aside()] * (rng.random() < 0.4) + [comments()] * (rng.random() < 0.3) + [form()] * (rng.random() < 0.3) + [rng.choice([f"<footer {skip}>{words(2, 30)}</footer>", f"<footer {skip}><p>{words(2, 30)}</p>{link()}</footer>", f'<div id="footer" {skip}><p>{words(2, 20)}</p></div>'])] * (rng.random() < 0.9)
        body = "".join(head) + main() + "".join(tail)
        if rng.random() < 0.4:
            body = f'<div id="{rng.choice(["wrapper", "page", "container"])}">{body}</div>'
        if rng.random() < 0.05:  # text in no block
            pages.append(f'<html><body data-label="content">{words(5, 90)}<br>{words(1, 40)}{rng.choice(["", f"<p>{words(4, 40)}</p>"])}</body></html>')
            continue
        pages.append(f"<html><body>{body}</body></html>")
    return pages


def fit(pages: list[str] | None = None) -> TreeModel:
    """Potentials from labelled pages: elements with data-label="content" or "boilerplate"; other labels are inherited."""
    return TreeModel(labelled_pages() if pages is None else pages)


def html_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars and n_content_nodes of every row of ``pages``.

    Null and empty html give the empty text, as do pages without content. Malformed markup is read as
    browsers do in the common cases (unclosed and stray tags). Nothing is cut off or capped. Equal
    html gives equal text; null ids and urls stay; an empty table stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())  # a few potentials

    def start():
        own = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(2)):
                part = batch.slice(a, b - a)
                found = own.extract(strings(part.column(2)))
                yield {"page_id": part.column(0), "url": part.column(1), "text": pa.array([t for t, _ in found], pa.string()), "n_chars": np.array([len(t) for t, _ in found], np.int64), "n_content_nodes": np.array([n for _, n in found], np.int64)}

        return work

    return map_texts(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), ["page_id", "url", "html"], "page_id bigint, url string, text string, n_chars bigint, n_content_nodes bigint", start)
