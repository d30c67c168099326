"""Operator 3: main text of web pages from flat text blocks and a decision tree.

A page is read once, left to right, by the rules browsers use for broken markup: raw-text elements end at their own end tag
only, comments where the standard ends them, stray end tags are ignored, and a paragraph ends where the next block begins.
Block-level tags cut the text into flat blocks.  Each block is described by its number of words and its link density, by
those of the blocks before and after it, and by what encloses it (a table cell only if the text is the cell's own).  A decision tree tells main text from the rest; it is
trained on the small labelled table that ``labelled`` lays out from page layouts: with and without semantic elements, with
and without telling class names, so words and links of the neighbours decide where names tell nothing.
"""

from __future__ import annotations

import random
import re
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import map_batches
from hushframe.llm.trees import Nodes, decision_tree

_names = lambda s: frozenset(s.split())
#: Kinds of elements, and words of class, id and role that hint at what is not the article.
RAW = _names("script style textarea title xmp iframe noembed noframes")
HIDDEN = _names("noscript template svg math object head canvas audio video select option button datalist map")
VOID = _names("area base br col embed hr img input link meta param source track wbr")
INLINE = _names("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
#: Elements that leave the text around them one block.
UNBROKEN = INLINE | HIDDEN | RAW | (VOID - {"hr"})
BLOCKS = _names("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul")
FURNITURE = _names("nav footer aside form menu dialog fieldset address")
HINTS = _names(
    "ad ads advert advertisement banner sponsor promo cookie cookies consent privacy notice popup modal overlay newsletter subscribe login sidebar widget related recommended "
    "trending share social nav navbar navigation menu breadcrumb breadcrumbs pagination toc footer header masthead toolbar comment comments reply replies discussion search tags "
    "copyright contentinfo complementary sidenav advertising sponsored promoted notification alert signup signin register popular follow pager topbar respond disqus form"
)
REMARKS = _names("comment comments commentlist reply replies respond discussion disqus")
OWN = _names("post article entry story title content")
LAYOUT = _names("with has no without layout")
CONTENT = _names("content article post entry story body")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "hinted", "article", "heading", "item", "named")

_attribute = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_bare = re.compile(r"[^\s>]*")
_hiding = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_cut = re.compile(r"[^a-z0-9]+")
#: Element names that end where a like one begins, unless one of the others stands between.
_SIBLINGS = {"li": _names("ul ol menu"), "dt": _names("dl"), "dd": _names("dl"), "tr": _names("table"), "td": _names("table tr"), "th": _names("table tr"), "option": _names("select")}
_ALSO = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}


class Reader:
    """Tags and text of a page in one pass; every character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, set()

    def _find(self, what: str, at: int) -> int:
        """``page.find``, remembering what does not occur any more."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def events(self):
        """``("text", text)``, ``("start", name, attributes, self_closed)`` and ``("end", name)``."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = self._find("<", at)
            if lt < 0:
                yield "text", page[at:]
                return
            after = page[lt + 1 : lt + 2]
            if after.isascii() and after.isalpha():
                if lt > at:
                    yield "text", page[at:lt]
                name, attrs, closed, at = self._start(lt + 1)
                yield "start", name, attrs, closed
                if name in RAW and not closed:
                    at = self._raw_end(name, at)
                    yield "end", name
            elif after == "/" or after == "!" or after == "?":
                if lt > at:
                    yield "text", page[at:lt]
                if after == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
                    end = self._close(lt)
                    yield "end", re.split(r"[\s/>]", page[lt + 2 : min(end, lt + 66)], maxsplit=1)[0].lower()
                    at = end
                else:
                    at = self._skip(lt)
            else:  # a bare less-than sign
                yield "text", page[at : lt + 1]
                at = lt + 1

    def _close(self, at: int) -> int:
        end = self._find(">", at)
        return len(self.page) if end < 0 else end + 1

    def _skip(self, lt: int) -> int:
        """Past a comment, a declaration or a stray ``</``."""
        page = self.page
        if page.startswith("<!--", lt):
            for empty in (">", "->"):
                if page.startswith(empty, lt + 4):
                    return lt + 4 + len(empty)
            ends = [e + len(mark) for mark in ("-->", "--!>") if (e := self._find(mark, lt + 4)) >= 0]
            return min(ends, default=len(page))
        if page.startswith("<![CDATA[", lt) and (end := self._find("]]>", lt)) >= 0:
            return end + 3
        return self._close(lt)

    def _start(self, at: int) -> tuple[str, dict[str, str], bool, int]:
        """Name, attributes, whether the tag closes itself, and where it ends."""
        page, n, begin = self.page, len(self.page), at
        while at < n and page[at] not in " \t\r\n\f/>":
            at += 1
        name, attrs = page[begin:at].lower(), {}
        while at < n and page[at] != ">":
            m = _attribute.match(page, at)
            if m is None:
                at += 1
                continue
            at = m.end()
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                end = self._find(quote, at + 1) if quote in ('"', "'") else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = _bare.match(page, at)[0]
                    at += len(value)
            attrs.setdefault(m[1].lower(), value)
        return name, attrs, page[at - 1 : at] == "/" and name not in RAW, min(at + 1, n)

    def _raw_end(self, name: str, at: int) -> int:
        """Past the end tag of a raw-text element, whatever stands before it; the page's end without one."""
        found = _raw_ends(name).search(self.page, at)
        return len(self.page) if found is None else self._close(found.start())


@cache
def _raw_ends(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _traits(name: str, attrs: dict[str, str], inside: bool) -> tuple[int, ...]:
    """What an element adds to its contents: (furniture, hinted, article, hidden, link, heading, item, main, named)."""
    furniture, hinted, article, named = name in FURNITURE or (name == "header" and not inside), False, name in ("article", "main"), False
    hidden = name in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_hiding.search(attrs.get("style", "").lower()))
    if name not in ("html", "body"):
        for key in ("class", "id", "role"):
            if not (value := attrs.get(key)):
                continue
            said = set(_cut.split(value.lower()))
            if said & OWN:
                said -= {"header", "footer"}  # the article's own
            if said & LAYOUT:
                said -= HINTS  # says what stands beside it
            hinted |= bool(said & (REMARKS if name in ("article", "main") else HINTS))
            named |= name in ("div", "section", "td") and bool(said & CONTENT) and not said & HINTS
            if key == "role":
                furniture |= bool(said & {"navigation", "banner", "search"})
                article |= bool(said & {"main", "article"})
    heading = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1] in "123456" else 0  # its level
    item = name in ("li", "dt", "dd", "figcaption")
    return tuple(map(int, (furniture, hinted, article, hidden, name == "a" and "href" in attrs, heading, item, "data-main" in attrs, named)))


class Block:
    """Text between two block-level tags, and what encloses its first word."""

    __slots__ = ("text", "linked", "furniture", "hinted", "article", "heading", "item", "main", "named")

    def __init__(self, text: str, linked: int, around: list[int], cell: bool) -> None:
        self.text, self.linked = text, linked
        self.furniture, self.hinted, self.article, _, _, _, self.item, self.main, self.named = (x > 0 for x in around)
        self.heading, self.item = around[5], self.item or cell


class _Stack:
    """Open elements, and the sum of their traits."""

    def __init__(self) -> None:
        self.items: list[tuple[str, tuple[int, ...]]] = []
        self.open: dict[str, int] = {}
        self.sum = [0] * 9

    def push(self, name: str, traits: tuple[int, ...]) -> None:
        self.items.append((name, traits))
        self.open[name] = self.open.get(name, 0) + 1
        self.sum = [a + b for a, b in zip(self.sum, traits, strict=True)]

    def close(self, name: str) -> None:
        """Pop up to the nearest element of this name; nothing if there is none."""
        if not self.open.get(name):
            return
        while True:
            top, traits = self.items.pop()
            self.open[top] -= 1
            self.sum = [a - b for a, b in zip(self.sum, traits, strict=True)]
            if top == name:
                return

    def begin(self, name: str) -> None:
        """Close what the start of ``name`` ends without an end tag."""
        if name in BLOCKS:
            for left_open in ("button", "select"):  # no block belongs there
                self.close(left_open)
            if self.open.get("p") and self._near("p", stop=lambda x: x not in INLINE):
                self.close("p")
        if name == "a" and not self.sum[3]:
            self.close("a")
        if name in _SIBLINGS:
            for like in (name, *_ALSO.get(name, ())):
                if self.open.get(like) and self._near(like, stop=lambda x: x in _SIBLINGS[name] or x in HIDDEN):
                    self.close(like)

    def in_cell(self) -> bool:
        """Whether text here is a table cell's own, not that of a block in it (a table may lay out the page)."""
        return next((x in ("td", "th") for x, _ in reversed(self.items) if x not in INLINE), False)

    def _near(self, name: str, stop) -> bool:
        for x, _ in reversed(self.items):
            if x == name:
                return True
            if stop(x):
                return False
        return False


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out, stack = [], _Stack()
    parts: list[str] = []
    around: list[int] | None = None
    cell = False
    linked = breaks = 0

    def cut() -> None:
        nonlocal parts, around, linked, breaks
        if around is not None:
            out.append(Block(" ".join("".join(parts).split()), linked, around, cell))
        parts, around, linked, breaks = [], None, 0, 0

    for kind, *what in Reader(page).events():
        if kind == "text":
            if stack.sum[3]:
                continue
            text = unescape(what[0])
            if text.strip():
                if around is None:
                    around, cell = stack.sum, stack.in_cell()
                if stack.sum[4]:
                    linked += len(text.strip())
                breaks = 0
            parts.append(text)
            continue
        name = what[0]
        if name == "br" and kind == "start":
            breaks += 1
            if breaks > 1:
                cut()
            else:
                parts.append(" ")
            continue
        hidden, stray = stack.sum[3], kind == "end" and not stack.open.get(name) and name not in BLOCKS
        if kind == "end":
            stack.close(name)
        else:
            stack.begin(name)
        if name not in UNBROKEN and not stray and not (hidden and stack.sum[3]):  # what is not shown cuts nothing
            cut()
        if kind == "start" and name not in VOID and not what[2]:
            stack.push(name, (0, 0, 0, 1, 0, 0, 0, 0, 0) if name in RAW else _traits(name, what[1], stack.sum[2] > 0))
    cut()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row for each block; the neighbours of the first and last block are empty."""
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    links = np.array([min(1.0, b.linked / len(b.text)) for b in blocks])
    before, after = (lambda v: np.r_[0.0, v[:-1]]), (lambda v: np.r_[v[1:], 0.0])
    own = [np.array([getattr(b, k) for b in blocks], float) for k in FEATURES[6:]]
    if not own[2].any():  # a page without an article element: neither inside nor outside
        own[2] = np.full(len(blocks), 0.5)
    return np.stack([words, links, before(words), before(links), after(words), after(links), *own], axis=1)


class _Layouts:
    """Pages for the labelled table.  Blocks of main text carry ``data-main``."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join(self.rng.choices(("w", "ww", "www"), k=n))

    def link(self, n: int) -> str:
        return f"<a href=x>{self.words(n)}</a>"

    def menu(self, n: int) -> str:
        form = self.rng.choice(("list", "row", "divs"))
        items = [self.link(self.rng.randint(1, 3)) for _ in range(n)]
        if form == "list":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return "<p>" + " | ".join(items) + "</p>" if form == "row" else "".join(f"<div>{i}</div>" for i in items)

    def main(self, whole: bool) -> list[str]:
        """A heading and paragraphs; ``whole`` pages (with an article element) also have short ones and lists at the ends."""
        r = self.rng
        out = [f"<h1 data-main>{self.words(r.randint(1, 12))}</h1>"]
        for _ in range(r.randint(3, 9)):
            kind = r.random()
            if kind < 0.5 or len(out) == 1 and not whole and r.random() < 0.7:
                out.append(f"<p data-main>{self.words(r.choice((r.randint(15, 140), r.randint(100, 600))))}</p>")
            elif kind < 0.62:  # short ones; a plain page has a long one beside them
                short, long = "".join(f"<p data-main>{self.words(r.randint(1, 9))}</p>" for _ in range(r.choice((1, 1, 2, 3)))), f"<p data-main>{self.words(r.randint(20, 60))}</p>"
                out.append(short if whole else r.choice((short + long, long + short + long, f"<h2 data-main>{self.words(3)}</h2>{short}{long}")))
            elif kind < 0.74:  # rich in links, but prose
                out.append(f"<p data-main>{' '.join(self.words(r.randint(5, 9)) + ' ' + self.link(r.randint(2, 5)) for _ in range(r.randint(2, 6)))}</p>")
            elif kind < 0.84:
                head = r.choice(("h2", "h2", "h3"))
                out.append(f"<{head} data-main>{self.words(r.randint(1, 7))}</{head}><p data-main>{self.words(r.randint(18, 70))}</p>")
            elif kind < 0.92:
                least = 1 if whole else 10
                row, cell = r.choice((("<ul>%s</ul>", "li"), ("<table><tr>%s</tr></table>", "td")))
                out.append(row % "".join(f"<{cell} data-main>{self.words(r.randint(least, 16))}</{cell}>" for _ in range(r.randint(2, 6))))
            else:
                out.append(f"<blockquote data-main>{self.words(r.randint(12, 40))}</blockquote>")
        if not whole:
            out.append(f"<p data-main>{self.words(r.randint(18, 80))}</p>")
        return out

    def side(self, name: str, n: int) -> str:
        """What is not main, in an element that its class names, or (``name`` empty) in a plain one."""
        r = self.rng
        body = "".join(r.choice((self.menu(r.randint(2, 6)), f"<p>{self.words(n)}</p>", f"<div>{self.words(max(1, n // 3))}</div>")) for _ in range(r.randint(1, 3)))
        return f"<div class='{name}'>{body}</div>" if name else f"<div>{body}</div>"

    def page(self) -> str:
        r = self.rng
        kind = r.choice(("semantic", "article", "classes", "classes", "plain", "plain", "plain"))
        name = r.choice(("post-content", "content", "entry", "article-body", "story", "body", "wrap", "page")) if kind == "classes" else ""
        whole = kind in ("semantic", "article") or bool(CONTENT & {*_cut.split(name)})
        body = self.main(whole)
        names = ("sidebar", "ad", "comments", "related", "cookie notice", "share", "newsletter")
        if kind != "plain":
            for _ in range(r.randint(0, 2)):  # advertisements and the like between the paragraphs
                body.insert(r.randint(1, len(body)), self.side(r.choice(names), r.randint(2, 60)))
            if r.random() < 0.4:
                body.append(self.menu(r.randint(3, 6)) if kind == "classes" else f"<div class=tags>{self.menu(3)}</div>")
        if whole:  # elements that are never main, inside the article
            for _ in range(r.randint(0, 2)):
                tag = r.choice(("aside", "form", "nav", "footer"))
                body.insert(r.randint(1, len(body)), f"<{tag}><p>{self.words(r.randint(1, 70))}</p></{tag}>")
        if kind == "semantic":
            tail = [f"<aside>{self.side('', r.randint(3, 60))}</aside>", f"<footer><p>{self.words(r.randint(2, 50))}</p></footer>", f"<form><p>{self.words(r.randint(1, 30))}</p></form>", f"<section class=comments><article class=comment><p>{self.words(r.randint(3, 90))}</p></article></section>"]
            r.shuffle(tail)
            own = f"<header class=entry-header>{body[0]}</header>" + "".join(body[1:])
            return f"<header><h1>{self.words(2)}</h1><nav>{self.menu(5)}</nav></header><main>{own}</main>{''.join(tail)}"
        if kind == "article":  # what stands outside is not main, even if nothing names it
            around = lambda: "".join(r.choice((self.menu(4), f"<div>{self.words(r.randint(1, 70))}</div>", self.side(r.choice(names), 20), f"<h3>{self.words(3)}</h3>")) for _ in range(r.randint(1, 4)))
            return f"{around()}<article>{''.join(body)}</article>{around()}"
        if kind == "classes":
            return f"<div class=header><div>{self.words(3)}</div></div><div class=menu>{self.menu(6)}</div><div {r.choice(("id", "class"))}={name}>{''.join(body)}</div>{self.side('sidebar', 40)}{self.side('comments', 60)}<div class=footer><p>{self.words(r.randint(2, 30))}</p></div>"
        # nothing is named: menus, a line above the title, rows of contact data, headings of link lists
        short = lambda: r.choice((f"<div>{self.words(r.randint(1, 6))}</div>", "", f"<h3>{self.words(2)}</h3>{self.menu(3)}"))
        cells = "".join(f"<li>{self.words(r.randint(1, 9))}</li>" for _ in range(r.randint(2, 7)))
        foot = [f"<h3>{self.words(2)}</h3>{self.menu(r.randint(2, 6))}", f"{self.menu(2)}<div>{self.words(r.randint(2, 9))}</div>{self.menu(2)}", f"<ul>{cells}</ul>"]
        r.shuffle(foot)
        foot.append(f"{self.menu(2)}<div>{self.words(r.randint(1, 12))}</div>" * r.randint(0, 1))
        if r.random() < 0.35:  # a page with little else, or little at all
            few = body if r.random() < 0.5 else [f"<h1 data-main>{self.words(r.randint(1, 4))}</h1>"] * r.randint(0, 1) + [f"<p data-main>{self.words(r.randint(2, 12))}</p>"] * r.randint(1, 3)
            return r.choice(("", self.side("header", 2), self.side("comments", 40))) + "".join(few)
        if r.random() < 0.2:  # a table lays out the page
            return f"<table><tr><td>{self.menu(r.randint(3, 8))}</td><td>{''.join(body)}</td></tr></table>{short()}{''.join(foot)}"
        return f"{short()}{self.menu(r.randint(3, 8))}{short()}{''.join(body)}{self.menu(r.randint(2, 6))}{''.join(foot)}"


#: Pages of the labelled table, and what fixes their layouts.
PAGES, SEED = 800, 3


@cache
def labelled(pages: int = PAGES, seed: int = SEED) -> tuple[str, ...]:
    """The labelled table."""
    layouts = _Layouts(seed)
    return tuple(layouts.page() for _ in range(pages))


def table_of(pages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    blocks = [blocks_of(p) for p in pages]
    return np.concatenate([features(b) for b in blocks]), np.array([float(x.main) for b in blocks for x in b])


@cache
def model() -> Nodes:
    return decision_tree(*table_of(labelled()), depth=14, least=3)


def main_text(page: str, tree: Nodes | None = None) -> str:
    """Main blocks joined by newlines; empty if the page has none.  Hints count only where something is left without them."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    tree = tree or model()
    x = features(blocks)
    keep = tree.score(x) >= 0.5
    if not keep.any():  # a hint on what encloses everything tells nothing
        x[:, FEATURES.index("hinted")] = 0
        keep = tree.score(x) >= 0.5
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text, n_chars, n_blocks)``, one row for each row.

    A null or empty page, or one without main text, has an empty text; repeated rows and rows with a null page_id or url give a
    row each; an empty table gives an empty table; other columns are ignored, whatever their names; nothing is capped.
    """
    tree = model()  # fitted once, on the driver

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x or "", tree) for x in batch.column("html").to_pylist()]
        count = [0 if not t else t.count("\n") + 1 for t in texts]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(count, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, n_blocks long"
    return map_batches(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), run, schema)
