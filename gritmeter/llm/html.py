"""Main text of web pages by site template removal.

Every element's subtree gets two hashes: one of its tags, classes and text, and one of
its shape, in which words are masked, equal siblings count once, and the tags and
classes that it stands in are part. Spark counts per host on how many different pages
each hash stands; subtrees that recur across many of a host's pages are its template
and are deleted, along with what HTML itself or a class name marks as no content. Pages
with equal text count once, so mirrored articles don't make their own paragraphs a
template. A shape is template only where it stands outside the block that holds most
of a page's text, and holds little text itself, so menus, adverts and footers go
though their words change, and paragraphs of one shape stay.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_slices
from .storage import bounded_broadcast, stash

#: A subtree is template if it stands on so many different pages of its host at least, and on this share of them or, word for word, on so many.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 5, 0.3, 50
#: Share of a page's text beyond which a block is its body; share that a template shape holds at most, and of its pages on which it stands in the body.
BODY_SHARE, SHAPE_TEXT, SHAPE_INSIDE = 0.6, 0.35, 0.1
#: Template hashes (8 bytes each) that are broadcast at most; beyond, pages are joined with them by host.
BROADCAST_HASHES = 1_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg canvas object audio video select math xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_DROP = frozenset("nav footer aside form head button dialog menu".split())
_SITE_ONLY = frozenset(("header", "masthead"))
_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion sidebar comment comments disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay menu navbar nav navigation breadcrumb breadcrumbs footer share sharing social related recommended newsletter subscribe subscription signup login widget toolbar pagination pager".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Inside the main part only these can be template; its paragraphs, headings and items are content however often they recur.
_CONTAINERS = frozenset("div section aside ul ol dl table nav header footer form figure details center fieldset".split())
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class _Open:
    """An open element."""

    __slots__ = ("tag", "first", "drop", "main", "parts", "shape", "label", "path", "under", "in_main")

    def __init__(self, tag: str, first: int, drop: bool, main: bool, label: str, above: _Open | None):
        self.tag, self.first, self.drop, self.main, self.label = tag, first, drop, main, label
        self.parts, self.shape = [label], [label]
        self.path = _code(f"{above.path}/{above.label}") if above else 0
        #: Whether an element around it is dropped, or main.
        self.under = above is not None and (above.under or above.drop)
        self.in_main = above is not None and (above.in_main or above.main)


class _Element(NamedTuple):
    first: int
    end: int
    tag: str
    drop: bool
    main: bool
    under: bool
    code: int
    shape: int


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class Page:
    """Text segments of a page in order (None: a block's edge) and its elements, inner before outer. Time is linear in the source, however deep elements nest."""

    def __init__(self, source: str):
        self.segments: list[str | None] = []
        self.links: list[bool] = []
        self.elements: list[_Element] = []
        self.open: list[_Open] = []
        #: Places in ``open`` by tag.
        self.places: dict[str, list[int]] = {}
        at, end, open_ = 0, len(source), self.open
        raw: dict[str, re.Pattern] = {}
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                self._end(name)
                continue
            if name not in _INLINE:
                self._edge()
            if name in _VOID:
                if open_:
                    open_[-1].parts.append(name)
                continue
            attrs = m.group(3)
            if name in _RAW:
                if not attrs.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                    close = raw.get(name) or raw.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I))
                    stop = close.search(source, at)
                    at = stop.end() if stop else end
                continue
            if name in _CLOSES_P and self.places.get("p"):
                self._close_to("p")
            elif name in _SIBLING:
                kinds, bounds = _SIBLING[name]
                last = lambda tags: max((x[-1] for t in tags if (x := self.places.get(t))), default=-1)
                if (k := last(kinds)) > last(bounds):
                    self._close_to(open_[k].tag)
            self._start(name, attrs)
        while open_:
            self._pop()

    def _edge(self) -> None:
        self.segments.append(None)
        self.links.append(False)

    def _text(self, text: str) -> None:
        if text:
            self.segments.append(html.unescape(text) if "&" in text else text)
            self.links.append(bool(self.places.get("a")))
            if self.open:
                self.open[-1].parts.append(text)
                if not text.isspace():
                    self._shaped("T")

    def _shaped(self, part: str) -> None:
        """Add to the shape of the innermost element; what equals the part before it counts once."""
        shape = self.open[-1].shape
        if len(shape) == 1 or shape[-1] != part:
            shape.append(part)

    def _start(self, name: str, attrs: str) -> None:
        drop, main, label = name in _DROP, name in ("article", "main"), name
        site = name in _SITE_ONLY
        if attrs and "=" in attrs or "hidden" in attrs:
            words: list[str] = []
            for m in _ATTR.finditer(attrs):
                key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if key in ("class", "id"):
                    words += _TOKEN.findall(value)
                    label += "." + value
                elif key == "role":
                    drop |= value.lower() in _ROLES
                    main |= value.lower() == "main"
                elif key == "style":
                    drop |= "display:none" in value.replace(" ", "").lower()
                elif key == "aria-hidden":
                    drop |= value.lower() == "true"
            drop |= bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs))
            if words and name not in ("html", "body", "main"):
                low = {w.lower() for w in words}
                # An article's class may speak of anything ("has-comments"); only whole comments are told by it.
                drop |= bool(low & _WORDS) if name != "article" else bool(low & {"comment", "ad", "ads", "advert", "sponsored", "promo", "related"})
                site |= bool(low & _SITE_ONLY)
        above = self.open[-1] if self.open else None
        new = _Open(name, len(self.segments), drop, main, label, above)
        new.drop |= site and not new.in_main
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(new)

    def _pop(self) -> None:
        o = self.open.pop()
        self.places[o.tag].pop()
        inline = o.tag in _INLINE
        if not inline:
            self._edge()
        code = _code("\x1f".join(o.parts))
        shape = _code(f"{o.path}\x1f" + "\x1f".join(o.shape))
        if self.open:
            self.open[-1].parts.append(f"\x1e{code}")
            # Inline markup is part of the text around it, but for links.
            for part in (o.shape[1:] if o.tag != "a" else ["A"]) if inline else [f"\x1e{shape}"]:
                self._shaped(part)
        if not inline or o.drop:
            self.elements.append(_Element(o.first, len(self.segments), o.tag, o.drop, o.main, o.under, code, shape))

    def _close_to(self, name: str) -> None:
        while self.open:
            last = self.open[-1].tag
            self._pop()
            if last == name:
                break

    def _end(self, name: str) -> None:
        if self.places.get(name):
            self._close_to(name)
        elif name == "p":
            self._edge()

    def _counts(self) -> tuple[list[int], list[int]]:
        """Characters but white space before each segment, of all and of those outside links and dropped elements."""
        gone = bytearray(len(self.segments))
        for e in self.elements:
            if e.drop and not e.under:
                gone[e.first : e.end] = b"\1" * (e.end - e.first)
        every, own = [0], [0]
        for s, link, g in zip(self.segments, self.links, gone, strict=True):
            n = 0 if s is None or s.isspace() else len(s.strip())
            every.append(every[-1] + n)
            own.append(own[-1] + (0 if link or g else n))
        return every, own

    def main_ranges(self, every: list[int]) -> list[tuple[int, int]]:
        """Segments of articles, else of main parts, that aren't in dropped elements; all segments if there are none. Ranges inside others are left out."""
        for wanted in (lambda e: e.tag == "article", lambda e: e.main):
            found = [(e.first, e.end) for e in self.elements if wanted(e) and not e.drop and not e.under]
            if any(every[b] > every[a] for a, b in found):
                out: list[tuple[int, int]] = []
                for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
                    if not out or b > out[-1][1]:
                        out.append((a, b))
                return out
        return [(0, len(self.segments))]

    def _deletable(self, every: list[int], ranges: list[tuple[int, int]]) -> Iterator[_Element]:
        whole = ranges == [(0, len(self.segments))]
        starts = [a for a, _ in ranges]
        for e in self.elements:
            if e.main or e.tag in ("html", "body") or every[e.end] == every[e.first]:
                continue
            i = bisect_right(starts, e.first) - 1
            if whole or e.tag in _CONTAINERS or not (i >= 0 and e.end <= ranges[i][1]):
                yield e

    def found(self) -> tuple[list[int], list[int], list[bool], list[float]]:
        """Hashes of the elements that may be deleted as template: those of the words; and those of shapes, whether each stands in the page's body, and its share of the text."""
        every, own = self._counts()
        ranges = self.main_ranges(every)
        codes = sorted({e.code for e in self._deletable(every, ranges)})
        body = next((e for e in self.elements if own[-1] and own[e.end] - own[e.first] >= BODY_SHARE * own[-1]), None)
        shapes: dict[int, tuple[bool, float]] = {}
        if ranges == [(0, len(self.segments))]:
            for e in self.elements:
                if not e.drop and not e.under and e.tag not in ("html", "body") and every[e.end] > every[e.first]:
                    inside = body is not None and body.first <= e.first and e.end <= body.end and e is not body
                    before = shapes.get(e.shape, (False, 0.0))
                    shapes[e.shape] = before[0] or inside, before[1] + (every[e.end] - every[e.first]) / every[-1]
        return codes, list(shapes), [x for x, _ in shapes.values()], [x for _, x in shapes.values()]

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text without dropped and template elements, white space as single spaces."""
        every, _ = self._counts()
        ranges = self.main_ranges(every)
        whole = ranges == [(0, len(self.segments))]
        keep = bytearray(len(self.segments))
        for a, b in ranges:
            keep[a:b] = b"\1" * (b - a)
        gone = [(e.first, e.end) for e in self.elements if e.drop and not e.under]
        if template:
            gone += [(e.first, e.end) for e in self._deletable(every, ranges) if e.code in template or whole and e.shape in template]
        done = 0
        for a, b in sorted(gone, key=lambda x: (x[0], -x[1])):
            if b > done:
                a = max(a, done)
                keep[a:b] = bytes(b - a)
                done = b
        return " ".join("".join([" " if s is None else s for s, k in zip(self.segments, keep, strict=True) if k or s is None]).split())


def host(url: Column) -> Column:
    """Lower-case host of a URL, '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) per host with any: hashes of the subtrees that recur across its pages. ``pages`` has host and html."""

    def make():
        def work(part):
            keys, found = [], ([], [], [], [])
            for source in part.column("html").to_pylist():
                page = Page(source or "")
                keys.append(_code(page.text()))
                for column, got in zip(found, page.found(), strict=True):
                    column.append(got)
            return {"host": part.column("host"), "page": keys} | dict(zip(("codes", "shapes", "inside", "part"), found, strict=True))

        return work

    kind = "host string, page long, codes array<long>, shapes array<long>, inside array<boolean>, part array<double>"
    seen = stash(map_slices(pages.where("host != ''").select("host", "html"), "html", make, kind), "subtrees")
    total = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    words = seen.select("host", "page", F.explode("codes").alias("code")).select("host", "page", "code", F.lit(False).alias("shape"), F.lit(False).alias("inside"), F.lit(0.0).alias("part"))
    shape = seen.select("host", "page", F.explode(F.arrays_zip("shapes", "inside", "part")).alias("x")).select("host", "page", F.col("x.shapes").alias("code"), F.lit(True).alias("shape"), "x.inside", "x.part")
    once = words.unionByName(shape).groupBy("host", "page", "code", "shape").agg(F.max("inside").alias("inside"), F.max("part").alias("part"))
    counted = once.groupBy("host", "code", "shape").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("inside").cast("int")).alias("inside"), F.avg("part").alias("part")).where(F.col("n") >= LEAST_PAGES)
    often = (F.col("n") >= LEAST_SHARE * F.col("pages")) | (~F.col("shape") & (F.col("n") >= MANY_PAGES))
    fit = ~F.col("shape") | (F.col("inside") < SHAPE_INSIDE) & (F.col("part") < SHAPE_TEXT)
    return counted.where(fit).join(total, "host").where(often).groupBy("host").agg(F.collect_list("code").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null html gives an empty text; pages without a host (null or odd URLs) get no
    template removal; repeated rows keep a row each; an empty table gives an empty
    result; other columns are ignored. Texts are whole, however long.
    """
    base = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    known = stash(templates(base), "templates")
    size = known.agg(F.sum(F.size("template"))).first()[0] or 0
    joined = base.join(bounded_broadcast(known, size, BROADCAST_HASHES), "host", "left").select("page_id", "url", "html", "template")

    def make():
        def work(part):
            texts = []
            last, codes = None, frozenset()
            for source, template in zip(part.column("html").to_pylist(), part.column("template"), strict=True):
                got = template.as_py() or ()
                if got != last:
                    last, codes = got, frozenset(got)
                texts.append(Page(source).text(codes) if source else "")
            return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_slices(joined, "html", make, f"page_id {kind}, url string, text string, n_chars long")
