"""Main text of web pages by consensus host paths.

Each page is parsed once, into its blocks of text and the containers that hold them.  Containers are
scored by the text of their paragraphs that isn't links; every page votes, in shares, for the
generalised tag-class paths of its containers; each host's winning path is then extracted from all
its pages, from all containers on it.  A page without that path gives its own best container.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import absent, small_or_not, table, written

# Elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_CODE = frozenset(("script", "style"))
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary".split())
_DROPPED = frozenset(
    "aside audio button canvas dialog embed fieldset footer head iframe input label legend menu nav noembed noframes noscript object option script select style svg template textarea title video xmp".split()
)
_IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
_NOISE = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising alert alerts announcement announcements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus flash footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices outbrain "
    "pagination pager popup promo promoted promotion related reply respond share sharing sidebar signup skip snackbar social sponsor sponsored subscribe taboola toast toc toolbar topbar".split()
)
#: A name is one of noise if all its words are of _NOISE or of these, which tell what shape the thing has.
_SHAPE = frozenset(
    "area article articles aside bar body bottom box block boxes btn button buttons cell center col column container content desktop entry facebook fixed floating form global google group header holder home icon icons inline inner item items js layer left "
    "line link links list main media message mobile more notification outer overlay page panel parent placeholder policy post posts right row section site slot sticky story text thread title toggle tools top twitter ul unit user widget wp wrap wrapper zone".split()
)
_THREAD = frozenset("comment comments disqus related reply respond".split())
#: The words of which a name must consist to be a page's header.
_HEADER = frozenset("bar fixed global header main mobile site sticky top".split())
#: Words that make a message one of the site, not of the page.
_OF_SITE = frozenset("flash global info site status system".split())
_ITEM = frozenset("li dt dd ul ol dl dir".split())
_CELL = frozenset("td th tr table tbody thead tfoot".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# an element of the first kind ends the nearest open one of the second, or else of the third
_ENDS = {"li": (("li",),), "dt": (("dt", "dd"),), "dd": (("dt", "dd"),), "tr": (("tr",), ("td", "th")), "td": (("td", "th"),), "th": (("td", "th"),), "option": (("option",),)}
_SCOPE = frozenset("table td th ul ol dl article section main div body html".split())
_THROUGH_CELLS = frozenset("table tr tbody thead tfoot article main section body html".split())
_CONTROLS = frozenset("button input label select textarea".split())
_FURNITURE = frozenset("footer header nav".split())
#: Kinds of elements besides their tags, by which the nearest open one is found.
_KINDS = {t: tuple(k for k, tags in (("#heading", _HEADING), ("#scope", _SCOPE), ("#rows", _SCOPE - {"td", "th"}), ("#cell", {"td", "th", "table"}), ("#held", {"template", "noscript"})) if t in tags) for t in _SCOPE | _HEADING | {"template", "noscript"}}
_STANDS = frozenset("p pre blockquote".split()) | _HEADING
_RIGHTS = re.compile(r"\W*(?:\u00a9|\(c\)|copyright\b)", re.I)  # how a notice of rights begins
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f][\"'\u00bb\u201d\u2019)\]]*$")

# a tag's quoted values may hold angles, however long they are; a quote that stands elsewhere, or never ends, is a character
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>",
    re.S,
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN_INPUT = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile("[0-9]+")

#: Characters of a path, or of one of its steps or of a host, beyond which a digest stands for it: what is broadcast has a bound.
PATH_CHARS, STEP_CHARS, HOST_CHARS = 300, 120, 255


def _noise_words(values: list[str]) -> set[str]:
    """The words of _NOISE in those classes, ids and roles that hold no words but of _NOISE and _SHAPE."""
    found: set[str] = set()
    for value in values:
        for name in value.split():
            words = {w.lower() for w in _SPLIT.split(name) if w}
            if words <= _HEADER and "header" in words:
                found.add("header")
            elif words & {"message", "messages"} and words & _OF_SITE and words <= _OF_SITE | {"message", "messages"} | _SHAPE:
                found.add("message")
            elif noise := words & _NOISE:
                if words <= _NOISE | _SHAPE:
                    found |= noise
    return found


def _join(path: str, step: str) -> str:
    """A path with one more step; what is too long becomes a digest."""
    if len(path) > PATH_CHARS:
        path = "#" + hashlib.md5(path.encode()).hexdigest()
    if len(step) > STEP_CHARS:
        step = f"{step.partition('.')[0][:40]}.#{hashlib.md5(step.encode()).hexdigest()}"
    return f"{path}/{step}"


class Page:
    """A page's elements (parent, generalised path, whether dropped) and blocks of text.

    Elements that are noise by a class, id or role alone, and forms, are judged when all is read: they
    are noise, however large, unless the page's article is in them.  Elements are numbered as they open,
    so the blocks within one are neighbours: ``lo`` and ``hi`` are the first and the one after the last.
    What is looked up for each element or block is kept as the page is read, so that time is linear in the page.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.drop, self.inside = [-1], [""], [""], [False], [False]
        self.lo, self.hi, self.end = [0], [0], [1]  # ``end``: one more than the last element within
        self.block, self.box, self.plain_box = [0], [0], [0]  # the nearest block, container, and container that is no part of a list or table, itself counted
        self.of_item, self.of_cell = [0], [0]  # the nearest element that is no part of a list (or table), or else the outermost
        self.depth, self.jump = [0], [0]
        self.kind = [""]  # "name", "thread" or "form" of an element that is noise by its names
        self.noise = [0]  # the nearest such element, from the element itself upwards
        self.blocks: list[tuple[int, str, float]] = []  # (element, text, share of it in links)
        self._under: list[int] = []  # for each block, the nearest such element around its text
        self._anchors: tuple[list[int], list[int], list[int]] = ([], [], [])  # mains, articles, first headings
        self._furnished: set[int] = set()  # forms around parts of a page
        self._controls: list[int] = []  # elements that hold a control
        self._buffer: dict[int, list[str]] = {}
        self._linked: dict[int, int] = {}
        self._owner = 0
        self._parse(html)
        self._judge()

    def _flush(self) -> None:
        if self._buffer:
            for under, parts in self._buffer.items():
                text = _SPACE.sub(" ", "".join(parts)).strip()
                if text and not (self.tag[self.box[self._owner]] in ("", "html", "body") and _RIGHTS.match(text)):
                    self.blocks.append((self._owner, text, min(1.0, self._linked.get(under, 0) / len(text))))
                    self._under.append(under)
            self._buffer, self._linked = {}, {}

    def _stands(self, e: int, text: str, linked: float) -> bool:
        """Whether a block is text of its own: a paragraph, heading or sentence, and no notice of rights."""
        tag = self.tag[self.block[e]]
        return linked < 0.5 and (tag in _STANDS or self.inside[e] or (tag not in _ITEM | _CELL and _SENTENCE.search(text) is not None)) and not _RIGHTS.match(text)

    def _judge(self) -> None:
        """Drops the blocks within elements that are noise by their names.

        Where text of its own stands outside of all of them, they all are noise.  Where none does, those around the
        page's article are layout: around main, or else an article that is no reader's, or else a first
        heading; and a form around parts of a page, or around paragraphs in a container without controls.
        """
        if not any(self._under):
            return
        layout: set[int] = set()

        def around(e: int, threads: bool) -> None:
            held = []
            while e and e not in layout:
                held.append(e)
                e = self._above(e)
            if threads or not any(self.kind[x] == "thread" for x in held):
                layout.update(held)

        if not any(not under and self._stands(e, text, linked) for (e, text, linked), under in zip(self.blocks, self._under, strict=True)):
            for rank, anchors in enumerate(self._anchors):
                before = len(layout)
                for e in anchors:
                    around(self.noise[e], rank != 1)
                if len(layout) > before or any(not self.noise[e] for e in anchors):
                    break
            for e in self._furnished:
                around(e, False)
            controls = sorted(self._controls)
            for (e, _, _), under in zip(self.blocks, self._under, strict=True):
                if self.kind[under] == "form" and under not in layout and self.tag[self.block[e]] in _STANDS:
                    c = self.box[e]
                    at = bisect_left(controls, c)
                    if c > under and not (at < len(controls) and controls[at] < self.end[c]):
                        around(under, False)
        out = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            if self.kind[e]:
                out[e] = out[self._above(e)] or e not in layout
        kept = [not out[under] for under in self._under]
        number = [0]
        for k in kept:
            number.append(number[-1] + k)
        self.blocks = [b for b, k in zip(self.blocks, kept, strict=True) if k]
        self.lo, self.hi = [number[i] for i in self.lo], [number[i] for i in self.hi]

    def _above(self, e: int) -> int:
        return self.noise[self.parent[e]]

    def _opened(self, above: int, tag: str, path: str, drop: bool, inside: bool, kind: str) -> int:
        """The number of a new element."""
        e = len(self.tag)
        block = tag in _BLOCK
        container = block and tag not in _PARAGRAPH
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(path)
        self.drop.append(drop)
        self.inside.append(inside)
        self.kind.append(kind)
        self.noise.append(e if kind else self.noise[above])
        self.lo.append(len(self.blocks))
        self.hi.append(len(self.blocks))
        self.end.append(e + 1)
        self.block.append(e if block else self.block[above])
        self.box.append(e if container else self.box[above])
        self.plain_box.append(e if container and tag not in _ITEM | _CELL else self.plain_box[above])
        self.of_item.append(self.of_item[above] if tag in _ITEM and above else e)
        self.of_cell.append(self.of_cell[above] if tag in _ITEM | _CELL and above else e)
        # an ancestor's ancestor whose distance doubles, so that a walk upwards takes few steps
        far = self.jump[above]
        self.depth.append(self.depth[above] + 1)
        self.jump.append(self.jump[far] if self.depth[above] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]] else above)
        return e

    def _parse(self, html: str) -> None:
        stack = [0]
        places: dict[str, list[int]] = {}  # places in the stack, by tag and kind
        links = 0
        head = pre = 0  # the place of an open head in the stack; how many elements of code are open
        endless: set[str] = set()
        at, n = 0, len(html)

        def place(*names: str) -> int:
            """The place of the innermost open element of those tags or kinds; 0 if none is open."""
            return max([held[-1] for name in names if (held := places.get(name))], default=0)

        def text(s: str) -> None:
            if head and len(stack) == head + 1 and not s.isspace():
                pop_to(head)  # a head holds no text of its own
            if s and not self.drop[stack[-1]]:
                if "&" in s:
                    s = unescape(s)
                under = self.noise[stack[-1]]
                self._buffer.setdefault(under, []).append(s)
                if links:
                    self._linked[under] = self._linked.get(under, 0) + len(s)

        def pop_to(depth: int) -> None:
            nonlocal links, head, pre
            while len(stack) > depth:
                e = stack.pop()
                t = self.tag[e]
                if e:
                    places[t].pop()
                    for k in _KINDS.get(t, ()):
                        places[k].pop()
                links -= t == "a"
                pre -= t in ("pre", "code")
                if t in _BLOCK:
                    self._flush()
                self.hi[e], self.end[e] = len(self.blocks), len(self.tag)
            if head >= depth:
                head = 0

        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            close, tag, attrs = m[1], m[2], m[3]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
                continue
            tag = tag.lower()
            if close:
                if tag in _VOID:
                    continue
                d = place(tag)
                if d and (tag in _THROUGH_CELLS or d >= place("#cell")):
                    pop_to(d)
                self._owner = stack[-1]
                continue
            if head and tag not in _IN_HEAD and place("#held") < head:
                pop_to(head)  # the head's end tag may be left out
                self._owner = stack[-1]
            if tag in _BLOCK:  # a block ends an open paragraph
                d = place("p", "#heading") if tag in _HEADING else place("p")
                if d > place("#scope"):
                    pop_to(d)
            for ended in _ENDS.get(tag, ()):
                d = place(*ended)
                if d > place("#rows"):
                    pop_to(d)
                    break
            if tag in _BLOCK:
                self._flush()
            elif tag == "br":
                text(" ")
            above = stack[-1]
            if tag in _CONTROLS and not (tag == "input" and _HIDDEN_INPUT.search(attrs or "")):
                self._controls.append(above)
            if tag in _VOID:
                continue
            names: list[str] = []
            classes: list[str] = []
            hidden = main = False
            if attrs and not attrs.isspace():
                for a in _ATTR.finditer(attrs):
                    value = (a[2] or "").strip("\"'")
                    name = a[1].lower()
                    if name == "style":
                        hidden |= bool(_HIDE.search(value))
                    elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                        hidden = True
                    else:
                        names.append(value)
                        main |= name == "role" and value.lower() == "main"
                        if name == "class":
                            classes += value.lower().split()
            words = _noise_words(names) if names and not pre and tag not in ("html", "body", "main", "article") else ()
            inside = self.inside[above] or tag in ("article", "main")
            drop = self.drop[above] or tag in _DROPPED or hidden or (tag == "header" and not inside)
            path = _join(self.path[above], ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})])) if tag in _BLOCK else self.path[above]
            e = self._opened(above, tag, path, drop, inside, "form" if tag == "form" else "thread" if _THREAD.intersection(words) else "name" if words else "")
            if not drop:
                if main or tag == "main":
                    self._anchors[0].append(e)
                elif tag in ("article", "h1"):
                    self._anchors[1 if tag == "article" else 2].append(e)
            if tag in _FURNITURE and (d := place("form")):
                self._furnished.add(stack[d])
            places.setdefault(tag, []).append(len(stack))
            for k in _KINDS.get(tag, ()):
                places.setdefault(k, []).append(len(stack))
            stack.append(e)
            links += tag == "a"
            pre += tag in ("pre", "code")
            if tag == "head":
                head = len(stack) - 1
            if tag in _BLOCK:
                self._owner = e
            if tag in _RAW:
                end = None if tag in endless else re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                if end is None:
                    endless.add(tag)
                if end or tag in _CODE:
                    at = end.start() if end else n
        self._flush()
        pop_to(0)

    def scores(self) -> dict[int, float]:
        """Containers by the text in them that isn't links: whole for a paragraph's parent, half for the parent's parent, a quarter for the next.

        A list, or a table whose cells hold text without paragraphs, is a part of what it stands in.
        """
        out: dict[int, float] = {}
        for e, text, linked in self.blocks:
            e = self.block[e]
            own = len(text) * (1 - linked)
            if own <= 0 or _RIGHTS.match(text):
                continue
            outer = self.of_cell if self.tag[e] in _CELL else self.of_item
            e = self.box[outer[self.parent[e] if self.tag[e] in _PARAGRAPH and self.parent[e] else e]]
            share = 1.0
            while e > 0 and share > 0.2:
                out[e] = out.get(e, 0.0) + own * share * (1.2 if self.tag[e] in ("article", "main") else 1.0)
                share /= 2
                e = self.box[self.parent[e]]
        return out

    def choices(self) -> tuple[list[tuple[str, float, list[tuple[int, int]], int]], tuple[list[tuple[int, int]], int]]:
        """((path, score, ranges of blocks, the container around them) of every path with a container, the last two of the best one's path or of the whole page).

        Elements of one path have one depth, so none holds another.  Of several, those that are mostly
        links are left out, and where text stands by itself between the others, or they are rows,
        the element around them is taken.
        """
        scores = self.scores()
        if not scores:
            return [], ([(0, len(self.blocks))], -1)
        plain, linked, holders = [0.0], [0.0], set()
        for e, text, share in self.blocks:
            plain.append(plain[-1] + len(text) * (1 - share))
            linked.append(linked[-1] + len(text) * share)
            if share < 0.5:
                holders.add(self.box[e])
        on_path: dict[str, list[int]] = {}
        for e in scores:
            on_path.setdefault(self.path[e], []).append(e)
        out = []
        for path, on in on_path.items():
            most = max(scores[e] for e in on)
            if len(on) > 1:
                on = [e for e in on if plain[self.hi[e]] - plain[self.lo[e]] >= linked[self.hi[e]] - linked[self.lo[e]]] or on
            on.sort()
            around = self._around(on[0], on[-1])
            if (len(on) > 1 or self.tag[on[0]] in _CELL) and self.tag[around] not in ("", "html", "body") and around in holders:
                on, around = [around], self._next_box(around)
            elif len(on) == 1:
                around = self._next_box(on[0])
            out.append((path, most, [(self.lo[e], self.hi[e]) for e in on], around))
        best = self.path[max(scores, key=lambda e: (scores[e], -e))]
        return out, next((ranges, around) for path, _, ranges, around in out if path == best)

    def _around(self, first: int, last: int) -> int:
        """The least element that holds both, is neither, and is no part of a list or table."""
        e = self.parent[first]
        while self.end[e] <= last:
            e = self.jump[e] if self.end[self.jump[e]] <= last else self.parent[e]
        return self.plain_box[e]

    def _next_box(self, e: int) -> int:
        """The container around one; none (-1) around an article or the page itself."""
        return -1 if e <= 0 or self.tag[e] in ("article", "main") else self.box[self.parent[e]]

    def beside(self) -> tuple[list[int], dict[int, int]]:
        """(for each block that is text of its own the container that it stands in, else -1; the container around each container)."""
        where = []
        for e, text, linked in self.blocks:
            c = -1
            if self._stands(e, text, linked):
                c = self.box[e]
                while c and self.tag[c] in ("header", "hgroup"):
                    c = self.box[self.parent[c]]
            where.append(c)
        return where, {e: self._next_box(e) for e in range(len(self.tag)) if self.box[e] == e}


_RANGES = "array<struct<lo: int, hi: int>>"
_RANGE_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_OWN_TYPE = pa.struct([("ranges", _RANGE_TYPE), ("around", pa.int32())])
_PATH_TYPE = pa.list_(pa.struct([("path", pa.string()), ("vote", pa.int64()), ("ranges", _RANGE_TYPE), ("around", pa.int32())]))
_INTS = pa.list_(pa.int32())
#: Pages, and characters of them, whose blocks make one Arrow batch, at most (but for one longer page).
_PAGES, _CHARS = 256, 8 << 20


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    show = lambda ranges: [{"lo": lo, "hi": hi} for lo, hi in ranges]
    names = ["key", "blocks", "beside", "next", "paths", "own"]
    for batch in batches:
        done, size = 0, 0
        columns: list[list] = [[] for _ in names[1:]]
        for i, html in enumerate(batch.column(1)):
            html = html.as_py() or ""
            page = Page(html)
            found, (ranges, around) = page.choices()
            total = sum(s for _, s, _, _ in found)
            where, upward = page.beside()
            number = {e: k for k, e in enumerate(upward)} | {-1: -1}  # containers, by themselves
            row = (
                [t for _, t, _ in page.blocks], [number[c] for c in where], [number[c] for c in upward.values()],
                [{"path": p, "vote": round(1e6 * s / total), "ranges": show(r), "around": number[c]} for p, s, r, c in found], {"ranges": show(ranges), "around": number[around]},
            )
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            size += len(html)
            if len(columns[0]) == _PAGES or size >= _CHARS or i + 1 == batch.num_rows:
                keys = batch.column(0).slice(done, len(columns[0]))
                types = (pa.list_(pa.string()), _INTS, _INTS, _PATH_TYPE, _OWN_TYPE)
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)
                done, size = i + 1, 0
                columns = [[] for _ in names[1:]]


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's key (id, url and host), blocks, paths (path, vote, ranges of blocks and container around of every path with a container) and own (the latter two of the page's best).

    ``beside`` has the container of each block that is text of its own, ``next`` the container around each container.
    """
    id_, html = absent(pages, "id", "html")
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _host(url_col).alias("host")).alias(id_), F.col(html_col).alias(html))
    kind = rows.schema[id_].dataType.simpleString()
    own = f"ranges: {_RANGES}, around: int"
    return rows.mapInArrow(_parsed, f"key {kind}, blocks array<string>, beside array<int>, next array<int>, paths array<struct<path: string, vote: bigint, {own}>>, own struct<{own}>")


def host_paths(parsed: DataFrame) -> DataFrame:
    """(host, path) of ``parsed_pages``: the path with most votes of every host, the first in order of equal ones."""
    votes = parsed.select(F.col("key.host").alias("host"), F.explode("paths").alias("p"))
    summed = votes.groupBy("host", F.col("p.path").alias("path")).agg(F.sum("p.vote").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def _host(url_col: str):
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.when(F.length(host) > HOST_CHARS, F.md5(host)).otherwise(host)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen ranges of blocks, and the text beside them in the containers around."""
    for batch in batches:
        texts = []
        for row in batch.to_pylist():
            taken: set[int] = set()
            for r in row["chosen"]["ranges"]:
                taken.update(range(r["lo"], r["hi"]))
            around, c = set(), row["chosen"]["around"]
            while c >= 0:
                around.add(c)
                c = row["next"][c]
            taken.update(i for i, c in enumerate(row["beside"]) if c in around)
            texts.append("\n".join(row["blocks"][i] for i in sorted(taken)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``: the main text, blocks joined by newlines.

    Headings, paragraphs and sentences that stand beside the winning containers, in the elements around
    them, come with them.  Null or empty pages, and pages of nothing but menus, notices, comments and
    forms, have an empty text; pages without a host (or url) vote together; rows with equal ids are
    extracted each by itself; other columns are ignored.  The parsed pages are written once, to vote
    and to be extracted.
    """
    parsed = written(parsed_pages(pages, id_col, url_col, html_col))
    # rows of at most HOST_CHARS + PATH_CHARS + STEP_CHARS characters and little more
    paths = small_or_not(written(host_paths(parsed)))
    found = F.get(F.filter("paths", lambda p: p["path"] == F.col("path")), F.lit(0))
    chosen = F.when(found.isNull(), F.col("own")).otherwise(F.struct(found["ranges"].alias("ranges"), found["around"].alias("around")))
    joined = parsed.join(paths, F.col("key.host") == F.col("host"), "left").select(F.struct("key.id", "key.url").alias("key"), "blocks", "beside", "next", chosen.alias("chosen"))
    kind = joined.schema["key"].dataType.simpleString()
    return joined.mapInArrow(_assembled, f"key {kind}, text string").select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text")


def op3_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
