"""Main-text extraction with wrappers: union-free regular expressions inferred for each host.

Inference aligns the token streams of a host's pages one after the other. An expression is a list of
items; an item is an element (label, flags, items, occurrences) or a text (flags, literal, characters,
occurrences). Aligning two expressions matches items in order by a longest common subsequence; what only
one side has becomes optional, neighbours alike and groups of any length that recur become repeated items,
and texts that differ become slots. Map tasks align the pages they hold, so that only one small expression
for each task and host is shuffled; those are aligned in two steps, first by (host, salt).

The finished wrapper alone says which places (paths of labels) of the host hold content; ``places`` reads it
off the expression, and a page's text is what stands at those places:

* what slots hold counts, by characters over all pages; texts in links do not. Articles hold the content
  where they have most of it, weighted ``WEIGHTS`` to one, else main, else the body. Of several kinds of
  article those count that hold at least a quarter of what the largest holds, so teasers do not.
* repeated items whose texts are all links are menus, inside articles too.
* literals on all pages are the template. In articles, and in places that hold other texts too, that goes for
  hosts with ``MANY_PAGES`` or more where literals are a small part, so near copies of a page keep their text.
* elements that are furniture by tag, or by a class, role or id that is a listed word or made of listed
  words only (cookie-notice, not no-sidebar), hold none: menus, headers, footers, sidebars, notices, adverts,
  forms, comments. html, body, main and article are never judged by name.

A host with fewer than ``MIN_PAGES`` pages shows neither menus by links nor a template, so only elements and
names decide there. Expressions nest at most ``MAX_DEPTH`` deep; elements below stand beside each other, and
whether they are furniture is told by all that they stand in.

The table of wrappers is written first, so its size is known: Spark broadcasts it while it is below its
own threshold, and joins by host beyond that.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, read_table, utf8, written

MIN_PAGES, MANY_PAGES = 3, 8
SALTS = 32
MAX_DEPTH = 100
#: What a character in an article, in main and in the rest of the body weighs.
WEIGHTS = {1: 64, 2: 8, 3: 1}
OPTIONAL, REPEATED = 1, 2

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: An opening tag of the key ends open elements of these names.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements that stop the search for an open element to end.
SCOPE = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "html", "main", "nav", "aside", "footer", "header", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "head", "svg", "menu", *RAW}
OTHER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr",
    "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
    "popup", "promo", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Elements whose class, id and role describe the page or the content, whatever words they hold.
CONTAINERS = {"html", "body", "main", "article"}


class Place:
    """A path of labels. level: 1 in an article, 2 in main, 3 in the body, 0 elsewhere (not content)."""

    __slots__ = ("label", "tag", "key", "level", "children", "masthead", "parent")

    def __init__(self, parent: Place | None, label: str):
        self.label, self.children, self.parent = label, {}, parent
        self.tag, _, words = label.partition(".")
        self.key = xxhash.xxh64_intdigest(f"{parent.key if parent else 0}/{label}") - 2**63
        above = parent.level if parent else 3
        kinds = set(words.split("."))
        named = set() if self.tag in CONTAINERS else kinds
        self.masthead = bool(parent and parent.masthead) or self.tag == "header" or "header" in named
        if above == 0 or self.tag in OTHER_TAGS or "[hidden]" in kinds or named & OTHER_WORDS:
            self.level = 0
        elif self.tag == "article":
            self.level = 1
        elif self.tag == "main" or "main" in kinds:
            self.level = min(above, 2)
        else:
            self.level = above

    def child(self, label: str) -> Place:
        found = self.children.get(label)
        if found is None:
            found = self.children[label] = Place(self, label)
        return found

    def content(self, in_heading: bool) -> int:
        """The level of text here; of a header, even an article's, only headings inside an article count."""
        if self.masthead and not (self.level == 1 and in_heading):
            return 0
        return self.level


def _label(tag: str, attributes: str) -> str:
    if not attributes or attributes.isspace():
        return tag
    words = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            words.add("[hidden]")
        else:
            for name in "".join(values).split():
                parts = _WORDS.findall(_CAMEL.sub(" ", name).lower())
                if OTHER_WORDS.issuperset(parts):  # cookie-notice is furniture, no-sidebar is not
                    words.update(parts)
                elif parts:
                    words.add("-".join(parts))
                    words.update({"main"}.intersection(parts) if OTHER_WORDS.isdisjoint(parts) else ())
    return ".".join([tag, *sorted(words)]) if words else tag


_ROOT: list = [Place(None, "")]
_MANY = 20_000


def _root() -> Place:
    """The shared tree of places; begun anew when odd pages have made it large."""
    count, work = 0, [_ROOT[0]]
    while work and count < _MANY:
        place = work.pop()
        count += 1
        work.extend(place.children.values())
    if count >= _MANY:
        _ROOT[0] = Place(None, "")
    return _ROOT[0]


class _Tags:
    """The tags of a page from left to right, in time that grows with the page whatever it holds.

    A ``<`` that no tag begins with is text. Where one does not end, its quotes are followed by places, and what led nowhere
    is remembered: a later tag that comes by there does not end either.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.special: list[int] | None = None
        self.dead: set[int] = set()

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, slash, name, attributes) of the next tag; the name is None for comments and declarations."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", None, ""
            if start > self.last:  # nothing ends any more but a comment, at the end
                start = page.find("<!--", start)
                return None if start < 0 else (start, len(page), "", None, "")
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", None, ""
            if self.special is None and (m := _TAG.match(page, start)):
                return start, m.end(), m[1], m[2], m[3]
            if (m := _NAME.match(page, start)) and (end := self._end(m.end())) is not None:
                return start, end + 1, m[1], m[2], page[m.end() : end]
            at = start + 1
        return None

    def _end(self, at: int) -> int | None:
        """The first ``>`` from here that is in no quotes."""
        if self.special is None:
            self.special = [m.start() for m in _SPECIAL.finditer(self.page)]
        seen = []
        while True:
            i = bisect_left(self.special, at)
            place = self.special[i] if i < len(self.special) else -1
            if place < 0 or place in self.dead:
                break
            if self.page[place] == ">":
                return place
            seen.append(place)
            at = self.page.find(self.page[place], place + 1) + 1
            if not at:
                break
        self.dead.update(seen)
        return None


class _Deep:
    """Open elements below ``MAX_DEPTH``: whether text in them counts, by the same rules as above, at any depth."""

    def __init__(self):
        self.open: list[tuple[str, Place, bool]] = []
        self.count: dict[str, int] = {}

    def enter(self, stack: list[Place], tag: str, label: str) -> None:
        place, heading = self.open[-1][1:] if self.open else (stack[-1], any(x.tag in HEADINGS for x in stack))
        own = Place(place, label)
        if (own.level, own.masthead) == (place.level, place.masthead):
            own = place  # nothing new, so a chain of places does not grow
        self.open.append((tag, own, heading or tag in HEADINGS))
        self.count[tag] = self.count.get(tag, 0) + 1

    def leave(self, tag: str) -> bool:
        """Close the innermost element with this tag, and those inside; False if there is none."""
        if not self.count.get(tag):
            return False
        while True:
            name = self.open.pop()[0]
            self.count[name] -= 1
            if name == tag:
                return True

    def shut(self) -> None:
        self.open.clear()
        self.count.clear()

    def holds_text(self) -> bool:
        return not self.open or self.open[-1][1].content(self.open[-1][2]) > 0


def events(page: str, root: Place) -> Iterator[tuple[str, Place, str]]:
    """('open' | 'close' | 'text', place, text) of a page, in order; line breaks are texts of a space.

    Elements below ``MAX_DEPTH`` open and close at once, and their text belongs to the place above, unless they hold none.
    """
    stack, deep, tags = [root], _Deep(), _Tags(page)
    at, size = 0, len(page)
    while at < size:
        m = tags.next(at)
        start, end, slash, name, attributes = m or (size, size, "", None, "")
        if start > at and deep.holds_text():
            yield "text", stack[-1], page[at:start]
        at = end
        if name is None:
            continue
        tag = name.lower()
        if slash:
            if deep.leave(tag):
                place = stack[-1].child(tag)
                yield "open", place, ""
                yield "close", place, ""
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    deep.shut()
                    while len(stack) > i:
                        yield "close", stack.pop(), ""
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            if deep.holds_text():
                yield "text", stack[-1], " "
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}[\s/>]").search(page, at)
            if end is None:
                return
            close = page.find(">", end.start())
            at = size if close < 0 else close + 1
            continue
        ends = ENDS.get(tag, ())
        if tag in BLOCK and not deep.open:
            _depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", *HEADINGS) or stack[i].tag in SCOPE), 0)
            if _depth and stack[_depth].tag in ("p", *HEADINGS):
                while len(stack) > _depth:
                    yield "close", stack.pop(), ""
        if ends and not deep.open:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag in SCOPE), 0)
            if depth and stack[depth].tag in ends:
                while len(stack) > depth:
                    yield "close", stack.pop(), ""
        label = _label(tag, attributes)
        place = stack[-1].child(label)
        yield "open", place, ""
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            yield "close", place, ""
        elif len(stack) > MAX_DEPTH:
            deep.enter(stack, tag, label)
            yield "close", place, ""
        else:
            stack.append(place)
    while len(stack) > 1:
        yield "close", stack.pop(), ""


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


# --- expressions: [label, flags, items, occurrences] and ["", flags, [[literal, length], ..], characters, occurrences, pages]


def expression(page: str, root: Place) -> list:
    """The expression of one page: all texts are literals, given by their hash."""
    top: list = []
    stack = [top]
    for kind, place, text in events(page, root):
        if kind == "open":
            item = [place.label, 0, [], 1]
            stack[-1].append(item)
            stack.append(item[2])
        elif kind == "close":
            done = stack.pop()
            done[:] = fold(done)
        elif words := squeeze(text):
            stack[-1].append(["", 0, [[xxhash.xxh32_intdigest(words), len(words)]], len(words), 1, 1])
    return fold(top)


def merge(a: list, b: list, one_page: bool = False) -> list:
    """One item for two with the same label, of one page or of different ones."""
    flags = a[1] | b[1]
    if a[0]:
        return [a[0], flags, align(a[2], b[2], one_page), a[3] + b[3]]
    if one_page:
        both = sorted(dict(map(tuple, [*a[2], *b[2]])).items())
        return ["", flags, [list(x) for x in both], a[3] + b[3], a[4] + b[4], max(a[5], b[5])]
    common = a[2] if a[2] == b[2] else [x for x in a[2] if x[0] in {y[0] for y in b[2]}] if a[2] and b[2] else []
    return ["", flags, common, a[3] + b[3], a[4] + b[4], a[5] + b[5]]


def _recurring(same: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(first, times) of every group of ``size`` items that recurs at once; ``same`` marks what equals the item ``size`` later."""
    edges = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    found, free = [], 0
    for start, end in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()):
        start = max(start, free)
        if end - start >= size:
            times = (end - start) // size + 1
            found.append((start, times))
            free = start + times * size
    return found


def fold(items: list) -> list:
    """Neighbours with one label, and groups of any length that recur, become repeated items."""
    if len(items) < 2:
        return items
    names: dict[str, int] = {}
    labels = [names.setdefault(x[0], len(names)) for x in items]
    if len(names) == len(items):
        return items
    numbers, size = np.array(labels), 1
    while 2 * size <= len(items):
        same = numbers[size:] == numbers[:-size]
        found = _recurring(same, size) if np.count_nonzero(same) >= size else []
        out, kept, at = [], [], 0
        for start, times in found:
            group = items[start : start + size]
            for again in range(start + size, start + times * size, size):
                group = [merge(x, y, True) for x, y in zip(group, items[again : again + size])]
            for x in group:
                x[1] |= REPEATED
            out += items[at:start] + group
            kept.append(np.arange(at, start + size))
            at = start + times * size
        if found:
            numbers = numbers[np.concatenate([*kept, np.arange(at, len(items))])]
            items = out + items[at:]
        size += 1
    return items


def _steps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of x and each beginning of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for value in x:
        row[1:] = np.maximum(row[1:], (row[:-1] + 1) * (y == value))
        np.maximum.accumulate(row, out=row)
    return row


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of two sequences of numbers, in memory linear in both.

    Halves of x meet the best cut of y until the parts are small; numbers one side lacks are left out first.
    """
    keep, other = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    x, y, out, work = x[keep], y[other], [], [(0, len(keep), 0, len(other))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            out += [(a, c + int(j)) for j in np.flatnonzero(y[c:d] == x[a])[:1]]
            continue
        half = (a + b) // 2
        total = _steps(x[a:half], y[c:d]) + _steps(x[half:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(total.argmax())
        work += [(a, half, c, cut), (half, b, cut, d)]
    return sorted((int(keep[i]), int(other[j])) for i, j in out)


def align(a: list, b: list, one_page: bool = False) -> list:
    """The expression of two lists of items: a longest common subsequence of labels, the rest optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y, one_page) for x, y in zip(a, b)]
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i][0] != b[i][0]), most)
    tail = next((i for i in range(most - head) if a[-1 - i][0] != b[-1 - i][0]), most - head)
    places = [(i, i) for i in range(head)]
    if head + tail < most:
        names: dict[str, int] = {}
        x, y = (np.array([names.setdefault(i[0], len(names)) for i in side[head : len(side) - tail]], np.int64) for side in (a, b))
        places += [(head + i, head + j) for i, j in common(x, y)]
    places += [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    out, i, j = [], 0, 0
    for to_i, to_j in [*places, (len(a), len(b))]:
        for item in [*a[i:to_i], *b[j:to_j]]:
            out.append([item[0], item[1] | OPTIONAL, *item[2:]])
        if to_i < len(a):
            out.append(merge(a[to_i], b[to_j], one_page))
        i, j = to_i + 1, to_j + 1
    return out


def regular_expression(items: list) -> str:
    """An expression as text: (..)? optional, (..)+ repeated, (..)* both, #PCDATA for slots."""
    parts = []
    for label, flags, inner, chars, *occurrences in items:
        literal = inner[0][0] if not label and len(inner) == 1 and inner[0][1] * occurrences[0] == chars else None
        body = f"<{label}>{regular_expression(inner)}</{label}>" if label else "#PCDATA" if literal is None else f"'{literal:08x}'"
        parts.append(f"({body}){('', '?', '+', '*')[flags]}" if flags else body)
    return "".join(parts)


def _host(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, n_pages): the expression of each host as JSON. Null pages count as empty ones."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[list, int]] = {}
        names = ["host", "wrapper", "n_pages"]

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(e, separators=(",", ":")), n) for h, (e, n) in found.items()]
            hosts, made, counts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(made), pa.array(counts, pa.int64())], names)

        for batch in batches:
            root = _root()
            for url, raw in zip(*batch.columns):
                own, host = expression(raw.as_py().decode("utf-8", "replace"), root), _host(url.as_py())
                before = found.get(host)
                found[host] = (align(before[0], own), before[1] + 1) if before else (own, 1)
            if len(found) > 1000:
                yield out()
                found.clear()
        if found:
            yield out()

    def joined(keys: list[str]):
        def run(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["wrapper"].to_pylist(), table["n_pages"].to_pylist()))
            whole, n = json.loads(rows[0][0]), rows[0][1]
            for text, more in rows[1:]:
                whole, n = align(whole, json.loads(text)), n + more
            head = [pa.array(table[k].to_pylist()[:1], table.schema.field(k).type) for k in keys]
            return pa.table([*head, pa.array([json.dumps(whole, separators=(",", ":"))]), pa.array([n], pa.int64())], [*keys, "wrapper", "n_pages"])

        return run

    given = pages.select(F.col(url_col).cast("string"), utf8(F.col(html_col)))
    parts = given.mapInArrow(partial, "host string, wrapper string, n_pages long")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    first = salted.groupBy("host", "salt").applyInArrow(
        joined(["host", "salt"]), "host string, salt int, wrapper string, n_pages long"
    )
    return first.select("host", "wrapper", "n_pages").groupBy("host").applyInArrow(
        joined(["host"]), "host string, wrapper string, n_pages long"
    )


class Kind:
    """What a wrapper knows of one place: characters below it, those in links, and whether it repeats."""

    __slots__ = ("place", "chars", "linked", "repeats")

    def __init__(self, place: Place):
        self.place, self.chars, self.linked, self.repeats = place, 0, 0, False


def places(wrapper: list, n_pages: int) -> tuple[list[int], list[int], list[int]]:
    """(keys of places with content, their levels, keys of template texts) of a finished wrapper."""
    known: dict[int, Kind] = {}
    texts: list[tuple[Place, bool, list, bool]] = []  # place, in a heading, literals, on all pages
    mixed: set[int] = set()  # places that hold other texts than literals
    articles: dict[int, int] = {}  # characters of the topmost articles, by place
    free = {1: 0, 2: 0, 3: 0}  # characters outside links by level
    slots = {1: 0, 2: 0, 3: 0}  # those of slots

    def walk(items: list, place: Place, in_heading: bool, always: bool, in_link: bool, article: int) -> tuple[int, int]:
        """Characters of texts, and of those in links, below."""
        total = linked = 0
        for label, flags, inner, chars, *counts in items:
            on_all = always and not flags & OPTIONAL
            if not label:
                other = max(0, chars - sum(n for _, n in inner) * counts[1])
                total, linked = total + chars, linked + chars * in_link
                texts.append((place, in_heading, inner, on_all))
                if other:
                    mixed.add(place.key)
                level = place.content(in_heading)
                if level and not in_link:
                    free[level] += chars
                    slots[level] += other
                    if article:
                        articles[article] = articles.get(article, 0) + chars
                continue
            child = place.child(label)
            top = child.key if not article and child.tag == "article" and child.level else article
            n, in_links = walk(inner, child, in_heading or child.tag in HEADINGS, on_all, in_link or child.tag == "a", top)
            total, linked = total + n, linked + in_links
            kind = known.setdefault(child.key, Kind(child))
            kind.chars, kind.linked = kind.chars + n, kind.linked + in_links
            kind.repeats = kind.repeats or bool(flags & REPEATED)
        return total, linked

    walk(wrapper, Place(None, ""), False, True, False, 0)
    best = max((1, 2, 3), key=lambda x: WEIGHTS[x] * free[x])
    largest = max(articles.values(), default=0)
    menus = {
        key for key, k in known.items()
        if k.repeats and k.chars and k.chars == k.linked and k.place.tag in BLOCK and k.place.tag not in ("p", *HEADINGS)
        and n_pages >= MIN_PAGES and 4 * k.linked <= free[k.place.level or 3]
    }
    left_out = menus | {key for key, chars in articles.items() if 4 * chars < largest and n_pages >= MIN_PAGES}
    few = {x: n_pages >= MANY_PAGES and 5 * (free[x] - slots[x]) <= slots[x] for x in free}

    def outside(place: Place | None) -> bool:
        while place is not None and place.key not in left_out:
            place = place.parent
        return place is not None

    levels: dict[int, int] = {}
    template: set[int] = set()
    for place, in_heading, literals, on_all in texts:
        level = place.content(in_heading)
        if not level or outside(place):
            continue
        # Where articles hold next to nothing of a host's text they are no better than the rest of the page.
        levels[place.key] = min(levels.get(place.key, 9), max(level, best))
        if on_all and n_pages >= MIN_PAGES and (few[level] or level > 1 and place.key not in mixed):
            template.update(_text_key(place, literal) for literal, _ in literals)
    # Pages that are all alike show no template.
    return list(levels), list(levels.values()), sorted(template) if any(slots.values()) else []


def _text_key(place: Place, text_hash: int) -> int:
    return xxhash.xxh64_intdigest(f"{place.key}:{text_hash}") - 2**63


def main_text(page: str, levels: dict[int, int] | None, template: set[int], root: Place) -> str:
    """The text of a page at the places its wrapper names; without a wrapper (None) elements and names decide."""
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    level = headings = 0

    def end() -> None:
        if parts and (text := squeeze_joined(parts)):
            blocks.append((level, text))
        parts.clear()

    for kind, place, text in events(page, root):
        if kind == "text":
            here = place.content(headings > 0)
            if levels is not None and here:
                here = levels.get(place.key, 0)
                if not here and not squeeze(text):
                    here = level  # white space belongs to what it stands in
            if not here:
                continue
            if template and not text.isspace() and _text_key(place, xxhash.xxh32_intdigest(squeeze(text))) in template:
                continue
            if here != level:
                end()
                level = here
            parts.append(text)
            continue
        if place.tag in HEADINGS:
            headings += 1 if kind == "open" else -1
        if place.tag in BLOCK:
            end()
        elif place.tag in ("td", "th"):
            parts.append(" ")
    end()
    best = min((x for x, _ in blocks), default=0)
    return "\n".join(text for x, text in blocks if x == best)


def squeeze_joined(parts: list[str]) -> str:
    """Parts are decoded one by one, as character references don't span markup."""
    return " ".join("".join(map(html.unescape, parts)).split())


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars) of every page, with the wrappers (host, wrapper, n_pages).

    Null and empty pages, and pages without main text, have an empty text. A page of a host without a
    wrapper is judged by elements and names alone. A null URL, or one without a
    host, belongs to the host ''. Repeated rows stay. Text inside a block has single spaces.
    """

    def compile_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [places(json.loads(w.as_py()), n.as_py()) for w, n in zip(batch.column(1), batch.column(2))]
        kept, levels, template = zip(*rows)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        made = [pa.array(x, k) for x, k in zip((kept, levels, template), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], ["host", "kept", "levels", "template"])

    compiled = arrow_map(
        wrappers.select("host", "wrapper", "n_pages"), "host string, kept array<long>, levels array<int>, template array<long>", compile_batch
    )

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        root, known, out = _root(), {}, []
        for host, raw, *lists in zip(*batch.columns[2:]):
            host = host.as_py()
            if host not in known:
                kept, levels, template = (x.as_py() for x in lists)
                known[host] = (None, set()) if kept is None else (dict(zip(kept, levels)), set(template))
            out.append(main_text(raw.as_py().decode("utf-8", "replace"), *known[host], root))
        made = [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *made], [id_col, url_col, "text", "n_chars"])

    address = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = pages.select(id_col, url_col, address.alias("host"), utf8(F.col(html_col)).alias("raw"))
    both = given.join(written(compiled, "wrappers"), "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()
    columns = both.select(id_col, url_col, "host", "raw", "kept", "levels", "template")
    return arrow_map(columns, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long", per_batch)


def op9_wrappers(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, written(infer(pages), "host-expressions"))
