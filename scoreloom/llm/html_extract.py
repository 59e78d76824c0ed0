"""Main text of web pages by wrapper inference.

Pages of a host are grouped by template (the set of labels of their containers, over whole pages).
Every page of a template is turned into a token stream (tags with their class, and texts). Runs of equal
token groups are folded into repeated groups. Streams of one shape, which differ in texts alone, are joined where
they are read: texts that differ become slots. The shapes of a template are then aligned one by one with the wrapper so
far, in groups of bounded size whose wrappers are aligned in their turn: tokens that only
some pages have become optional groups. The wrapper is a regular expression without unions.

Every page of the template is read with it: the element with the slots of the article is the content
region; texts that are the same in all pages, in a part that is no plain paragraph, are left
out; parts whose name only resembles that of a menu or notice stay where the wrapper has slots of
running text in them. Word lists decide on tags and names that are plain marks, and alone
where a template has one page.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.scratch import small_side, stored

#: Constants need at least so many distinct pages of a template.
CONSTANT_PAGES = 3
#: Shapes or wrappers that are aligned in one group; characters of joined streams that a task holds before it sends them.
GROUP, HELD = 32, 8 << 20
#: Texts of streams beyond so many characters are told by a digest.
LONG = 48
#: Longest token group that is folded when repeated.
PERIOD = 12
#: Cells of a table of two streams' gaps that are compared by dynamic programming; larger gaps are parted at tokens that stand once in either, and without such merged greedily.
CELLS = 250_000

RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "xmp", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "label", "fieldset", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words in a class or id that mark a part without article text.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "sidenav", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "reply", "replies", "disqus", "footer", "header", "masthead", "widget", "toolbar", "skip", "search"}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTR = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NUMBERED, _DIGITS = re.compile(r"[-_]\d+\Z"), re.compile(r"\d+")
#: Elements that an open one of the same group ends, and what keeps them open (fixed by the rules of HTML).
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags of running text, whose constant texts stay.
_PLAIN = _HEADINGS | {"p", "li", "dd", "dt", "td", "th", "blockquote", "pre", "figcaption"}


def tokens(page: str) -> Iterator[tuple[str, str, dict]]:
    """('open' | 'close' | 'text', name or text, attributes); raw elements are left out. Linear in the page:
    once a tag is found whose quotes never close, tags end at their first '>'."""
    at, low, quoted = 0, None, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], {}
            return
        follows = page[start + 1 : start + 2]
        shut = follows == "/"
        m = _NAME.match(page, start + 1 + shut)
        if not m and follows not in ("!", "?"):
            end = start + 1  # a plain sign
            yield "text", page[at:end], {}
            at = end
            continue
        if start > at:
            yield "text", page[at:start], {}
        if not m:
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 1))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        end = -1
        if quoted:
            i = m.end()
            while sign := _QUOTE_OR_END.search(page, i):
                if sign[0] == ">":
                    end = sign.start()
                    break
                i = page.find(sign[0], sign.end()) + 1
                if not i:
                    break
            quoted = end >= 0
        if end < 0:
            end = page.find(">", m.end())
        if end < 0:  # a tag that never ends
            yield "text", page[start:], {}
            return
        name, raw, at = m[0].lower(), page[m.end() : end], end + 1
        if shut:
            yield "close", name, {}
            continue
        if name in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        yield "open", name, {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)} if "=" in raw else {}
        if name not in VOID and raw.endswith("/") and name in ("div", "span"):
            yield "close", name, {}


def _unwanted(name: str, attrs: dict) -> bool | None:
    """Whether an element holds no article text: True by a plain mark, None if its name only resembles one."""
    if name in DROPPED or attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if name in ("body", "html", "article", "main") or not ("class" in attrs or "id" in attrs):
        return False
    words = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if not MARKS.isdisjoint(words):
        return True
    return None if any(not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", w)) for w in words) else False


def _label(name: str, attrs: dict) -> str:
    """A tag with its class, or else its id, without what only numbers one page or item: words like post-17 beside others, and
    digits of ids."""
    own = attrs.get("class")
    if own:
        words = own.split()
        own = " ".join([w for w in words if not _NUMBERED.search(w)] or words)
    elif attrs.get("id"):
        own = "#" + _DIGITS.sub("0", attrs["id"])
    return f"{name}.{own}" if own else name


class _Open:
    """An open element: state is what the reader knows of the path to it."""

    __slots__ = ("name", "label", "attrs", "block", "state")

    def __init__(self, name: str, attrs: dict, around: _Open | None):
        self.name, self.label, self.attrs, self.state = name, _label(name, attrs), attrs, None
        self.block = self.label if name not in INLINE else around.block if around else ""


def _walk(parts) -> Iterator[tuple[str, object, _Open | None]]:
    """('text', text, innermost open element), ('open', element, the one around it), ('break', '', None) where
    a block begins or ends; end tags that are left out are supplied. Each element is pushed and popped
    once, and no search of the open ones is made that can't succeed."""
    stack: list[_Open] = []
    count: dict[str, int] = {}

    def cut(k: int) -> None:
        for e in stack[k:]:
            count[e.name] -= 1
        del stack[k:]

    for kind, name, attrs in parts:
        if kind == "text":
            yield "text", name, stack[-1] if stack else None
            continue
        if name not in INLINE:
            yield "break", "", None
        if kind == "close":
            if count.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                cut(k)
            continue
        if name not in INLINE and name not in VOID:
            ended, within = _ENDS.get(name, ((), ()))
            if count.get("p") or any(count.get(x) for x in ended):
                for k in range(len(stack) - 1, -1, -1):
                    inner = stack[k].name
                    if inner in ended or inner == "p":
                        cut(k)
                        if inner in ended or not ended:
                            break
                    elif inner in within or (inner not in INLINE and not ended):
                        break
        around = stack[-1] if stack else None
        element = _Open(name, attrs, around)
        yield "open", element, around
        if name not in VOID:
            stack.append(element)
            count[name] = count.get(name, 0) + 1


def _words(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _digest(text: str) -> str:
    return xxhash.xxh128_hexdigest(text.encode("utf-8", "surrogatepass"))


def told(words: str) -> str:
    """What a stream says of a text: itself, or its digest if it is long."""
    return words if len(words) <= LONG else f"\0{_digest(words)}"


def stream(page: str, parts: list | None = None) -> list[tuple]:
    """Token stream of a whole page for alignment: ('t', label) for tags, ('#', what is told of it, length) for texts."""
    out: list[tuple] = []
    for kind, name, attrs in tokens(page) if parts is None else parts:
        if kind == "text":
            if name.strip():
                words = _words(name)
                out.append(("#", told(words), len(words)))
        else:
            out.append(("t", _label(name, attrs) if kind == "open" else f"/{name}"))
    return out


def template(page: str, parts: list | None = None) -> str:
    """Digest of the labels of a page's containers: tags of blocks, but no running text, lists or tables. Numbers in labels
    are all alike."""
    parts = tokens(page) if parts is None else parts
    labels = {_label(n, a) for k, n, a in parts if k == "open" and n not in INLINE and n not in VOID and n not in _PLAIN and n not in ("ul", "ol", "dl", "tr", "table", "tbody", "thead")}
    return xxhash.xxh64_hexdigest("\n".join(sorted({_DIGITS.sub("0", x) for x in labels})).encode("utf-8", "surrogatepass"))


def _key(item: tuple) -> tuple:
    return ("#",) if item[0] == "#" else (item[0], *(map(_key, item[1])),) if item[0] in ("+", "?") else item


def _size(item: tuple) -> int:
    return item[2] if len(item) > 2 else len(item[1] or "")


def joined(x: tuple, y: tuple) -> tuple:
    """Two items of one key: a text stays where both have it, lengths are added."""
    if x[0] == "#":
        return ("#", x[1] if x[1] == y[1] else None, _size(x) + _size(y))
    return (x[0], [*map(joined, x[1], y[1])]) if x[0] in ("+", "?") else x


def _repeats(codes: np.ndarray, size: int) -> set[int]:
    """Places where a group of `size` items stands twice in a row."""
    if len(codes) < 2 * size:
        return set()
    alike = np.concatenate(([0], np.cumsum(codes[size:] == codes[:-size])))
    return set(np.flatnonzero(alike[size:] - alike[:-size] == size).tolist())


def fold(items: list[tuple]) -> list[tuple]:
    """Runs of equal groups become ('+', group); texts within it become slots."""
    codes = None
    for size in range(1, PERIOD + 1):
        if codes is None:
            keys, number = [_key(x) for x in items], {}
            codes = np.array([number.setdefault(k, len(number)) for k in keys])
        starts = _repeats(codes, size)
        if not starts:
            continue
        out, i = [], 0
        while i < len(items):
            if i not in starts:
                out.append(items[i])
                i += 1
                continue
            own, n = keys[i : i + size], 1
            while len(own) == size and keys[i + n * size : i + (n + 1) * size] == own:
                n += 1
            ends = [k for k in own if k[0] == "t" and k[1].startswith("/")]  # a group ends nothing that began before it
            if n > 1 and own != [("#",)] and own[0] not in ends and 2 * len(ends) <= sum(k[0] == "t" for k in own) and not all(k[0] == "+" for k in own):
                group = items[i : i + size]
                for k in range(1, n):
                    group = [*map(joined, group, items[i + k * size : i + (k + 1) * size])]
                out.append(("+", [("#", None, _size(x)) if x[0] == "#" else x for x in group]))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        if len(out) < len(items):
            items, codes = out, None
    return items


def _anchors(a: list[int], b: list[int], lo: tuple[int, int], hi: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of a longest rising run of the keys that stand once in either gap."""
    at: list[dict[int, int]] = []
    for x, k in ((a, 0), (b, 1)):
        seen: dict[int, int] = {}
        for i in range(lo[k], hi[k]):
            seen[x[i]] = -1 if x[i] in seen else i
        at.append(seen)
    pairs = [(i, at[1][x]) for x, i in at[0].items() if i >= 0 and at[1].get(x, -1) >= 0]
    ends, best, back = [], [], {}
    for i, j in sorted(pairs):
        k = bisect_left(ends, j)
        back[i, j] = best[k - 1] if k else None
        ends[k:], best[k:] = [j, *ends[k + 1 :]], [(i, j), *best[k + 1 :]]
    out, p = [], best[-1] if best else None
    while p:
        out.append(p)
        p = back[p]
    return out[::-1]


def _longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        above, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def matching(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places, rising in both, of equal keys."""
    out, todo = [], [((0, 0), (len(a), len(b)))]
    while todo:
        (i, j), (m, n) = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= CELLS:
            out += [(i + x, j + y) for x, y in _longest(a[i:m], b[j:n])]
        elif anchors := _anchors(a, b, (i, j), (m, n)):
            ends = [(i, j), *((x + 1, y + 1) for x, y in anchors)]
            todo += zip(ends, [*anchors, (m, n)])
            out += anchors
        else:
            places: dict[int, list[int]] = {}
            for y in range(j, n):
                places.setdefault(b[y], []).append(y)
            y = j - 1
            for x in range(i, m):
                later = places.get(a[x], ())
                k = bisect_right(later, y)
                if k < len(later):
                    y = later[k]
                    out.append((x, y))
    return sorted(out)


def align(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The wrapper generalised so that it also matches `page`, a stream or a wrapper itself."""
    bare, optional = [], []
    for items in (wrapper, page):
        bare.append([x for w in items for x in (w[1] if w[0] == "?" else [w])])
        optional.append([w[0] == "?" for w in items for _ in (w[1] if w[0] == "?" else [w])])
    number: dict = {}
    coded = [[number.setdefault(_key(x), len(number)) for x in items] for items in bare]
    out: list[tuple] = []
    i = j = 0
    for a, b in [*matching(*coded), (len(bare[0]), len(bare[1]))]:
        out += [("?", [x]) for x in bare[0][i:a]] + [("?", [x]) for x in bare[1][j:b]]
        if a < len(bare[0]):
            x = joined(bare[0][a], bare[1][b])
            out.append(("?", [x]) if optional[0][a] or optional[1][b] else x)
        i, j = a + 1, b + 1
    return out


def _weights(wrapper: list[tuple]) -> tuple[dict, list]:
    """Of each label, the characters in slots [outside links, in links]; constant texts that all pages have, with their block's label."""
    weight: dict[str, list[int]] = {}
    constant, stack, count = [], [[("", "", 0), 0, 0]], {}  # (label, block, links around), slots outside and in links

    def leave(k: int) -> None:
        while len(stack) > k:
            (label, *_), plain, links = stack.pop()
            stack[-1][1] += plain
            stack[-1][2] += links
            count[label] -= 1
            if not count[label]:  # of elements within their like only the outermost counts
                weight[label][0] += plain
                weight[label][1] += links

    def visit(items: list[tuple], always: bool) -> None:
        for x in items:
            (label, block, links), *_ = stack[-1]
            if x[0] in ("+", "?"):
                visit(x[1], False)
            elif x[0] == "#":
                if x[1] is None:
                    stack[-1][2 if links else 1] += x[2] if len(x) > 2 else 0
                elif always:
                    constant.append((block, x[1]))
            elif x[1].startswith("/"):
                k = len(stack) - 1
                while k and _tag(stack[k][0][0]) != x[1][1:]:
                    k -= 1
                if k:
                    leave(k)
            elif (tag := _tag(x[1])) not in VOID:
                if tag not in INLINE:
                    k = len(stack) - 1
                    while k and _tag(stack[k][0][0]) in INLINE:
                        k -= 1
                    if k and _tag(stack[k][0][0]) == "p":
                        leave(k)
                (label, block, links), *_ = stack[-1]
                weight.setdefault(x[1], [0, 0])
                count[x[1]] = count.get(x[1], 0) + 1
                stack.append([(x[1], x[1] if tag not in INLINE else block, links + (tag == "a")), 0, 0])

    visit(wrapper, True)
    leave(1)
    return weight, constant


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _attrs(label: str) -> dict:
    own = label.partition(".")[2]
    return {"id": own[1:]} if own.startswith("#") else {"class": own} if own else {}


def reading(wrapper: list[tuple], n_pages: int) -> dict:
    """What the wrapper tells of reading a page: region (label of the content region: article or main if
    the wrapper has them, else the innermost wanted element with over half of the slots' text), drop
    (constant texts by block), keep (labels that resemble a mark, but hold running text in slots)."""
    weight, constant = _weights(wrapper)
    wanted = {s: w[0] for s, w in weight.items() if _unwanted(_tag(s), _attrs(s)) is not True}
    region = None
    for name in ("article", "main"):
        if found := [s for s in wanted if _tag(s) == name]:
            region = region or max(found, key=lambda s: wanted[s])
    total = max((w for s, w in wanted.items() if _tag(s) in ("body", "html")), default=0) or max(wanted.values(), default=0)
    wide = [s for s in wanted if wanted[s] * 2 > total and _tag(s) in ("div", "section", "td", "body")]
    region = region or (min(wide, key=lambda s: (wanted[s], wide.index(s))) if wide else None)
    slots = any(sum(w) for w in weight.values())
    drop = sorted({(b, t) for b, t in constant if b not in _PLAIN and b != region}) if slots and n_pages >= CONSTANT_PAGES else []
    keep = sorted(s for s, (plain, links) in weight.items() if plain > links and _unwanted(_tag(s), _attrs(s)) is None)
    return {"region": region, "drop": drop, "keep": keep}


def shape(items: list[tuple]) -> str:
    """Digest of a folded stream without its texts."""
    return _digest(repr([*map(_key, items)]))


def wrap(shapes: dict[str, list[tuple]]) -> list[tuple]:
    """Wrapper of streams of different shapes, in the order of their digests."""
    wrapper = None
    for _, items in sorted(shapes.items()):
        wrapper = items if wrapper is None else align(wrapper, items)
    return wrapper or []


def gather(shapes: dict, key, items: list[tuple]) -> None:
    """Joins a stream to that of its shape."""
    shapes[key] = [*map(joined, shapes[key], items)] if key in shapes else items


def infer(pages: list[str]) -> tuple[list[tuple], dict]:
    """Wrapper of pages of one template, and how it reads a page."""
    shapes: dict[str, list[tuple]] = {}
    for p in pages:
        items = fold(stream(p))
        gather(shapes, shape(items), items)
    wrapper = wrap(shapes)
    return wrapper, reading(wrapper, len(pages))


def main_text(page: str, how: dict | None = None) -> str:
    """Text of the region on a page; without the region, of article, main or body. Of a header in the
    region only the headings stay."""
    parts, how = list(tokens(page)), how or {}
    drop, keep = {tuple(x) for x in how.get("drop", ())}, set(how.get("keep", ()))
    opened = {x for k, n, a in parts if k == "open" for x in (_label(n, a), n)}
    wanted = next((x for x in (how.get("region"), "article", "main") if x and x in opened), None)
    out: list[str] = []
    run: list[tuple[str, str, str]] = []  # texts of the block so far: block, decoded text, plain words

    def flush() -> None:
        for block, text, words in run:
            if not drop or (block, told(words)) not in drop:
                out.append(text)
        run.clear()
        out.append(" ")

    # state of an element: inside the region, in an unwanted part, in a header of the region, in a heading
    top = (wanted is None, False, False, False)
    for kind, x, e in _walk(parts):
        inside, bad, header, heading = e.state if e else top
        if kind == "break":
            flush()
        elif kind == "open":
            if wanted is not None and wanted in (x.label, x.name):
                inside = True
            elif x.name == "header" and inside and wanted is not None:
                header = True
            else:
                mark = _unwanted(x.name, x.attrs)
                bad = bad or mark is True or (mark is None and x.label not in keep)
            x.state = (inside, bad, header, heading or x.name in _HEADINGS)
        elif inside and not bad and (heading or not header):
            text = html.unescape(x)
            run.append((e.block if e else "", text, " ".join(text.split())))
    flush()
    return " ".join("".join(out).split())


def with_template(rows: DataFrame) -> DataFrame:
    """`rows` (host, html among them) with the column template."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([template(h or "") for h in b.column("html").to_pylist()], pa.string())], names=[*names, "template"])

    names = rows.columns
    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("template", T.StringType())]))


def _packed(items: list[tuple]) -> str:
    return json.dumps(items, separators=(",", ":"))


def _items(packed: str) -> list[tuple]:
    def back(x: list) -> tuple:
        return (x[0], [*map(back, x[1])]) if x[0] in ("+", "?") else tuple(x)

    return [*map(back, json.loads(packed))]


def _few(digests) -> list[int]:
    """As many of the distinct digests as tell whether there are CONSTANT_PAGES."""
    return sorted(set(digests))[:CONSTANT_PAGES]


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, html) to host, template, how (JSON): one row per template of a host, from all of its pages. Each task joins the
    streams of its pages shape by shape, and only these are moved. The shapes of a template are dealt to groups of
    about GROUP by their digests, each group gives a wrapper, and so on until each template has one."""
    fields = "host string, template string, shape string, pages array<long>, items string"

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        seen: dict[tuple, list[int]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys := list(held)), 1000):
                some = keys[lo : lo + 1000]
                yield pa.record_batch([*(pa.array(c, pa.string()) for c in zip(*some)), pa.array([seen[k] for k in some], pa.list_(pa.int64())), pa.array([_packed(held[k]) for k in some])], names=["host", "template", "shape", "pages", "items"])

        for b in batches:
            for host, page, digest in zip(*(b.column(c).to_pylist() for c in ("host", "html", "digest"))):
                parts = list(tokens(page or ""))
                items = fold(stream(page or "", parts))
                key = (host, template(page or "", parts), shape(items))
                size += 0 if key in held else 30 * len(items)
                gather(held, key, items)
                seen[key] = _few([*seen.get(key, ()), digest])
                if size > HELD:
                    yield from sent()
                    held.clear(), seen.clear()
                    size = 0
        yield from sent()

    def one(pdf):
        import pandas as pd

        streams: dict[str, list[tuple]] = {}
        for key, items in zip(pdf["shape"], pdf["items"]):
            gather(streams, key, _items(items))
        pages = _few(d for own in pdf["pages"] for d in own)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [pdf["template"].iloc[0]], "shape": [min(streams)], "pages": [pages], "items": [_packed(wrap(streams))]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            how = [json.dumps(reading(_items(x), len(p)), ensure_ascii=False) for x, p in zip(b.column("items").to_pylist(), b.column("pages").to_pylist())]
            yield pa.record_batch([b.column("host"), b.column("template"), pa.array(how, pa.string())], names=["host", "template", "how"])

    found = stored(rows.select("host", "html", F.xxhash64("html").alias("digest")).mapInArrow(shapes, fields), "shapes")
    left = True
    while left:
        told_ = found.groupBy("host", "template").agg(F.countDistinct("shape").alias("n")).select("host", "template", F.ceil(F.col("n") / GROUP).cast("long").alias("groups"))
        told_ = small_side(told_, "groups")
        left = (told_.agg(F.max("groups")).first()[0] or 0) > 1
        dealt = found.join(told_, ["host", "template"]).withColumn("group", F.pmod(F.xxhash64("shape"), F.col("groups")))
        found = stored(dealt.groupBy("host", "template", "group").applyInPandas(one, fields), "wrapped")
    return found.select("host", "template", "items", "pages").mapInArrow(read, "host string, template string, how string")


def extract(pages: DataFrame, use_wrappers: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html is an empty page; a null URL belongs to
    the host ''; rows that repeat an id or a URL are read one by one, each by its own html; other columns
    are left out. Wrappers are measured and joined by broadcast while they are small,
    so pages are not shuffled."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"\A[^:/?#]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    known = with_template(rows).join(small_side(wrappers(rows), "wrappers"), ["host", "template"], "left") if use_wrappers else rows.withColumn("how", F.lit(None).cast("string"))
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for b in batches:
            text = []
            for h, r in zip(b.column("html").to_pylist(), b.column("how").to_pylist()):
                if r and r not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[r] = json.loads(r)
                text.append(main_text(h or "", parsed[r] if r else None))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=schema.names)

    return known.select("page_id", "url", "html", "how").mapInArrow(read, schema)


def wrapper_text(wrapper: list[tuple]) -> str:
    """The wrapper as a readable expression, e.g. for logs and tests."""
    return json.dumps(wrapper, ensure_ascii=False)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
