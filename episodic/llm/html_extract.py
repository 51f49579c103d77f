"""Main text of web pages by wrappers inferred from pages of the same host.

A page becomes a stream of symbols: block elements' tags and text slots.
Tandem repeats are folded into groups ``( ... )+``, which leaves few distinct
streams.  For each host these streams are aligned one after another with the
wrapper so far, a union-free regular expression: where one side has a part the
other lacks, the part becomes an optional group; where one side repeats what
the other has once, it becomes a repeated group; differing text is a slot.
Every slot of the wrapper is then judged once for the host: slots inside
navigation, headers, footers, side bars, notices, adverts, forms and reader
comments are left out; of the others those inside the article (or ``main``)
are the main text, or, on hosts without one, all but link lists.

All pages take part in the inference: tasks parse their pages once, count the
distinct streams of each host and write the pages' blocks; only distinct
streams are gathered by host, so a hot host is no larger a group than its
number of layouts.

Defined cases: null html is empty; pages without main text get an empty
string; null URLs share the empty host; pages cut off anywhere are read as far
as they go; repeated rows and null ids are kept.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reuse
from .common import table
from .url_filter import host_and_path

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Text up to the end tag, or to the end of the page.
RAW = {"script", "style", "textarea", "title"}
#: Left out with all they hold if their own end tag follows; otherwise only the tag itself is left out.
LEFT_OUT = {"noscript", "template", "iframe", "svg", "math", "object", "video", "audio", "canvas", "select", "button"}
HOLDS = re.compile(rf"<(?:{'|'.join(sorted(LEFT_OUT))})[\s/>]", re.I)
#: ``<svg .../>``, but not a slash that ends an unquoted value.
EMPTY = re.compile(r"(?<!\S)/$|[\"']/$|^/$|(?:^|\s)[^\s=\"']+/$")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
UNSEEN = {"html", "body"}
#: What an open element's tag ends without a closing tag.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = {"html", "body"}
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "figcaption"}
CHROME_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "banner", "bottombar", "breadcrumb", "breadcrumbs", "byline", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu",
    "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "privacy", "promo",
    "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets", "complementary", "contentinfo", "search", "alert"}
ARTICLE = {"article", "main"}
#: Elements whose text is prose even where it is all links.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "caption"}
LONGEST_REPEAT = 12


@dataclass
class Page:
    """The symbols of a page and its text blocks: (symbol number, text, characters inside links)."""

    symbols: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _words(attributes: str) -> str:
    """Class, id and role words of a tag, sorted, without digits; names such as ``with-sidebar`` say nothing of the tag itself."""
    if "=" not in attributes:
        return ""
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = {w for w in re.split(r"[^a-z]+", name) if w}
            if not parts & {"with", "without", "has", "no"}:
                words |= parts
    return ".".join(sorted(words))


def _raw_end(source: str, name: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(source, at)
    return end.end() if end else len(source)


def left_out(source: str) -> dict[int, int]:
    """Where each closed element of ``LEFT_OUT`` ends, by the end of its opening tag; one that its parent's end tag or the page's end cuts off isn't closed."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = defaultdict(int)

    def pop_to(name: str) -> int:
        while True:
            top, start = stack.pop()
            count[top] -= 1
            if top == name:
                return start

    at = 0
    for m in iter(lambda: TAG.search(source, at), None):
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in INLINE or name in VOID:
            continue
        if m[1]:
            if count[name]:
                start = pop_to(name)
                if name in LEFT_OUT:
                    ends[start] = at
            continue
        empty = bool(EMPTY.search(m[3]))
        if name in RAW:
            if empty and (count["svg"] or count["math"]):
                ends[at] = at
            else:
                at = _raw_end(source, name, at)
            continue
        if name in LEFT_OUT and empty:
            continue
        if name in ("button", "select") and count[name]:  # they don't nest: the one before has no end tag
            pop_to(name)
        stack.append((name, at))
        count[name] += 1
    return ends


def parse(source: str) -> Page:
    """The block structure of a page as far as it goes."""
    page, stack, text = Page(), [], []
    after = left_out(source) if HOLDS.search(source) else {}
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                if page.symbols and page.symbols[-1] == "#":
                    page.blocks.append((len(page.symbols) - 1, block, linked))
                else:
                    page.blocks.append((len(page.symbols), block, linked))
                    page.symbols.append("#")
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            page.symbols.append("/" + stack.pop())

    at = 0
    for m in iter(lambda: TAG.search(source, at), None):
        if m.start() > at:
            piece = source[at:m.start()]
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and (name in RAW or name in LEFT_OUT):
            at = after[at] if at in after else _raw_end(source, name, at) if name in RAW else at
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        flush()
        if name in UNSEEN or name in VOID or name in RAW or name in LEFT_OUT:
            continue
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].partition(".")[0] == name:
                    close(k)
                    break
            continue
        ends = CLOSES.get(name, set()) | {"p"}
        if stack and stack[-1].partition(".")[0] in ends:
            close(len(stack) - 1)
        words = _words(m[3])
        stack.append(f"{name}.{words}" if words else name)
        page.symbols.append(stack[-1])
    if at < len(source):
        piece = source[at:]
        text.append(html.unescape(piece) if "&" in piece else piece)
        linked += len(piece) if links else 0
    flush()
    return page


# A stream is a tuple of symbols and groups; a group is ("+", stream) or ("?", stream).


def fold(symbols: list) -> tuple[tuple, list[int]]:
    """Folds tandem repeats; also the number of the folded text slot of each symbol (-1: no slot)."""
    items: list[tuple[object, list[int]]] = [(s, [k]) for k, s in enumerate(symbols)]
    changed = True
    while changed:
        changed = False
        for width in range(1, LONGEST_REPEAT + 1):
            out: list[tuple[object, list]] = []
            i = 0
            while i < len(items):
                body = [x for x, _ in items[i:i + width]]
                end = i + width
                while len(body) == width and [x for x, _ in items[end:end + width]] == body:
                    end += width
                if len(body) == width and end > i + width:
                    reps = [items[k:k + width] for k in range(i, end, width)]
                    out.append((("+", tuple(body)), reps))
                    i, changed = end, True
                elif out and len(body) == width and out[-1][0] == ("+", tuple(body)):
                    out[-1][1].append(items[i:i + width])
                    i, changed = i + width, True
                else:
                    out.append(items[i])
                    i += 1
            items = out
    slot_of = [-1] * len(symbols)
    count = 0

    def number(x: object, places: list, base: int) -> int:
        """Numbers the slots below one item; the same for every repetition."""
        if isinstance(x, tuple):
            top = base
            for rep in places:
                top = base
                for y, p in rep:
                    top = number(y, p, top)
            return top
        if x == "#":
            for p in places:
                slot_of[p] = base
            return base + 1
        return base

    for x, places in items:
        count = number(x, places, count)
    return tuple(x for x, _ in items), slot_of


def slots(stream: tuple, path: tuple = ()) -> Iterator[tuple]:
    """The element path of each slot of a stream, in order."""
    stack = list(path)
    for x in stream:
        if isinstance(x, tuple):
            yield from slots(x[1], tuple(stack))
        elif x == "#":
            yield tuple(stack)
        elif x[0] == "/":
            if x[1:] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(x[1:]):]
        else:
            stack.append(x)


@dataclass
class Node:
    """A wrapper's element: a symbol, a slot with its number, or a group."""

    symbol: str = ""
    slot: int = -1
    group: str = ""  # "+" or "?"
    body: list[Node] = field(default_factory=list)

    def key(self) -> object:
        if self.group:
            return (self.group, tuple(n.key() for n in self.body))
        return "#" if self.slot >= 0 else self.symbol


class Wrapper:
    """A union-free regular expression that grows by alignment; ``add`` gives the wrapper's slot of each slot of a stream."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.paths: list[tuple] = []

    def add(self, stream: tuple) -> list[int]:
        paths = iter(list(slots(stream)))
        found: list[int] = []
        new = self._nodes(stream, paths)
        self.nodes = self._align(self.nodes, new) if self.nodes else new
        _collect(new, found)
        return found

    def _nodes(self, stream: tuple, paths: Iterator[tuple]) -> list[Node]:
        out = []
        for x in stream:
            if isinstance(x, tuple):
                out.append(Node(group=x[0], body=self._nodes(x[1], paths)))
            elif x == "#":
                out.append(Node(slot=len(self.paths)))
                self.paths.append(next(paths))
            else:
                out.append(Node(symbol=x))
        return out

    def _align(self, old: list[Node], new: list[Node]) -> list[Node]:
        """Merges two lists of nodes; equal slots of ``new`` take the numbers of ``old``."""
        old, new = _repeat_like(old, new), _repeat_like(new, old)
        flat_old, flat_new = _unwrapped(old), _unwrapped(new)
        a, b = [n.key() for n, _ in flat_old], [n.key() for n, _ in flat_new]
        out: list[Node] = []
        for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind == "equal":
                for (x, optional), (y, _) in zip(flat_old[i:j], flat_new[k:m], strict=True):
                    _same_slots(x, y)
                    out.append(Node(group="?", body=[x]) if optional else x)
            else:
                out += _optional([n for n, _ in flat_old[i:j]]) + _optional([n for n, _ in flat_new[k:m]])
        return out


def _collect(nodes: list[Node], out: list[int]) -> None:
    for n in nodes:
        if n.group:
            _collect(n.body, out)
        elif n.slot >= 0:
            out.append(n.slot)


def _optional(nodes: list[Node]) -> list[Node]:
    return [Node(group="?", body=[n]) for n in nodes]


def _unwrapped(nodes: list[Node]) -> list[tuple[Node, bool]]:
    """Nodes with optional groups opened, and whether each was optional."""
    out = []
    for n in nodes:
        out += [(x, True) for x, _ in _unwrapped(n.body)] if n.group == "?" else [(n, False)]
    return out


def _repeat_like(nodes: list[Node], other: list[Node]) -> list[Node]:
    """Where ``other`` repeats what ``nodes`` has once, that becomes a repeated group here as well."""
    keys = [n.key() for n in nodes]
    for g in other:
        if g.group == "+":
            body, n = list(g.key()[1]), len(g.body)
            i = 0
            while i + n <= len(keys):
                if keys[i:i + n] == body:
                    nodes = [*nodes[:i], Node(group="+", body=nodes[i:i + n]), *nodes[i + n:]]
                    keys[i:i + n] = [nodes[i].key()]
                i += 1
    return nodes


def _same_slots(x: Node, y: Node) -> None:
    if x.group:
        for p, q in zip(x.body, y.body, strict=True):
            _same_slots(p, q)
    elif x.slot >= 0:
        y.slot = x.slot


def is_chrome(path: tuple) -> bool:
    """Whether a slot's path leads through something that isn't the article; a header of the article itself is part of it."""
    inside = False
    for step in path:
        name, *words = step.split(".")
        if (name in CHROME_TAGS and not (name == "header" and inside)) or any(w in CHROME_WORDS for w in words):
            return True
        inside = inside or name in ARTICLE
    return False


def in_list(path: tuple) -> bool:
    """Whether links in a slot may be a link list: not those of paragraphs, headings and the like, unless a list item holds them."""
    names = [step.partition(".")[0] for step in path]
    return not names or names[-1] not in PROSE or "li" in names


def main_slots(paths: list[tuple], chars: dict[int, int], linked: dict[int, int]) -> set[int]:
    """The slots of main text among slots with these paths, characters and characters in links."""
    content = [k for k, p in enumerate(paths) if not is_chrome(p)]
    inside = [k for k in content if any(s.partition(".")[0] in ARTICLE or "main" in s.split(".")[1:] for s in paths[k])]
    if inside:
        return set(inside)
    return {k for k in content if not (in_list(paths[k]) and 2 * linked.get(k, 0) >= max(1, chars.get(k, 0)))}


def infer(layouts: list[tuple[tuple, int, list[int], list[int]]]) -> list[list[int]]:
    """For each layout (stream, pages, characters and linked characters of its slots) of one host: its main slots."""
    wrapper = Wrapper()
    found = []
    chars, linked = defaultdict(int), defaultdict(int)
    for stream, _, c, l in layouts:
        mine = wrapper.add(stream)
        found.append(mine)
        for k, a, b in zip(mine, c, l, strict=True):
            chars[k] += a
            linked[k] += b
    main = main_slots(wrapper.paths, chars, linked)
    out = []
    for (stream, _, c, l), mine in zip(layouts, found, strict=True):
        own = [i for i, k in enumerate(mine) if k in main]
        if not own:  # a layout of its own on this host: judged alone
            own = sorted(main_slots(list(slots(stream)), dict(enumerate(c)), dict(enumerate(l))))
        out.append(own)
    return out


def _plain(stream: tuple) -> list:
    return [[x[0], _plain(x[1])] if isinstance(x, tuple) else x for x in stream]


def _tuples(stream: list) -> tuple:
    return tuple((x[0], _tuples(x[1])) if isinstance(x, list) else x for x in stream)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``)."""
    host, _ = host_and_path(F.col("_url"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"))
    rows = rows.select("page_id", "url", host.alias("host"), "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, blocks = [], []
            for source in batch.column("html"):
                page = parse(source.as_py() or "")
                stream, slot_of = fold(page.symbols)
                streams.append(json.dumps(_plain(stream), ensure_ascii=False, separators=(",", ":")))
                blocks.append([{"slot": slot_of[k], "text": text, "linked": linked} for k, text, linked in page.blocks])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(streams, pa.string()),
                 pa.array(blocks, pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("linked", pa.int32())])))],
                names=["page_id", "url", "host", "stream", "blocks"])

    kinds = dict(rows.dtypes)
    parsed = rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, stream string, "
                                   "blocks array<struct<slot:int,text:string,linked:int>>")
    parsed = reuse(parsed, "parsed-pages").withColumn("layout", F.xxhash64("host", "stream"))

    # distinct layouts with the text each of their slots holds over all pages
    sizes = (parsed.select("host", "layout", F.explode("blocks").alias("b"))
             .groupBy("host", "layout", F.col("b.slot").alias("slot")).agg(F.sum(F.length("b.text")).alias("chars"), F.sum("b.linked").alias("linked")))
    sizes = sizes.groupBy("host", "layout").agg(F.collect_list(F.struct("slot", "chars", "linked")).alias("sizes"))
    layouts = parsed.groupBy("host", "layout").agg(F.min("stream").alias("stream"), F.count(F.lit(1)).alias("pages")).join(
        sizes, ["host", "layout"], "left")

    def judge(key: tuple, table_: pa.Table) -> pa.Table:
        got = sorted(table_.to_pylist(), key=lambda r: (-r["pages"], r["stream"]))
        todo = []
        for r in got:
            stream = _tuples(json.loads(r["stream"]))
            n = sum(1 for _ in slots(stream))
            c, l = [0] * n, [0] * n
            for s in r["sizes"] or []:
                c[s["slot"]], l[s["slot"]] = s["chars"], s["linked"]
            todo.append((stream, r["pages"], c, l))
        return pa.table({"layout": pa.array([r["layout"] for r in got], pa.int64()), "main": pa.array(infer(todo), pa.list_(pa.int32()))})

    # written, so that the join below is planned by its size: where it is small, the blocks aren't shuffled
    judged = reuse(layouts.groupBy("host").applyInArrow(judge, "layout long, main array<int>"), "judged-layouts")
    text = F.expr("array_join(transform(filter(blocks, b -> array_contains(main, b.slot)), b -> b.text), ' ')")
    return parsed.join(judged, "layout", "left").select(
        "page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html": op6_html}
ORACLES: dict[str, str] = {}
