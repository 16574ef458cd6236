"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, utf8

# ---------------------------------------------------------------- fixed values of HTML

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg select".split())  # their content is no running text
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
            "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
SCOPE = set("html body article aside blockquote div dl fieldset figure footer form header main nav ol section table td th ul".split())
# parts of a page that are not its article: elements, roles, and words in class or id names
ASIDE = set("nav header footer aside form button label input dialog menu".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = set("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden "
            "masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted related share sharing sidebar social "
            "sponsor sponsored subscribe toolbar widget".split())

# words before a name that say it is about the absence of the part, a page that has it, or the article's own
NOT_BEFORE = set("has have with without no not never hide is article post entry story".split())
# words after a name that say where or in what form the part stands
AFTER = set("area bar block body bottom box button buttons col column container content group inner item items left link links list main outer panel primary "
            "right row secondary section slot text top unit widget wrap wrapper".split())
KEEP = set("html body main article".split())  # never switched off by a name

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_DEEP = 200  # levels of elements that a tree keeps


# ---------------------------------------------------------------- pages as trees

class Node:
    __slots__ = ("tag", "label", "off", "kids")

    def __init__(self, tag: str, label: str, off: int):
        self.tag, self.label, self.off, self.kids = tag, label, off, []


def _named_off(name: str) -> bool:
    """Whether a class or id name is that of a part beside the article: "sidebar", "left-sidebar", "sidebar_2", "share-box",
    but not "has-sidebar", "no-ads", "article-header" or "social-science"."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    while len(parts) > 1 and parts[-1] in AFTER:
        parts.pop()
    return bool(parts) and parts[-1] in NAMES and not any(p in NOT_BEFORE for p in parts[:-1])


def _element(tag: str, attrs: str) -> Node:
    """``off`` is 2 for parts that are off by element or role, 1 for those by name only."""
    marks, off = [], 2 if tag in ASIDE else 0
    if attrs and "=" in attrs:
        for name, *values in _ATTR.findall(attrs):
            words = "".join(values).lower().split()
            if name.lower() == "role":
                off = 2 if any(w in ROLES for w in words) else off
                continue
            if not off and tag not in KEEP and any(map(_named_off, words)):
                off = 1
            if name.lower() == "class":
                marks = sorted(re.sub(r"\d+", "#", w) for w in words)
    return Node(tag, ".".join([tag, *marks]), off)


class _Open:
    """Open elements of a page that is read, and where their content goes.

    Elements below ``_DEEP`` levels do not nest further: block elements become children of the last level kept, one after another in
    page order and off where an element around them is; other elements give their text to the element around them.
    """

    def __init__(self):
        self.root = Node("", "", 0)
        self.stack, self.into = [self.root], [self.root]

    def text(self, s: str) -> None:
        if not s:
            return
        to = self.into[-1]
        if s.isspace():
            if to.kids:
                to.kids.append(" ")
            return
        if len(self.stack) > _DEEP:
            floor = self.stack[_DEEP - 1]
            if to.tag in BLOCK and to is not floor and floor.kids[-1] is not to:  # its text goes on after another element
                more = Node(to.tag, to.label, to.off)
                floor.kids.append(more)
                for k in range(len(self.into) - 1, -1, -1):
                    if self.into[k] is not to:
                        break
                    self.into[k] = more
                to = more
        to.kids.append(entities.unescape(s))

    def add(self, node: Node, opens: bool) -> None:
        around = self.into[-1]
        to = node
        if len(self.stack) < _DEEP:
            around.kids.append(node)
        elif around.off and around is not self.stack[_DEEP - 1] or not (node.off or node.tag in BLOCK):
            to = around
            if node.tag == "br":
                around.kids.append(node)
        elif node.tag in BLOCK:
            floor = self.stack[_DEEP - 1]
            node.off = max(node.off, around.off)
            floor.kids.append(node)
        else:
            around.kids.append(node)
        if opens:
            self.stack.append(node)
            self.into.append(to)

    def cut(self, k: int) -> None:
        del self.stack[k:], self.into[k:]

    def close(self, tags: set[str]) -> None:
        """Close the nearest open element of the given kinds, unless a container stands between."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return self.cut(k)
            if self.stack[k].tag in SCOPE:
                return None
        return None


def parse(html: str) -> Node:
    """The page as a tree of elements and texts (strings, character references decoded). Any input gives a tree of bounded depth."""
    page, at, low = _Open(), 0, None
    have: set[str] = set()  # of body, head, html
    while True:
        m = _TOKEN.search(html, at)
        if not m:
            page.text(html[at:])
            return page.root
        page.text(html[at: m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(page.stack) - 1, 0, -1):
                if page.stack[k].tag == tag:
                    page.cut(k)
                    have.discard(tag)
                    break
                if page.stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in CLOSES_P:
            page.close({"p"})
        if tag in CLOSES:
            page.close(CLOSES[tag])
        if tag in ("body", "head", "html"):
            if tag in have and any(n.tag == tag for n in page.stack):
                continue
            have.add(tag)
        if tag == "body":
            page.close({"head"})
        node = _element(tag, m[3])
        raw = tag in RAW and not m[3].endswith("/")
        page.add(node, raw or (tag not in VOID and not m[3].endswith("/")))
        if raw:
            if low is None:
                low = html.lower() if len(html.lower()) == len(html) else html
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else end


def blocks(node: Node) -> list[str]:
    """Text blocks of a subtree in page order, without the parts that are not article."""
    out, run = [], []

    def close():
        if run:
            s = _SPACE.sub(" ", "".join(run)).strip()
            if s:
                out.append(s)
            run.clear()

    todo = [(node, False)]
    while todo:
        n, leave = todo.pop()
        if leave:
            close()
        elif isinstance(n, str):
            run.append(n)
        elif not n.off:
            if n.tag in BLOCK:
                close()
                todo.append((n, True))
            todo.extend((k, False) for k in reversed(n.kids))
        elif n.tag in BLOCK or n.tag in ASIDE:
            close()
    close()
    return out


# ---------------------------------------------------------------- wrappers
# A wrapper is [label, often, text, chars, kids]. often: 1 once, 2 optional (?), 3 repeated (+), 4 both (*).
# Text nodes have the label "#": text is the crc of a text equal on all pages so far, None for a slot.
# "()" is a repeated group without an element of its own. A label ends with "!" if the element is off by its name, with "!!"
# if it is off anyway.

def wrapper(node: Node) -> list:
    """The wrapper of one page, or of one element of it."""
    kids = []
    for k in node.kids:
        if isinstance(k, str):
            s = k.strip()
            if s:
                kids.append(["#", 1, zlib.crc32(s.encode("utf-8", "surrogatepass")), len(s), []])
        else:
            kids.append(wrapper(k))
    return [node.label + "!" * node.off, 1, None, 0, _fold(kids)]


def _fold(kids: list) -> list:
    """Resolve repetitions among siblings: equal neighbours become one repeated item, recurring sequences a group."""
    out: list = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = _merge(out[-1], k, repeated=True)
        else:
            out.append(k)
    labels = [k[0] for k in out]
    again = next((x for x in labels if labels.count(x) > 1), None)
    if again is None:
        return out
    cuts = [i for i, x in enumerate(labels) if x == again]
    inside = set(labels[cuts[0]: cuts[-1]])
    stop = cuts[-1] + 1
    while stop < len(out) and labels[stop] in inside:
        stop += 1
    body: list | None = None
    for a, b in zip(cuts, [*cuts[1:], stop], strict=True):
        part = _fold(out[a: b])
        body = part if body is None else _align(body, part)
    return _fold(out[: cuts[0]] + [["()", 3, None, 0, body]] + out[stop:])


def _merge(a: list, b: list, repeated: bool = False) -> list:
    often = (1 if not repeated else 3) if a[1] == b[1] == 1 else {(o, r): 1 + o + 2 * r for o in (0, 1) for r in (0, 1)}[
        (int(a[1] in (2, 4) or b[1] in (2, 4)), int(repeated or a[1] > 2 or b[1] > 2))]
    if a[0] == "#":
        return ["#", often, a[2] if a[2] == b[2] else None, a[3] + b[3], []]
    return [a[0], often, None, a[3] + b[3], _align(a[4], b[4])]


def _grouped(a: list, b: list) -> list:
    """``a`` with the run of items that a repeated group of ``b`` would match once put in such a group."""
    group = next((x for x in b if x[0] == "()"), None)
    labels = [x[0] for x in a]
    if group is None or "()" in labels or group[4][0][0] not in labels:
        return a
    inside = {x[0] for x in group[4]}
    start = labels.index(group[4][0][0])
    stop = start
    while stop < len(a) and labels[stop] in inside:
        stop += 1
    return [*a[:start], ["()", 1, None, 0, a[start: stop]], *a[stop:]]


def _align(a: list, b: list) -> list:
    """Align two item lists: common items merge (unequal texts become slots), the others become optional."""
    a, b = _grouped(a, b), _grouped(b, a)
    la, lb = [x[0] for x in a], [x[0] for x in b]
    if la == lb:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(la), len(lb)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] == lb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def some(x):
        return [x[0], {1: 2, 3: 4}.get(x[1], x[1]), *x[2:]]

    while i < n or j < m:
        if i < n and j < m and la[i] == lb[j]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(some(a[i]))
            i += 1
        else:
            out.append(some(b[j]))
            j += 1
    return _fold(out)


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression; #PCDATA is a text slot."""
    mark = {1: "", 2: "?", 3: "+", 4: "*"}[w[1]]
    if w[0] == "#":
        return ("#PCDATA" if w[2] is None else "#text") + mark
    inner = " ".join(map(expression, w[4]))
    if w[0] == "()":
        return f"({inner}){mark}"
    one = f"<{w[0].rstrip('!')}> {inner} </>" if inner else f"<{w[0].rstrip('!')}/>"
    return f"({one}){mark}" if mark else one


def _volume(w: list, slots_only: bool) -> int:
    """Characters in the subtree's texts that can be article."""
    if w[0].endswith("!"):
        return 0
    if w[0] == "#":
        return w[3] if w[2] is None or not slots_only else 0
    return sum(_volume(k, slots_only) for k in w[4])


def content_paths(w: list) -> list[list[str]]:
    """Labels from the root to each element that holds article text.

    All article and main elements with slot text, outside each other: the inner ones if they hold all slot text of
    the outer, else the outer. Without any, the deepest element that holds all slot text that is not marked
    off, so that no sibling with such text is left behind. Where no text differs between pages, all text counts.
    """
    slots = _volume(w, True) > 0

    def find(x, path):
        """Volume and path of the marked elements of a subtree."""
        if x[0].endswith("!") or x[0] == "#":
            return []
        path = path if x[0] in ("()", "") else [*path, x[0]]
        inner = [m for k in x[4] for m in find(k, path)]
        own = _volume(x, slots) if x[0].split(".")[0] in ("article", "main") else 0
        return [(own, path)] if own > sum(v for v, _ in inner) else inner

    marked = [p for _, p in find(w, [])]
    if marked:
        return [p for k, p in enumerate(marked) if p not in marked[:k]]
    path, at = [], w
    while True:
        kids = [k for k in at[4] if _volume(k, slots)]
        if len(kids) != 1 or kids[0][0].split(".")[0] in ("#", "p", "span", "b", "i", "em", "strong", "a", "font", "li", "td", "tr"):
            return [path]
        at = kids[0]
        if at[0] != "()":
            path = [*path, at[0]]


def switched_on(w: list) -> list[list[str]]:
    """Marked labels from the root to elements that are off by name only and yet hold most of the slot text; ``w`` changes with them."""
    def volume(x, slots):
        if x[0].endswith("!!"):
            return 0
        return (x[3] if x[2] is None or not slots else 0) if x[0] == "#" else sum(volume(k, slots) for k in x[4])

    slots = volume(w, True) > 0
    total, out, todo = volume(w, slots), [], [(w, [])]
    while todo:
        x, path = todo.pop()
        if x[0] == "#" or volume(x, slots) * 2 <= total:
            continue
        path = path if x[0] in ("()", "") else [*path, x[0]]
        if x[0].endswith("!"):
            out.append(path)
            x[0] = x[0][:-1]
        todo.extend((k, path) for k in x[4])
    return out


def rule(w: list) -> dict:
    """What a host's wrapper says of its pages: elements to switch on, and the paths of its article."""
    return {"on": switched_on(w), "paths": content_paths(w)}


def _switch(root: Node, on: list[list[str]]) -> None:
    found = []
    for path in on:
        now = [root]
        for label in path:
            now = [k for n in now for k in n.kids if not isinstance(k, str) and k.label + "!" * k.off == label]
        found += now
    for n in found:
        n.off = 0


def content_path(w: list) -> list[str]:
    """The first of ``content_paths``."""
    return content_paths(w)[0]


def _holders(root: Node, paths: list[list[str]]) -> list[Node]:
    """Elements on any of the paths, outside each other, in page order."""
    out, todo = [], [(root, paths)]
    while todo:
        n, left = todo.pop()
        if [] in left:
            out.append(n)
            continue
        todo.extend((k, on) for k in reversed(n.kids) if not isinstance(k, str) and not k.off and (on := [p[1:] for p in left if p[0] == k.label]))
    return out


def main_text(html: str, of_host: dict | list | None) -> str:
    """The article of a page by its host's rule, or by one path; a page without such elements is its own wrapper."""
    root = parse(html)
    if isinstance(of_host, list):
        of_host = {"on": [], "paths": [of_host]}
    out = []
    if of_host and of_host["paths"] != [[]]:
        _switch(root, of_host["on"])
        out = [b for n in _holders(root, of_host["paths"]) for b in blocks(n)]
    if not out:
        own = rule(wrapper(root))
        _switch(root, own["on"])
        out = [b for n in _holders(root, own["paths"]) for b in blocks(n)]
    return "\n".join(out)


# ---------------------------------------------------------------- Spark

def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def shape(w: list) -> str:
    """A wrapper's labels and repetitions without its texts. Wrappers of one shape merge item by item, in any order, to the same wrapper."""
    return f"{w[0]} {w[1]}({','.join(map(shape, w[4]))})" if w[4] else f"{w[0]} {w[1]}"


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", run: int = 256, fan: int = 16) -> DataFrame:
    """host, wrapper (JSON): one wrapper per host from all of its pages.

    Pages of one shape are merged first, inside tasks and then across them in two steps, so a host with most of the pages is never in one
    task and pages do not move. The order in which different shapes are aligned matters, so it is fixed by the shapes alone: a
    host's shapes are dealt to runs of about ``run`` by a hash and aligned in its order; the runs' wrappers are joined ``fan`` at a time in
    the order of their numbers, then those of the joined ones. So the partitioning of the input makes no difference. A wrapper holds
    each kind of sibling once and does not grow with the number of pages.
    """
    scratch = Scratch(pages.sparkSession)
    kind = "host string, shape string, wrapper string"

    def fold(batches):
        held: dict = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), utf8(batch.column(1)).to_pylist(), strict=True):
                w = wrapper(parse(page))
                key = host, hashlib.md5(shape(w).encode("utf-8", "surrogatepass")).hexdigest()
                held[key] = _merge(held[key], w) if key in held else w
                if len(held) >= 2000:
                    yield _rows(held)
                    held = {}
        if held:
            yield _rows(held)

    def merge(t: pa.Table) -> pa.Table:
        done = None
        for x in sorted(t.column("wrapper").to_pylist()):
            w = json.loads(x)
            done = w if done is None else _merge(done, w)
        return pa.Table.from_batches([_rows({(t.column("host")[0].as_py(), t.column("shape")[0].as_py()): done})])

    parts = pages.select(_host(url_col).alias("host"), html_col).filter(F.col(html_col).isNotNull()).mapInArrow(fold, kind)
    some = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32))).groupBy("host", "shape", "salt").applyInArrow(merge, kind)
    shapes, _ = scratch.land(some.groupBy("host", "shape").applyInArrow(merge, kind))

    def join(t: pa.Table, up: int) -> pa.Table:
        """Wrappers in the order of (part, shape), as part number ``part // up``."""
        rows = sorted(zip(t.column("part").to_pylist(), t.column("shape").to_pylist(), t.column("wrapper").to_pylist(), strict=True))
        done = json.loads(rows[0][2])
        for _, _, x in rows[1:]:
            done = _merge(done, json.loads(x))
        out = pa.Table.from_batches([_rows({(t.column("host")[0].as_py(), ""): done})])
        return out.append_column("part", pa.array([rows[0][0] // up], pa.int64()))

    runs = shapes.groupBy("host").agg(F.ceil(F.count("*") / run).alias("runs"))
    most = runs.agg(F.max("runs")).first()[0] or 1
    out = shapes.join(runs, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.col("runs"))).select("host", "shape", "wrapper", "part")
    out = out.groupBy("host", "part").applyInArrow(lambda t: join(t, 1), kind + ", part long")
    while most > 1:
        out = out.withColumn("up", F.floor(F.col("part") / fan)).groupBy("host", "up").applyInArrow(lambda t: join(t, fan), kind + ", part long")
        most = -(-most // fan)
    return out.select("host", "wrapper")


def _rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in held], pa.string()), "shape": pa.array([s for _, s in held], pa.string()),
                                       "wrapper": pa.array([json.dumps(w) for w in held.values()], pa.string())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text: the article of every page, whole; blocks joined by one newline.

    Elements may nest to any depth (below ``_DEEP`` levels they are kept side by side). Null and empty pages, and pages without an article, have an empty text; a null or odd url belongs to the
    host "". Null ids pass through, repeated rows are extracted alike; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)

    def find(batches):
        for batch in batches:
            paths = [json.dumps(rule(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column(0), "path": pa.array(paths, pa.string())})

    rules, _ = scratch.land(infer(pages, url_col, html_col).mapInArrow(find, "host string, path string"))  # broadcast by the planner if small

    def work(batches):
        for batch in batches:
            paths: dict = {}
            out = []
            for page, path in zip(utf8(batch.column(2)).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if path not in paths:
                    paths[path] = json.loads(path) if path else None
                out.append(main_text(page, paths[path]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[id_col, url_col, "text"])

    wide = pages.select(id_col, url_col, html_col, _host(url_col).alias("host")).join(rules, "host", "left").select(id_col, url_col, html_col, "path")
    kind = pages.schema[id_col].dataType.simpleString()
    return wide.mapInArrow(work, f"`{id_col}` {kind}, `{url_col}` string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
