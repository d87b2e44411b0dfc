"""HTML extraction by rendering: all visible text, laid out as a page would be.

A tokenizer and tree builder with implied end tags makes a tree of any markup;
visibility rules drop what a browser would not show; the rest is laid out:
blocks on lines of their own, blank lines around paragraphs, headings, lists
and tables, list items behind bullets or numbers, table cells laid out like pages
and aligned in columns, white space collapsed except in preformatted text.

Nothing recurses, so nesting may be as deep as a page makes it.  What layout adds
is bounded: lines are indented by ``INDENT`` columns at most, and a table whose
aligned form would have more than ``PADDING`` times its visible characters, and
``PADDING_FREE`` more, has its cells one under another instead.  So the text has
at most about ``INDENT + PADDING`` times the characters of the page, and no word
is lost.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ddl, in_batches

#: Element names by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist param source track meta link base area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset menu dir".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup hr html legend li main nav optgroup option search section summary tbody tfoot thead tr".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody thead tfoot tr option optgroup legend".split())
#: A start tag ends open elements of these names, unless one of the limits is nearer.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset({"table"})),
    "td": (frozenset("td th caption colgroup".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption colgroup".split()), frozenset("table tr".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split())),
    "body": (frozenset({"head"}), frozenset()),
}
_FENCE = frozenset("table td th caption button html".split())
_CROSSES = frozenset("table tr tbody thead tfoot body html".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/][^\s=>/]*)\s*(=)?\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)

#: Tables deeper in tables than this have cells of one line.
NESTED = 32
#: A table may have so many characters aligned for each visible one, and so many more.
PADDING, PADDING_FREE = 8, 1024
#: Deeper indentation is not shown.
INDENT = 64


@cache
def _end_of(name: str) -> re.Pattern[str]:
    """The end tag of an element of raw text, in any case of A-Z."""
    return re.compile("</" + name, re.I | re.A)


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children = name, attributes, []


def _attributes(text: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and where the tag ends, after its ``>``."""
    out: dict[str, str] = {}
    n = len(text)
    while at < n:
        m = _ATTRIBUTE.match(text, at)
        if not m:
            end = text.find(">", at)
            return out, n if end < 0 else end + 1
        at = m.end()
        value = ""
        if m[2]:
            quote = text[at : at + 1]
            if quote in ("'", '"') and at < last[quote]:
                end = text.index(quote, at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                v = _UNQUOTED.match(text, at)
                value, at = v[0], v.end()
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out, n


def parse(text: str) -> Node:
    """The tree of a page; any text gives one."""
    root = Node("#root", {})
    stack = [root]
    places: dict[str, list[int]] = {}
    last = {q: text.rfind(q) for q in "'\""}
    at, n = 0, len(text)

    def add(data: str) -> None:
        if data:
            stack[-1].children.append(html.unescape(data) if "&" in data else data)

    def nearest(names: frozenset[str]) -> int:
        """Place in the stack of the innermost open element of these names; 0: none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def cut(k: int) -> None:
        for x in stack[k:]:
            places[x.name].pop()
        del stack[k:]

    def close(names: frozenset[str], limits: frozenset[str]) -> None:
        while (k := nearest(names)) and k > nearest(limits):
            cut(k)

    while at < n:
        start = text.find("<", at)
        if start < 0:
            add(text[at:])
            break
        following = text[start + 1 : start + 2]
        if following == "!" or following == "?":
            add(text[at:start])
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                at = n if end < 0 else end + 3
            else:
                end = text.find(">", start)
                at = n if end < 0 else end + 1
            continue
        ending = following == "/"
        m = _NAME.match(text, start + 1 + ending)
        if not m:
            add(text[at : start + 1])
            at = start + 1
            continue
        add(text[at:start])
        name = m[0].lower()
        if ending:
            end = text.find(">", m.end())
            at = n if end < 0 else end + 1
            if name == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            k = places[name][-1] if places.get(name) else 0
            if name == "p" and (not k or k < nearest(_FENCE)):  # it closes an empty one
                stack[-1].children.append(Node("p", {}))
                continue
            if k and (k >= nearest(_FENCE) or name in _CROSSES):
                cut(k)
            continue
        attributes, at = _attributes(text, m.end(), last)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in CLOSES_P:
            close(frozenset({"p"}), _FENCE)
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name in VOID or text[at - 2 : at] == "/>" and name not in BLOCK:
            continue
        if name in RAW or name in ESCAPABLE:
            found = _end_of(name).search(text, at)
            end = found.start() if found else -1
            data = text[at : n if end < 0 else end]
            if name in ESCAPABLE:
                data = html.unescape(data)
            node.children.append(data)
            close_at = -1 if end < 0 else text.find(">", end)
            at = n if close_at < 0 else close_at + 1
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(node)
    return root


def visible(node: Node, parent: Node | None) -> bool:
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a or node.name == "input" or node.name == "dialog" and "open" not in a:
        return False
    if "style" in a and _STYLE.search(a["style"]):
        return False
    return not (parent is not None and parent.name == "details" and "open" not in parent.attributes and node.name != "summary")


class _Lines:
    """Lines being laid out, with collapsed spaces and pending blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False
        self.prefix, self.mark = "", ""

    def text(self, data: str) -> None:
        words = _SPACE.sub(" ", data)
        if words[:1] == " ":
            self.space = True
        body = words.strip(" ")
        if body:
            if self.now and self.space:
                self.now.append(" ")
            self.now.append(body)
            self.space = words[-1:] == " "

    def flush(self) -> None:
        if self.now:
            self.put("".join(self.now))
            self.now = []
        self.space = False

    def put(self, line: str, kept: bool = False) -> None:
        """Add a line; empty ones after an empty one only where ``kept``."""
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        lead = self.prefix[:INDENT]
        if self.mark:
            lead, self.mark = self.prefix[: len(self.prefix) - len(self.mark)][:INDENT] + self.mark, ""
        line = (lead + line).rstrip()
        if line or kept or self.lines and self.lines[-1]:
            self.lines.append(line)

    def text_lines(self) -> list[str]:
        """All lines but empty ones at the ends."""
        first, last = 0, len(self.lines)
        while first < last and not self.lines[first]:
            first += 1
        while first < last and not self.lines[last - 1]:
            last -= 1
        return self.lines[first:last]


def _span(text: str) -> int:
    text = text.strip()
    return min(int(text), 1000) if text.isascii() and text.isdigit() and len(text) < 6 else 1


def _cells(table: Node) -> tuple[list[Node], list[list[tuple[Node, int, int]]]]:
    """Captions, and rows of cells with the columns and rows they span; 0 rows: all that follow."""
    captions, rows, todo = [], [], [(c, table) for c in reversed(table.children)]
    while todo:
        node, parent = todo.pop()
        if isinstance(node, str):
            if node.strip():
                loose = Node("caption", {})
                loose.children.append(node)
                captions.append(loose)
            continue
        if not visible(node, parent):
            continue
        if node.name == "tr":
            rows.append([])
            todo += [(c, node) for c in reversed(node.children)]
        elif node.name in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append((node, max(_span(node.attributes.get("colspan", "1")), 1), _span(node.attributes.get("rowspan", "1"))))
        elif node.name in ("thead", "tbody", "tfoot", "form", "colgroup"):
            todo += [(c, node) for c in reversed(node.children)]
        else:
            captions.append(node)
    return captions, rows


def _flat(node: Node) -> str:
    """A cell's visible text on one line."""
    parts: list[str] = []
    todo: list = [(c, node) for c in reversed(node.children)]
    while todo:
        x, parent = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif visible(x, parent):
            apart = x.name in BLOCK or x.name in ("br", "td", "th")
            if apart:
                parts.append(" ")
                todo.append((" ", x))
            todo += [(c, x) for c in reversed(x.children)]
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells of one column begin at one place, two spaces after the widest; those of one row on one line."""
    above: list[tuple[int, int, int]] = []  # columns from, to, and the row from which on they are free, in order
    cells = []
    for r, row in enumerate(rows):
        if not row:
            continue
        above = [x for x in above if x[2] > r]
        column, k, below = 0, 0, []
        for lines, across, down in row:
            while k < len(above) and above[k][0] <= column:
                column = max(column, above[k][1])
                k += 1
            if k < len(above):
                across = min(across, above[k][0] - column)
            down = min(down or len(rows), len(rows) - r, 1000)
            cells.append((r, column, across, down, lines))
            if down > 1:
                if below and below[-1][1:] == (column, r + down):
                    below[-1] = (below[-1][0], column + across, r + down)
                else:
                    below.append((column, column + across, r + down))
            column += across
        if below:
            above = sorted(above + below)
    # only columns where a cell ends have a width of their own
    ends = sorted({column + across - 1 for _, column, across, _, _ in cells})
    width, height = [0] * len(ends), [0] * len(rows)
    for r, column, across, down, lines in cells:
        if across == 1:
            k = bisect_left(ends, column)
            width[k] = max(width[k], *map(len, lines), 0)
        if down == 1:
            height[r] = max(height[r], len(lines))
    for _, column, across, _, lines in sorted(cells, key=lambda c: c[2]):
        if across > 1:
            k = bisect_left(ends, column + across - 1)
            lack = max(map(len, lines), default=0) - sum(width[bisect_left(ends, column) : k + 1]) - 2 * (across - 1)
            if lack > 0:
                width[k] += lack
    for r, _, _, down, lines in sorted(cells, key=lambda c: c[3]):
        if down > 1:
            height[r + down - 1] += max(0, len(lines) - sum(height[r : r + down]))
    before = [0, *accumulate(width)]
    top = [0, *accumulate(height)]
    out: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
    for r, column, _, _, lines in cells:
        begin = before[bisect_left(ends, column)] + 2 * column
        for k, line in enumerate(lines, top[r]):
            if line:
                out[k].append((begin, line))
    seen = sum(len(line) - line.count(" ") for *_, lines in cells for line in lines)
    if sum(max(begin + len(line) for begin, line in x) for x in out if x) > PADDING * seen + PADDING_FREE:
        return [line for *_, lines in cells for line in lines]
    found = []
    for x in out:
        line, end = [], 0
        for begin, part in sorted(x):
            line += [" " * (begin - end), part]
            end = begin + len(part)
        found.append("".join(line))
    return found


def render(root: Node) -> str:
    out = _Lines()
    todo: list[tuple[str, object, Node | None]] = [("node", root, None)]
    lists: list[list[int]] = []
    outer: list[tuple[_Lines, list[list[int]]]] = []
    pre = 0

    def enter() -> None:
        nonlocal out, lists
        outer.append((out, lists))
        out, lists = _Lines(), []

    while todo:
        step, x, parent = todo.pop()
        if step == "call":
            x()
            continue
        if isinstance(x, str):
            if parent.name == "details" and "open" not in parent.attributes:
                continue
            if pre:
                first, *rest = x.replace("\r\n", "\n").split("\n")
                out.now.append(first)
                for line in rest:
                    out.put("".join(out.now), True)
                    out.now = [line]
            else:
                out.text(x)
            continue
        if not visible(x, parent):
            continue
        name = x.name
        if name == "br":
            if out.now:
                out.flush()
            else:
                out.put("")
            continue
        if name == "hr":
            out.flush()
            out.put("---")
            continue
        if name == "table":
            out.flush()
            out.blank = True
            captions, rows = _cells(x)

            laid: list[list[tuple[list[str], int, int]]] = [[] for _ in rows]

            def lay(laid=laid) -> None:
                out.flush()
                for line in _table(laid):
                    out.put(line, True)
                out.blank = True

            todo.append(("call", lay, None))
            for row, into in zip(reversed(rows), reversed(laid), strict=True):
                if len(outer) >= NESTED:
                    into += [([t] if (t := _flat(cell)) else [], across, down) for cell, across, down in row]
                    continue
                for cell, across, down in reversed(row):
                    def leave_cell(into=into, across=across, down=down) -> None:
                        nonlocal out, lists
                        out.flush()
                        into.append((out.text_lines(), across, down))
                        out, lists = outer.pop()

                    todo.append(("call", leave_cell, None))
                    todo += [("node", c, cell) for c in reversed(cell.children)]
                    todo.append(("call", enter, None))
            todo += [("node", c, x) for c in reversed(captions)]
            continue
        after: list = []
        if name in BLOCK:
            out.flush()
            spaced = name in SPACED and not (name in ("ul", "ol") and lists)
            out.blank = out.blank or spaced

            def leave(spaced=spaced) -> None:
                out.flush()
                out.blank = out.blank or spaced

            after.append(leave)
        if name in ("ul", "ol", "menu", "dir"):
            start = x.attributes.get("start", "1").strip()
            lists.append([int(start) if start.lstrip("-").isdigit() and start.isascii() and len(start) < 10 else 1, name == "ol"])
            after.append(lists.pop)
        elif name in ("li", "dd", "blockquote"):
            lead = "  "
            if name == "li":
                lead = "- "
                if lists and lists[-1][1]:
                    lead = f"{lists[-1][0]}. "
                    lists[-1][0] += 1
            before = out.prefix
            out.prefix = before + " " * len(lead)
            out.mark = lead if name == "li" else ""

            def back(before=before) -> None:
                out.prefix, out.mark = before, ""

            after.append(back)
        elif name == "pre":
            pre += 1

            def end() -> None:
                nonlocal pre
                pre -= 1

            after.append(end)
        elif name in ("td", "th"):
            out.space = True
        todo += [("call", f, None) for f in reversed(after)]
        todo += [("node", c, x) for c in reversed(x.children)]
    out.flush()
    return "\n".join(out.text_lines())


def extract(page: str | None) -> str:
    """A page's visible text; of null or empty markup, the empty text."""
    return render(parse(page)) if page else ""


EXTRACTED = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Rows (page_id, text), one a page.

    Null markup gives an empty text.  Rows with equal or null ids are answered
    each; other columns are ignored; an empty table stays empty.
    """

    def run(ids: pa.Array, pages_: pa.Array) -> list:
        return [ids, [extract(p) for p in pages_.to_pylist()]]

    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{html_column}`").cast("string").alias("html"))
    return rows.mapInArrow(in_batches(["page_id", "html"], EXTRACTED, run), ddl(EXTRACTED))
