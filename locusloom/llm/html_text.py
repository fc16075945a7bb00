"""Layout-aware rendering of web pages to text.

A tokenizer reads tags, comments and raw-text elements; a tree builder adds what HTML leaves out (ends of paragraphs, list
items, rows and cells, missing rows, unclosed elements); visibility rules take out what a browser does not show; the
renderer walks the tree and writes every visible text with blank lines around paragraphs, headings and the like, bullets
and numbers of lists with their indents, kept white space in ``pre``, and table cells in aligned columns.

Walks use explicit stacks, so nesting may be of any depth, and time grows with the length of a page: open elements are
found by the places of their name, and a scan for the end of a tag that fails leaves a note for the next one. Columns wider
than ``ALIGNED`` characters are not padded, indents stop at ``ALIGNED``, and tables inside ``DEEP`` others are written as
blocks; no text is lost by that.

Defined results: a null page gives null, an empty one or one without visible text an empty text; a broken tag at the end
is text as far as it is none; repeated rows and null ids keep their own row; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import bounded_batches, release
from locusloom.llm.registry import query, table

ALIGNED = 80
DEEP = 16

# Element names of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript iframe noembed noframes title object canvas audio video svg datalist".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset xmp".split())
BLOCK = SPACED | set(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header html legend li main "
    "menu nav search section summary tr tbody thead tfoot td th optgroup option".split()
)
_TABLE = {"table"}
# a start tag ends these open elements, looking no further out than the second set
ENDS: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, _TABLE), "td": ({"td", "th"}, _TABLE | {"tr"}), "th": ({"td", "th"}, _TABLE | {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "caption": ({"caption", "colgroup"}, _TABLE), "body": ({"head"}, set()),
}
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "optgroup"}
_SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "template"}

_WALLS = BLOCK | _SCOPE

_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|[^<]++|<", re.S)
_TAG, _LONE = re.compile(r"</?(?=[a-zA-Z])"), re.compile("<")
_NAME_END, _QUOTE_OR_END = re.compile(r"[\s/>]"), re.compile("[\"'>]")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """Tree of a page, with the ends and elements that HTML implies."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # name -> its places among the open elements, outermost first
        self.walls: list[int] = []  # places of open blocks and scopes

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)

    def _cut(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        while len(self.open) > at:
            name = self.open.pop().name
            self.places[name].pop()
            if name in _WALLS:
                self.walls.pop()

    def _last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _end(self, names: set[str], scope: set[str]) -> None:
        """Close the outermost of ``names`` that is open inside ``scope``."""
        found = [p for n in names if (p := self.places.get(n))]
        if found:
            wall = self._last(scope)
            inside = [p[i] for p in found if (i := bisect_right(p, wall)) < len(p)]
            if inside:
                self._cut(min(inside))

    def _push(self, name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs)
        self.open[-1].children.append(node)
        if name not in VOID:
            self.places[name].append(len(self.open))
            if name in _WALLS:
                self.walls.append(len(self.open))
            self.open.append(node)

    def leave(self) -> None:
        """Close the innermost element."""
        self._cut(len(self.open) - 1)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "html":
            return
        if name in _ENDS_P:
            self._end({"p"}, _SCOPE)
        if name in ENDS:
            self._end(*ENDS[name])
        if name in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        if self.open[-1].name == "head" and name not in RAW | VOID | {"template", "noscript"}:
            self.leave()
        self._push(name, attrs)

    def end(self, name: str) -> None:
        if name == "br":
            self._push("br", {})
        elif name == "p" and not self.places.get("p"):
            self.start("p", {})
            self.leave()
        elif self.places.get(name):
            wall = self._last(_TABLE) if name in BLOCK else self.walls[-1] if self.walls else 0
            if self.places[name][-1] >= wall:
                self._cut(self.places[name][-1])


class Tags:
    """Ends of the tags of a page, asked for at rising places."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.name_end = self.first = -1
        self.dead: set[int] = set()  # quotes outside of values from which no end of a tag can be reached

    def _next(self, at: int) -> int:
        return m.start() if (m := _QUOTE_OR_END.search(self.page, at)) else -1

    def end(self, at: int) -> tuple[int, int] | None:
        """(end of the name, place of the closing ``>``) of the tag whose name starts at ``at``; None if it has no end."""
        if at > self.last[">"]:
            return None
        if self.name_end < at:
            self.name_end = _NAME_END.search(self.page, at).start()
        if self.first < self.name_end:
            self.first = self._next(self.name_end)
        spot, seen = self.first, []
        while spot >= 0 and spot not in self.dead:
            sign = self.page[spot]
            if sign == ">":
                return self.name_end, spot
            seen.append(spot)
            before = self.page[spot - 1]
            if spot < self.last[sign] and (before == "=" or before.isspace()):
                spot = self.page.index(sign, spot + 1)
            spot = self._next(spot + 1)
        self.dead.update(seen)
        return None


def parse(page: str) -> Node:
    builder, tags, at = Builder(), Tags(page), 0
    while at < len(page):
        tag = _TAG.match(page, at)
        ends = tags.end(tag.end()) if tag else None
        if ends is None:
            m = (_LONE if tag else _OTHER).match(page, at)
            at = m.end()
            if m[0][:2] not in ("<!", "<?", "</"):
                builder.text(unescape(m[0]) if "&" in m[0] else m[0])
            elif m[0].startswith("<![CDATA["):
                builder.text(m[0][9:].removesuffix("]]>"))
            continue
        name, attrs, at = page[tag.end() : ends[0]].lower(), page[ends[0] : ends[1]], ends[1] + 1
        if tag[0] == "</":
            builder.end(name)
            continue
        builder.start(name, _attributes(attrs) if attrs else {})
        if name in RAW:
            # up to the last ">" every begun end tag has its end, so none is scanned in vain
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at, tags.last[">"] + 1)
            inside = page[at : close.start() if close else len(page)]
            builder.text(unescape(inside) if name in ("textarea", "title") else inside)
            builder.leave()
            at = close.end() if close else len(page)
        elif name == "plaintext":
            builder.text(page[at:])
            break
    return builder.root


def hidden(node: Node) -> bool:
    if node.name in UNSEEN:
        return True
    attrs = node.attrs
    return bool(attrs) and ("hidden" in attrs or bool(_HIDING.search(attrs.get("style", ""))) or (node.name == "dialog" and "open" not in attrs))


class Writer:
    """Lines of one flow: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.indents, self.mark = False, 0, [0], ""

    def _begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.line.append(" " * max(0, self.indents[-1] - len(self.mark)) + self.mark)
            self.mark = ""
            self.space = False

    def text(self, text: str) -> None:
        words = _SPACE.split(text)
        lead, trail = words[0] == "", words[-1] == ""
        words = [w for w in words if w]
        if not words:
            self.space = self.space or bool(text)
            return
        spaced = (self.space or lead) and bool(self.line)
        self._begin()
        self.line.append((" " if spaced else "") + " ".join(words))
        self.space = trail

    def kept(self, text: str) -> None:
        """Text whose white space counts."""
        rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, row in enumerate(rows):
            if i:
                if self.line:
                    self.flush()
                elif self.lines:
                    self.lines.append("")
            if row:
                self._begin()
                self.line.append(row)

    def indent(self, width: int) -> None:
        self.indents.append(min(ALIGNED, self.indents[-1] + width))

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" \t"))
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def turn(self) -> None:
        """A forced line end."""
        if self.line:
            self.flush()
        elif self.lines:
            self.gap += 1

    def rows(self, rows: list[str]) -> None:
        self.flush()
        for row in rows:
            self._begin()
            self.line.append(row)
            self.flush()

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        return lines


def _number(text: str | None, default: int, most: int = 10**9) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(int(m[1]), most) if m else default


class Table:
    def __init__(self):
        self.grid: list[dict[int, list[str]]] = []
        self.held: dict[int, int] = {}  # column -> further rows that a cell above reaches into
        self.column = 0

    def row(self) -> None:
        self.grid.append({})
        self.column = 0
        self.taken = set(self.held)
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1}

    def cell(self, lines: list[str], attrs: dict[str, str]) -> None:
        while self.column in self.taken:
            self.column += 1
        self.grid[-1][self.column] = lines
        width, height = max(1, _number(attrs.get("colspan"), 1, 1000)), max(1, _number(attrs.get("rowspan"), 1, 65534))
        if height > 1:
            self.held.update({c: height - 1 for c in range(self.column, self.column + width)})
        self.column += width

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.grid:
            for c, lines in row.items():
                widths[c] = max(widths.get(c, 0), max(map(len, lines), default=0))
        columns, out = sorted(c for c, w in widths.items() if w), []
        for row in self.grid:
            for i in range(max((len(lines) for lines in row.values()), default=0)):
                parts = []
                for c in columns:
                    lines = row.get(c, [])
                    parts.append((lines[i] if i < len(lines) else "").ljust(min(widths[c], ALIGNED)))
                out.append("  ".join(parts).rstrip())
        return [x for x in out if x]


def render(page: str | None) -> str | None:
    """Visible text of a page."""
    if page is None:
        return None
    writers, tables, lists, pre = [Writer()], [], [], 0
    stack: list[tuple[Node, Iterator, str]] = [(root := parse(page), iter(root.children), "")]

    def enter(node: Node) -> None:
        nonlocal pre
        name, out = node.name, writers[-1]
        if hidden(node):
            return
        if name == "br":
            out.turn()
            return
        if name == "hr":
            out.block(1)
            return
        if name == "wbr" or name in VOID:
            return
        role = ""
        if name == "table":
            out.block(1)
            tables.append(Table() if len(tables) < DEEP else None)
            role = "table"
        elif name == "tr" and tables and tables[-1]:
            tables[-1].row()
            role = "row"
        elif name in ("td", "th") and tables and tables[-1] and tables[-1].grid:
            writers.append(Writer())
            role = "cell"
        elif name in ("tbody", "thead", "tfoot") and tables and tables[-1]:
            role = "rows"
        elif name == "caption" and tables and tables[-1]:
            writers.append(Writer())
            role = "caption"
        elif name in ("ul", "ol", "menu", "dir"):
            out.block(0 if lists else 1)
            step = -1 if "reversed" in node.attrs else 1
            lists.append([_number(node.attrs.get("start"), 1), step] if name == "ol" else None)
            role = "list"
        elif name == "li":
            out.block(0)
            mark = "- "
            if lists and lists[-1]:
                number = _number(node.attrs.get("value"), lists[-1][0])
                lists[-1][0] = number + lists[-1][1]
                mark = f"{number}. "
            out.indent(len(mark))
            out.mark = mark
            role = "item"
        elif name in ("dd", "blockquote"):
            out.block(int(name == "blockquote"))
            out.indent(2)
            role = "indent"
        elif name in ("pre", "xmp", "textarea", "plaintext"):
            out.block(int(name != "textarea"))
            pre += 1
            role = "pre"
        elif name in BLOCK:
            out.block(int(name in SPACED))
            role = "block"
        stack.append((node, iter(_shown(node)), role))

    def leave(node: Node, role: str) -> None:
        nonlocal pre
        out = writers[-1]
        if role == "table":
            done = tables.pop()
            out.rows(done.lines() if done else [])
            out.block(1)
        elif role == "cell":
            tables[-1].cell(writers.pop().done(), node.attrs)
        elif role == "caption":
            lines = writers.pop().done()
            writers[-1].rows(lines)
        elif role == "list":
            lists.pop()
            out.block(0 if lists else 1)
        elif role in ("item", "indent"):
            out.block(int(node.name == "blockquote"))
            out.indents.pop()
            out.mark = ""
        elif role == "pre":
            pre -= 1
            out.block(int(node.name != "textarea"))
        elif role == "block":
            out.block(int(node.name in SPACED))

    while stack:
        node, children, role = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            leave(node, role)
        elif isinstance(child, Node):
            enter(child)
        elif pre:
            writers[-1].kept(child)
        elif role not in ("table", "row", "rows", "list") or child.strip(" \t\n\f\r"):
            writers[-1].text(child)
    return "\n".join(writers[0].done())


def _shown(node: Node) -> list:
    """Children of an element: a closed ``details`` shows its summary only; the first line end in ``pre`` is none."""
    children = node.children
    if node.name == "details" and "open" not in node.attrs:
        return [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
    if node.name in ("pre", "textarea") and children and isinstance(children[0], str) and children[0][:1] == "\n":
        return [children[0][1:], *children[1:]]
    return children


def visible_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(x) for x in batch], dtype=object)
        release()

    return run(page)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) per page."""
    bounded_batches(pages.sparkSession)
    return pages.select(id_col, visible_text(F.col(html_col)).alias("text"))


@query("op10_html_text")
def _html_text(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return extract(table(spark, sf_dir, "pages", "page_id", "html")).select(
        "page_id", "text", F.length(text).cast("long").alias("n_chars"), F.size(F.split(text, "\n")).cast("long").alias("n_lines")
    )
