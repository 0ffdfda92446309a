"""Layout-aware text of HTML pages.

A small tree builder turns a page into elements, with the tags that HTML implies: a
block ends an open paragraph; list items, table rows, cells, options and definitions
end their siblings; an end tag closes what is open inside it; stray end tags and
unclosed elements do no harm. Elements that are not shown (head matter, scripts,
styles, templates, ``hidden``, ``display:none``) leave nothing. ``visibility`` is handed down:
hidden text leaves its place (lines, list numbers, cells) empty, and a visible element inside a
hidden one is shown. The
renderer emits all other text: white space collapses except in ``pre``, blocks
start lines, paragraphs and headings stand apart by an empty line, list items are
indented under bullets or numbers, and the cells of a table are aligned in columns. A cell
is rendered like a page of its own, and its lines stand beside those of its neighbours; lines
longer than CELL_WIDTH are wrapped. Cells span columns and reserve theirs in the rows they span. A
table of one column, or one with a table, heading or section inside, arranges the page: its
cells follow each other as blocks. In an aligned table, captions and what stands outside
cells come before the rows, as in a browser.

Both walk with a stack of their own, so nesting depth is not limited by recursion.

Defined cases: a null page gives a null text and an empty page an empty one; broken
markup is read like a browser would, as far as the rules above go; repeated rows give
equal rows; other columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelens.llm.common import batches, map_arrow

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>")
ROUGH = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
OPAQUE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes datalist object audio video "
                   "canvas svg math".split())
#: Blocks with an empty line before and after, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu".split())
LINES = frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form "
                  "header hgroup html legend li main nav optgroup option search section select summary tbody td "
                  "tfoot th thead tr".split())
BLOCKS = SPACED | LINES
#: What a start tag ends, and the elements behind which it does not look.
ENDS: dict[str, tuple[frozenset, frozenset]] = {}
for _tags, _ended, _scope in (
        ("li", "li", "ul ol menu dir"),
        ("dt dd", "dt dd", "dl"),
        ("td th", "td th", "table tr"),
        ("tr", "tr td th caption colgroup", "table"),
        ("tbody thead tfoot", "tbody thead tfoot tr td th caption colgroup", "table"),
        ("option", "option", "select datalist"),
        ("optgroup", "optgroup option", "select"),
        ("rt rp", "rt rp", "ruby"),
        ("body", "head", "")):
    for _t in _tags.split():
        ENDS[_t] = (frozenset(_ended.split()), frozenset(_scope.split()))
END_P = (SPACED | LINES) - frozenset("body html td th tr tbody thead tfoot caption option optgroup select".split())
P_SCOPE = frozenset("td th caption button table object".split())
HEAD_ONLY = frozenset("meta link title style script base noscript template head".split())
#: What makes a table one that arranges blocks.
LAYOUT = frozenset("table h1 h2 h3 h4 h5 h6 article section main nav header footer aside blockquote figure fieldset "
                   "hr".split())
#: Elements that ``visibility:collapse`` takes out of a table; elsewhere it hides.
COLLAPSING = frozenset("tr tbody thead tfoot col colgroup".split())
CELL_WIDTH = 100            # characters of a line in an aligned cell
MOST_COLUMNS, MOST_ROWS = 1000, 65534       # what HTML allows a cell to span (fixed values)


class Node:
    __slots__ = ("tag", "kids", "unseen", "attrs", "shown")

    def __init__(self, tag: str, attrs: str = "", shown: bool = True):
        """``shown``: whether the parent's text is visible, unless the element says otherwise."""
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.unseen = tag in HIDDEN or bool(attrs) and _unseen(tag, attrs)
        self.shown = shown
        if attrs and "isib" in attrs.lower():
            said = VISIBILITY.findall(attribute(attrs, "style") or "")
            how = said[-1].lower() if said else "inherit"
            if how == "collapse" and tag in COLLAPSING:
                self.unseen = True
            elif how in ("hidden", "collapse"):
                self.shown = False
            elif how in ("visible", "initial"):
                self.shown = True


def attribute(attrs: str, name: str) -> str | None:
    for m in ATTRIBUTE.finditer(attrs):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


def _unseen(tag: str, attrs: str) -> bool:
    low = attrs.lower()
    if "hidden" in low:
        if attribute(attrs, "hidden") is not None or tag == "input" and attribute(attrs, "type") == "hidden":
            return True
    return "style" in low and bool(UNSEEN_STYLE.search(attribute(attrs, "style") or ""))


def build(page: str) -> Node:
    """The element tree of a page."""
    root = Node("html")
    stack = [root]
    paragraph = [0]                                     # per open element: the open p in its scope
    count: dict[str, int] = {"html": 1}                 # open elements by tag
    pos, n = 0, len(page)

    def push(node: Node) -> None:
        tag = node.tag
        paragraph.append(len(stack) if tag == "p" else 0 if tag in P_SCOPE else paragraph[-1])
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1

    def cut(at: int) -> None:
        """Close everything from the element at position ``at`` on."""
        for x in stack[at:]:
            count[x.tag] -= 1
        del stack[at:], paragraph[at:]

    def end(tags: frozenset, scope: frozenset) -> None:
        """Close the outermost of ``tags`` that is open inside the nearest ``scope``."""
        if not any(count.get(t) for t in tags):
            return
        at = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in tags:
                at = i
        if at:
            cut(at)

    last = page.rfind(">")
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            text = page[pos:lt]
            if stack[-1].tag == "head" and text.strip():
                cut(len(stack) - 1)
            if stack[-1].shown:
                stack[-1].kids.append(html.unescape(text) if "&" in text else text)
            pos = lt
            continue
        m = pos < last and (TAG.match(page, pos) or ROUGH.match(page, pos))
        if not m:
            m = OPAQUE.match(page, pos)
            if m:
                pos = m.end()
            else:                                       # a lone < is text
                if stack[-1].shown:
                    stack[-1].kids.append("<")
                pos += 1
            continue
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            for i in range(len(stack) - 1, 0, -1) if count.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    break                               # an end tag does not reach out of its cell
            continue
        if tag in ("html", "head", "body") and (tag == "html" or count.get("body")):
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in END_P and paragraph[-1]:
            cut(paragraph[-1])
        rule = ENDS.get(tag)
        if rule:
            end(*rule)
        node = Node(tag, m[3], stack[-1].shown)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            stop = close.start() if close else n
            if not node.unseen and node.shown:
                inner = page[pos:stop]
                node.kids.append(html.unescape(inner) if tag == "textarea" else inner)
            pos = close.end() if close else n
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "math")):
            push(node)
    return root


class Page:
    """Lines under construction: pending blanks and breaks are written when text follows."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0
        self.blank = False
        self.indent: list[str] = []
        self.mark: str | None = None                    # bullet or number of the item being opened

    def block(self, breaks: int) -> None:
        self.blank = False
        if self.parts:
            self.breaks = max(self.breaks, breaks)

    def open_line(self) -> None:
        if self.breaks or not self.parts:
            self.parts.append("\n" * self.breaks)
            lead = "".join(self.indent)
            if self.mark is not None:
                lead = lead[:len(lead) - len(self.mark)] + self.mark
                self.mark = None
            self.parts.append(lead)
            self.breaks = 0

    def text(self, s: str) -> None:
        flat = BLANKS.sub(" ", s)
        body = flat.strip(" ")
        if not body:
            self.blank = self.blank or bool(flat)
            return
        new_line = self.breaks or not self.parts or self.mark is not None
        if (self.blank or flat[0] == " ") and not new_line:
            self.parts.append(" ")
        if self.mark is not None and not self.breaks and self.parts:
            self.breaks = 1
        self.open_line()
        self.parts.append(body)
        self.blank = flat[-1] == " "

    def lines(self, s: str) -> None:
        """Text whose line breaks and blanks count."""
        for i, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.breaks += 1
            if line:
                self.open_line()
                self.parts.append(line)
        self.blank = False

    def result(self) -> str:
        return "".join(self.parts).strip("\n")


def is_layout(table: Node) -> bool:
    """Whether a table holds a table, heading or section and so arranges blocks rather than cells."""
    stack = list(reversed(table.kids))
    while stack:
        x = stack.pop()
        if not isinstance(x, str) and not x.unseen:
            if x.tag in LAYOUT:
                return True
            stack += reversed(x.kids)
    return False


def span_of(cell: Node, name: str, most: int, least: int = 1) -> int:
    """A cell's colspan or rowspan; 1 if it is missing or no number."""
    value = attribute(cell.attrs, name) if name in cell.attrs.lower() else None
    number = re.match(r"\s*\+?(\d{1,9})", value) if value else None
    return min(int(number[1]), most) if number and int(number[1]) >= least else 1


def table_parts(table: Node) -> tuple[list, list[tuple[int, list[Node]]]]:
    """Captions (and what is outside cells), and the rows: a number of their section, and their cells."""
    loose: list = []
    rows: list[tuple[int, list[Node]]] = []
    sections = 0
    stack: list[tuple] = [(k, None, 0) for k in reversed(table.kids)]
    while stack:
        x, row, section = stack.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif x.unseen or x.tag in ("col", "colgroup"):
            continue
        elif x.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append((section, row))
            row.append(x)
        elif x.tag == "tr":
            row = []
            rows.append((section, row))
            stack += [(k, row, section) for k in reversed(x.kids)]
        elif x.tag in ("tbody", "thead", "tfoot", "form"):
            sections += x.tag != "form"
            stack += [(k, row, sections if x.tag != "form" else section) for k in reversed(x.kids)]
        else:
            loose.append(x)
    return loose, rows


def placed(rows: list[tuple[int, list[Node]]]) -> list[list[tuple[int, int, Node]]]:
    """(first column, columns, cell) of every row; a cell takes the first columns that no cell above reserves."""
    out = []
    reserved: dict[int, int] = {}                       # column: rows still to come of a cell above
    last = None
    for section, cells in rows:
        if section != last:
            reserved, last = {}, section                # a cell ends with its section
        at, here, new = 0, [], {}
        for cell in cells:
            while at in reserved:
                at += 1
            wide = span_of(cell, "colspan", MOST_COLUMNS)
            tall = span_of(cell, "rowspan", MOST_ROWS, least=0) or MOST_ROWS
            here.append((at, wide, cell))
            new |= {c: tall for c in range(at, at + wide) if tall > 1} if tall > 1 else {}
            at += wide
        reserved = {c: n - 1 for c, n in (reserved | new).items() if n > 1}
        out.append(here)
    return out


def wrapped(line: str) -> list[str]:
    """A line in pieces of at most CELL_WIDTH characters, cut at a blank where there is one."""
    out = []
    while len(line) > CELL_WIDTH:
        cut = line.rfind(" ", 1, CELL_WIDTH + 1)
        if cut <= 0 or not line[:cut].strip():
            cut = CELL_WIDTH
        out.append(line[:cut].rstrip(" "))
        line = line[cut:].lstrip(" ")
    return [*out, line] if line or not out else out


def aligned(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Lines of rows of (first column, columns, lines): every column as wide as its widest line."""
    for row in rows:
        while row and not row[-1][2]:
            row.pop()                                   # empty cells at the end of a row leave nothing
    widths: dict[int, int] = {}
    for wanted in (False, True):                        # cells of one column first, then what spans several
        for row in rows:
            for at, wide, lines in row:
                need = max(map(len, lines), default=0)
                if wide == 1 and not wanted:
                    widths[at] = max(widths.get(at, 0), need)
                elif wide > 1 and wanted:
                    have = sum(widths.get(c, 0) for c in range(at, at + wide)) + 3 * (wide - 1)
                    if need > have:
                        widths[at + wide - 1] = widths.get(at + wide - 1, 0) + need - have
    out = []
    for row in rows:
        for i in range(max((len(lines) for *_, lines in row), default=0)):
            parts, column = [], 0
            for at, wide, lines in row:
                parts += [" " * widths.get(c, 0) for c in range(column, at)]
                room = sum(widths.get(c, 0) for c in range(at, at + wide)) + 3 * (wide - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(room))
                column = at + wide
            out.append(" | ".join(parts).rstrip(" "))
    return out


def render(roots: list, pre: int = 0) -> str:
    """Text of elements and strings in a row; ``pre`` if they stand in preformatted text."""
    out = Page()
    counters: list[int | None] = []
    stack: list = [(k, False) for k in reversed(roots)]
    while stack:
        x, leaving = stack.pop()
        if isinstance(x, str):
            if pre:
                out.lines(x)
            else:
                out.text(x)
            continue
        tag = x.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            elif tag == "li":
                out.indent.pop()
                out.mark = None
            elif tag in ("dd", "blockquote"):
                out.indent.pop()
            elif tag in ("pre", "xmp", "textarea"):
                pre -= 1
            if tag in BLOCKS:
                out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 1)
            continue
        if x.unseen:
            continue
        if tag == "br":
            out.blank = False
            if out.parts:
                out.breaks = min(out.breaks + 1, 2)
            continue
        if tag == "img":
            alt = attribute(x.attrs, "alt") if "alt" in x.attrs.lower() else None
            if alt and x.shown:
                out.text(f" {alt} ")
            continue
        if tag in BLOCKS:
            out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 1)
        if tag == "table" and not is_layout(x):
            loose, rows = table_parts(x)
            grid = placed(rows)
            if any(at + wide > 1 for row in grid for at, wide, _ in row):   # no cell holds a table: no deeper call
                for line in render(loose, pre).split("\n") if loose else ():
                    out.block(1)
                    out.lines(line)
                cells = [[(at, wide, render(c.kids, pre)) for at, wide, c in row] for row in grid]
                for line in aligned([[(at, wide, [w for x in t.split("\n") for w in wrapped(x)] if t else [])
                                      for at, wide, t in row] for row in cells]):
                    out.block(1)
                    out.lines(line)
                out.block(2)
                continue
        if tag in ("ul", "ol", "menu", "dir"):
            start = attribute(x.attrs, "start") if tag == "ol" and "start" in x.attrs.lower() else None
            counters.append(None if tag != "ol" else int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1)
        elif tag == "li":
            if counters and counters[-1] is not None:
                mark = f"{counters[-1]}. "
                counters[-1] += 1
            else:
                mark = "- "
            out.indent.append(" " * len(mark))
            out.mark = mark
        elif tag in ("dd", "blockquote"):
            out.indent.append("    ")
        elif tag in ("pre", "xmp", "textarea"):
            pre += 1
            if x.kids and isinstance(x.kids[0], str) and x.kids[0].startswith("\n"):
                x.kids[0] = x.kids[0][1:]
        stack.append((x, True))
        stack += [(k, False) for k in reversed(x.kids)]
    return out.result()


def page_text(page: str) -> str:
    return render([build(page)])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            text_col: str = "text") -> DataFrame:
    """(id, text) of every page."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType),
                           T.StructField(text_col, T.StringType())])

    def run(it):
        for batch in batches(it, "_html"):
            texts = [None if p is None else page_text(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return map_arrow(pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")), run, schema)
