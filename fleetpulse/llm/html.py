"""HTML extraction that follows the layout of a page.

A tokenizer splits the page, a tree builder adds the tags that HTML implies
(closing of p, li, dt, dd, option, cells and rows; rows and bodies of tables),
and a renderer walks the tree and writes what a reader would see: paragraphs
set apart by a blank line, other blocks by a line break, list items with their
mark and indent, preformatted text as it is, and table cells padded to the
width of their column.  Everything works in loops, so depth is no limit.

Formulas and drawings (math, svg) show their text; each svg text and each row of a
formula's table is a line of its own.

Not visible: scripts, styles, templates, metadata and embedded objects; titles,
descriptions, definitions and annotations of math and svg; elements with
``hidden`` or with display:none among the declarations of their style; a dialog
that is not open; brackets for browsers without ruby; inputs, but for the text of
buttons; what a closed ``details`` holds besides its summary.  visibility is
inherited: in a hidden element only what is declared visible again is shown.
Rules of a page's own style sheets are not read.

Defined cases: null or empty html gives an empty text; quotes inside a tag open a
string only right after "=", as in HTML; an unclosed comment, tag, quoted value
or script reaches to the end of the page; unknown tags are inline; repeated rows
are rendered row by row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column

EXTRACTED = "text string, n_chars long, n_lines long, n_words long"

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset(
    "script style template head title noscript iframe noembed noframes object embed audio video canvas datalist"
    " map meta link base rp".split()
)
BUTTONS = frozenset(("submit", "button", "reset"))
#: Parts of svg and math that are never shown.
UNSEEN_FOREIGN = frozenset("title desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
#: Inside these parts of svg and math, tags are those of HTML again.
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Start tags that end an svg or math.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol"
    " p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure ul ol dl table hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li"
    " main menu nav optgroup option search section summary caption tr thead tbody tfoot select".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: What a start tag closes, and the open element at which the search for it ends.
IMPLIED_END = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["table", "tr"])),
} | dict.fromkeys(
    ("thead", "tbody", "tfoot", "caption", "colgroup"),
    (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
)
#: An end tag or an implied end does not look beyond these.
SCOPE = frozenset(("table", "td", "th", "caption", "template", "object"))

#: A quote opens a string only right after "="; any other quote is an ordinary character.
_ATTRIBUTE = r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+)|(?=>)|\Z)|(?![ \t\n\f\r]*+=))"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*)((?:[ \t\n\f\r/]++|{_ATTRIBUTE})*+)>")
_NAME = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(_ATTRIBUTE)
#: Declarations of a style: strings, comments and brackets are no place for a ";" or ":" that counts.
_DECLARED = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\([^)]*\)|[^;"'(])+)""", re.S)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})")
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def tokens(page: str, opened: Callable[[str], bool], foreign: Callable[[], bool]) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, start, end and raw (text that holds no tags).

    ``opened`` tells whether the last start tag opened an element, ``foreign`` whether the page is inside svg or math.
    """
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt) and foreign():
            end = page.find("]]>", lt + 9)
            yield "raw", page[lt + 9 : n if end < 0 else end], ""
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?", "</"), lt) and not _NAME.match(page, lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif not _NAME.match(page, lt):
            yield "text", "<", ""
            at = lt + 1
        else:
            m = _TAG.match(page, lt)
            if m is None:
                return
            at, name = m.end(), m[2].lower()
            yield ("end" if m[1] else "start"), name, m[3]
            if not m[1] and name in RAW and opened(name):
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                end = n if close is None else close.start()
                yield "raw", page[at:end], ""
                at = end


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs or {}, [], foreign

    def displayed(self) -> bool:
        return not (
            self.tag in UNSEEN
            or self.foreign
            and self.tag in UNSEEN_FOREIGN
            or "hidden" in self.attrs
            or self.tag == "dialog"
            and "open" not in self.attrs
            or self.tag == "input"
            and self.attrs.get("type", "").strip().lower() not in BUTTONS
            or self.declared("display") == "none"
        )

    def declared(self, name: str) -> str:
        """Value of a property in the element's style: the last one, important ones before others."""
        style = self.attrs.get("style", "")
        if name not in style.lower():
            return ""
        found, important = "", False
        for one in _DECLARED.findall(_COMMENT.sub(" ", style)):
            key, _, value = one.partition(":")
            value = value.strip().lower()
            weighty = value.endswith("important") and value[: -len("important")].rstrip().endswith("!")
            if key.strip().lower() == name and value and weighty >= important:
                found, important = value.partition("!")[0].strip(), weighty
        return found


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def self_closing(text: str) -> bool:
    """Whether a tag with these attributes ends in a "/" that is no part of a value."""
    return text.endswith("/") and max((m.end() for m in _ATTR.finditer(text)), default=0) < len(text)


def tree(page: str) -> Node:
    """The page as nodes and strings, with the implied tags in place."""
    root = Node("#page")
    stack = [root]
    is_open: Counter[str] = Counter()  # so that a search for a tag that is not open costs nothing

    def cut(at: int) -> None:
        is_open.subtract(x.tag for x in stack[at:])
        del stack[at:]

    def close(names: frozenset, until: frozenset) -> None:
        """Close open elements up to the outermost of ``names`` that stands inside ``until``."""
        if not any(is_open[x] for x in names):
            return
        keep = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                keep = k
            elif stack[k].tag in until:
                break
        if keep is not None:
            cut(keep)

    def foreign() -> bool:
        return stack[-1].foreign and stack[-1].tag not in HTML_INSIDE

    def open_(tag: str, attrs: dict | None = None) -> None:
        node = Node(tag, attrs, tag in ("svg", "math") or foreign())
        stack[-1].children.append(node)
        stack.append(node)
        is_open[tag] += 1

    for kind, name, rest in tokens(page, lambda tag: stack[-1].tag == tag, foreign):
        if kind == "text":
            stack[-1].children.append(html.unescape(name))
        elif kind == "raw":
            stack[-1].children.append(html.unescape(name) if stack[-1].tag in ("textarea", "title") else name)
        elif kind == "start" and (foreign() and name not in BREAKOUT or name in ("svg", "math")):
            open_(name, attributes(rest))
            if self_closing(rest):
                cut(len(stack) - 1)
        elif kind == "start":
            if foreign():
                cut(next(k for k in range(len(stack) - 1, 0, -1) if not stack[k - 1].foreign or stack[k - 1].tag in HTML_INSIDE))
            if name in CLOSES_P:
                close(frozenset(["p"]), SCOPE | {"button"})
            if name in IMPLIED_END:
                names, until = IMPLIED_END[name]
                close(names, until)
            if name in ("td", "th") and stack[-1].tag != "tr" and any(x.tag == "table" for x in stack[-3:]):
                open_("tr")
            if name == "tr" and stack[-1].tag == "table":
                open_("tbody")
            if name in VOID:
                stack[-1].children.append(Node(name, attributes(rest)))
            else:
                open_(name, attributes(rest))
        elif name in VOID:
            if name == "br":
                stack[-1].children.append(Node("br"))
        elif is_open[name]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    cut(k)
                    break
                if stack[k].tag in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
                if stack[k].tag == "table":
                    break
    return root


class Writer:
    """Lines of one block of layout: the page, or a cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.gap = 0  # line breaks due before the next line: 1, or 2 for a blank line
        self.indent = ""
        self.mark = ""  # of the list item about to begin

    def _begin(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark, self.blank = "", False

    def text(self, s: str) -> None:
        words = _BLANKS.split(s)
        for k, w in enumerate(words):
            if k and self.line:
                self.blank = True
            if w:
                self._begin()
                if self.blank:
                    self.line.append(" ")
                    self.blank = False
                self.line.append(w)

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False

    def block(self, gap: int) -> None:
        self.newline()
        self.gap = max(self.gap, gap)

    def verbatim(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                if not self.line:
                    self._begin()
                self.newline()
            if part:
                self._begin()
                self.line.append(part)

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self._begin()
            self.line.append(line)
            self.newline()

    def done(self) -> list[str]:
        self.newline()
        return self.lines


class Grid:
    """A table: rows of cells, each a list of lines with a column span and a row span."""

    def __init__(self) -> None:
        self.grid: list[list[tuple[list[str], int, int]]] = []
        self.groups: list[int] = []  # of each row: the head, body or foot it stands in, which no cell leaves
        self.group = 0

    def placed(self) -> list[list[tuple[list[str], int]]]:
        """Rows of lines and column spans without gaps: below a cell of several rows its columns are empty."""
        out = []
        reach: list[tuple[int, int, int]] = []  # first column, span and last row of the cells that go on below
        for k, row in enumerate(self.grid):
            if k and self.groups[k] != self.groups[k - 1]:
                reach = []
            reach = [c for c in reach if c[2] >= k]
            cells, more, at, upcoming = [], [], 0, 0
            for lines, span, below in row:
                # The first columns that are free for the whole cell.
                while upcoming < len(reach) and reach[upcoming][0] < at + span:
                    first, width, _ = reach[upcoming]
                    cells += [([], first - at)] * (first > at) + [([], width)]
                    at = first + width
                    upcoming += 1
                cells.append((lines, span))
                if below > 1:
                    more.append((at, span, k + below - 1))
                at += span
            for first, width, _ in reach[upcoming:]:
                cells += [([], first - at)] * (first > at) + [([], width)]
                at = first + width
            reach = sorted(reach + more)
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        grid = self.placed()
        widths: list[int] = []
        for row in grid:
            at = 0
            for cell, span in row:
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max([widths[at], *map(len, cell)])
                at += span
        out = []
        for row in grid:
            for k in range(max((len(c) for c, _ in row), default=0)):
                at, parts = 0, []
                for cell, span in row:
                    width = sum(widths[at : at + span]) + 3 * (span - 1)
                    parts.append((cell[k] if k < len(cell) else "").ljust(width))
                    at += span
                out.append(" | ".join(parts).rstrip())
        return out


def _span(node: Node) -> int:
    value = node.attrs.get("colspan", "1").strip()
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() else 1


def _rows(node: Node) -> int:
    """Rows that a cell covers; a span of 0 reaches to the end of its head, body or foot."""
    value = node.attrs.get("rowspan", "1").strip()
    return min(int(value) or 65534, 65534) if value.isascii() and value.isdigit() else 1


def _counter(node: Node) -> list[int]:
    """The number before that of a list's first item, and the step to the next one."""
    step = -1 if "reversed" in node.attrs else 1
    start = _INTEGER.match(node.attrs.get("start", ""))
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    return [(int(start[1]) if start else items if step < 0 else 1) - step, step]


def render(root: Node) -> str:
    """The visible text of a tree."""
    page = Writer()
    writers, grids = [page], []
    counters: list[list[int] | None] = []  # number and step of open lists: None for bullets
    pre = 0
    seen = True  # visibility as it is inherited here

    def see(value: bool) -> None:
        nonlocal seen
        seen = value

    # What is left to do: a node to enter, or a function that leaves one.
    todo: list = [root]
    while todo:
        x = todo.pop()
        w = writers[-1]
        if isinstance(x, str):
            if seen:
                w.verbatim(x) if pre else w.text(x)
            continue
        if callable(x):
            x()
            continue
        if not x.displayed():
            continue
        tag, children = x.tag, x.children
        own = x.declared("visibility")
        if own in ("visible", "hidden", "collapse") and (own == "visible") != seen:
            todo.append(partial(see, seen))
            seen = not seen
        if tag == "input":
            if seen:
                w.text(x.attrs.get("value", ""))
            continue
        if tag == "br":
            if not w.line:
                w._begin()
            w.newline()
            continue
        leave = None
        if tag == "table":
            w.block(2)
            grids.append(Grid())

            def leave() -> None:
                lines = grids.pop().lines()
                writers[-1].rows(lines)
                writers[-1].block(2)
        elif x.foreign and tag in ("text", "mtr", "mlabeledtr"):
            w.block(1)

            def leave() -> None:
                writers[-1].block(1)
        elif x.foreign and tag == "mtd":
            w.blank = bool(w.line)
        elif tag == "tr" and grids:
            grids[-1].grid.append([])
            grids[-1].groups.append(grids[-1].group)
        elif tag in ("td", "th") and grids:
            if not grids[-1].grid:
                grids[-1].grid.append([])
                grids[-1].groups.append(grids[-1].group)
            writers.append(Writer())

            def leave(span: int = _span(x), below: int = _rows(x), row: list = grids[-1].grid[-1]) -> None:
                row.append((writers.pop().done(), span, below))
        elif tag == "caption" and grids:
            w.block(1)

            def leave() -> None:
                writers[-1].block(1)
        elif tag in LISTS:
            w.block(1 if counters else 2)
            counters.append(_counter(x) if tag == "ol" else None)

            def leave() -> None:
                counters.pop()
                writers[-1].block(1 if counters else 2)
        elif tag == "li":
            w.block(1)
            mark = "- "
            if counters and counters[-1] is not None:
                number = _INTEGER.match(x.attrs.get("value", ""))
                counters[-1][0] = int(number[1]) if number else sum(counters[-1])
                mark = f"{counters[-1][0]}. "
            before = w.indent
            w.indent += " " * len(mark)
            w.mark = mark if seen else ""

            def leave(before: str = before) -> None:
                writers[-1].block(1)
                writers[-1].indent, writers[-1].mark = before, ""
        elif tag == "dd" or tag == "blockquote":
            gap, before = (2 if tag in SPACED else 1), w.indent
            w.block(gap)
            w.indent += "  "

            def leave(before: str = before, gap: int = gap) -> None:
                writers[-1].block(gap)
                writers[-1].indent = before
        elif tag == "pre" or tag == "textarea":
            w.block(2 if tag == "pre" else 1)
            pre += 1
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]

            def leave() -> None:
                nonlocal pre
                pre -= 1
                writers[-1].block(2)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            w.block(gap)
            if tag in ("thead", "tbody", "tfoot") and grids:
                grids[-1].group += 1
            if tag == "details" and "open" not in x.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]

            def leave(gap: int = gap) -> None:
                writers[-1].block(gap)
        if leave is not None:
            todo.append(leave)
        todo += reversed(children)
    return "\n".join(page.done())


def extract(page: str) -> str:
    return render(tree(page))


def extracted(page: Column) -> Column:
    """Struct ``EXTRACTED`` of each page."""

    def row(x: str) -> tuple:
        text = extract(x)
        return text, len(text), text.count("\n") + 1 if text else 0, len(text.split())

    return text_column(EXTRACTED, row, page)


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url and ``EXTRACTED`` for every row of ``pages``."""
    return pages.select("page_id", "url", extracted(F.col("html")).alias("e")).select("page_id", "url", "e.*")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))
