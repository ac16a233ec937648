"""HTML to text as laid out: a tree builder and a renderer of visible text.

The builder reads tags, comments, raw-text elements and character references,
supplies the tags that HTML lets authors leave out (p, li, dt, dd, option, the
parts of tables, head and body), closes void elements and ignores end tags that
close nothing.  The renderer walks the tree without recursion and writes what a
reader would see: text of hidden elements is left out (head, script, style,
template, noscript and embedded media; ``hidden``; ``display: none``,
``visibility: hidden`` until made visible again; closed details and dialogs;
in svg and math what is only a definition or description, also where an svg
``use`` would draw it elsewhere),
white space collapses outside pre, blocks begin on lines of their own,
paragraphs and headings stand between empty lines, list items carry marks and
are indented, and the cells of a table are aligned in columns.

Defined cases: null html gives null text, empty html an empty text; text that
stands in a table outside its cells goes before the table; unclosed elements
end with the document; any depth and length are handled; repeated rows give
equal results; other columns pass untouched.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.session import ship_package

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object video audio canvas datalist".split())
#: Elements of svg and math that are never shown where they stand.
UNSEEN_FOREIGN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata pattern script style symbol title".split())
#: Elements of svg and math whose content is read as html again.
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Start tags that end an open svg or math element.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure hr ul ol menu fieldset".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup legend li listing main nav "
    "optgroup option section search select summary table caption thead tbody tfoot tr td th plaintext xmp".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li dd dt listing main menu nav ol p pre search section summary table ul xmp".split()
)
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
#: Tag -> open elements that it closes, and the elements behind which it looks no further.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}), "colgroup": ({"caption", "colgroup"}, {"table"}),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["thead"]
CELLS = ("td", "th")
#: An end tag does not close elements outside the cell or table it stands in.
WALL = frozenset({"td", "th", "table", "caption"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Raw-text element -> its end tag.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I | re.A) for tag in RAW}
_HIDE = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_VISIBLE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.foreign = foreign  # an element of svg or math

    def holds_foreign(self) -> bool:
        return self.foreign and self.tag not in POINTS


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), htmllib.unescape(a or b or c))
    return out


class _Builder:
    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.body = None
        self.places: dict[str, list[int]] = {}  # tag -> where it stands in the stack

    def _push(self, tag: str, attrs: dict | None = None) -> None:
        node = Node(tag, attrs, tag in ("svg", "math") or self.stack[-1].holds_foreign())
        self.stack[-1].children.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def _drop(self, low: int) -> None:
        """Close all elements from place ``low`` on."""
        while len(self.stack) > low:
            self.places[self.stack.pop().tag].pop()

    def _last(self, names) -> int:
        """The innermost place of an open element of these names, 0 if there is none."""
        return max((self.places[t][-1] for t in names if self.places.get(t)), default=0)

    def _need_body(self) -> None:
        if self.body is None:
            self._drop(1)  # an open head ends here
            self._push("body")
            self.body = self.stack[-1]

    def _close(self, names: set, wall) -> None:
        at = self._last(names)
        if at and at >= self._last(wall):
            self._drop(at)

    def text(self, data: str) -> None:
        if not data:
            return
        if self.body is None:
            if not data.strip():
                return
            self._need_body()
        self.stack[-1].children.append(data)

    def start(self, tag: str, attrs: dict, empty: bool) -> None:
        if self.stack[-1].holds_foreign():
            if tag not in BREAKS_OUT:
                self._push(tag, attrs)
                if empty:
                    self._drop(len(self.stack) - 1)
                return
            while self.stack[-1].holds_foreign():
                self._drop(len(self.stack) - 1)
        if tag == "html":
            self.root.attrs.update({k: v for k, v in attrs.items() if k not in self.root.attrs})
            return
        if tag == "head":
            if self.body is None and len(self.stack) == 1:
                self._push("head", attrs)
            return
        if tag == "body":
            self._need_body()
            self.body.attrs.update({k: v for k, v in attrs.items() if k not in self.body.attrs})
            return
        if self.body is None and tag not in HEAD_ONLY:
            self._need_body()
        if tag in ENDS_P:
            self._close({"p"}, WALL | {"button"})
        if tag in CLOSES:
            names, wall = CLOSES[tag]
            while True:  # a row ends its cell, a body its row
                depth = len(self.stack)
                self._close(names, wall)
                if len(self.stack) == depth:
                    break
            self._supply(tag)
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and self.stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._drop(len(self.stack) - 1)
        self._push(tag, attrs)
        if tag in VOID or empty and tag not in BLOCK and tag not in RAW:
            self._drop(len(self.stack) - 1)

    def _supply(self, tag: str) -> None:
        """Table parts that must stand around ``tag``."""
        here = self.stack[-1].tag
        if tag in CELLS and here in ("table", "thead", "tbody", "tfoot"):
            if here == "table":
                self._push("tbody")
            self._push("tr")
        elif tag == "tr" and here == "table":
            self._push("tbody")

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.places.get("p"):
            self.start("p", {}, False)
        if tag == "br":
            return self.start("br", {}, True)
        at = self._last((tag,))
        walls = ("table",) if tag in ("table", "tr", "tbody", "thead", "tfoot", *CELLS, "caption") else WALL
        if at and at >= self._last(walls):
            self._drop(at)


class _Scanner:
    """Finds tags and comments from left to right in time that grows with the
    text alone: what a failed search has learnt is kept."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.stop = (0, -1)  # from the first to the second no quote and no >
        self.dead: set[int] = set()  # quotes from which no tag ends

    def _stop(self, at: int) -> int:
        if not self.stop[0] <= at <= self.stop[1]:
            m = _STOP.search(self.source, at)
            self.stop = (at, m.start() if m else len(self.source))
        return self.stop[1]

    def _tag_end(self, at: int) -> int:
        """The > outside quotes that ends a tag, or -1."""
        passed = []
        while True:
            at = self._stop(at)
            if at < len(self.source) and self.source[at] == ">":
                return at
            close = -1 if at == len(self.source) or at in self.dead else self.source.find(self.source[at], at + 1)
            if close < 0:
                self.dead.update(passed, (at,))
                return -1
            passed.append(at)
            at = close + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, kind (start, end or other), tag name and rest of the next
        markup; a < that begins none is text."""
        source = self.source
        while (at := source.find("<" if at <= self.last else "<!--", at)) >= 0:
            after = source[at + 1 : at + 3]
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                return at, stop + 3 if stop >= 0 else len(source), "other", "", ""
            if at < self.last:
                if after[:1] in ("!", "?"):
                    return at, source.find(">", at) + 1, "other", "", ""
                if after[:1] == "/" and (m := _NAME.match(source, at + 2)):
                    return at, source.find(">", m.end()) + 1, "end", m[0], ""
                if m := _NAME.match(source, at + 1, self.last + 1):
                    stop = self._tag_end(m.end())
                    if stop >= 0:
                        return at, stop + 1, "start", m[0], source[m.end() : stop]
            at += 1
        return None


def build(source: str) -> Node:
    """The element tree of a page."""
    b, at, scanner = _Builder(), 0, _Scanner(source)
    while True:
        found = scanner.next(at)
        if found is None:
            b.text(htmllib.unescape(source[at:]))
            return b.root
        start, end, kind, name, rest = found
        if start > at:
            b.text(htmllib.unescape(source[at:start]))
        if source.startswith("<![CDATA[", start) and b.stack[-1].holds_foreign():
            stop = source.find("]]>", start)
            b.text(source[start + 9 : stop if stop >= 0 else len(source)])
            at = stop + 3 if stop >= 0 else len(source)
            continue
        at = end
        if kind == "end":
            b.end(name.lower())
        elif kind == "start":
            tag = name.lower()
            b.start(tag, _attributes(rest) if rest.strip(" /\n\t\r\f") else {}, rest.endswith("/"))
            if tag in RAW and not b.stack[-1].foreign:
                closing = _RAW_END[tag].search(source, at)
                stop = closing.start() if closing else len(source)
                inside = source[at:stop]
                if tag == "textarea":
                    b.text(htmllib.unescape(inside))
                elif tag == "xmp":
                    b.text(inside)
                at = stop  # the end tag, if there is one, comes next


# ------------------------------------------------------------------ rendering


class _Flow:
    """Lines of one block formatting context (the page, or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []  # parts of the open line
        self.gap, self.space = 0, False
        self.indent: list[str] = []
        self.mark = ""

    def _open(self) -> None:
        if not self.now:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            inner = "".join(self.indent)
            if self.mark:
                inner = inner[: len(inner) - len(self.mark)] + self.mark
                self.mark = ""
            self.now = [inner]
            self.space = False

    def words(self, data: str) -> None:
        # a no-break space is a letter here, not white space
        parts = data.split() if data.isascii() else re.split(r"[ \t\n\r\f]+", data.strip(" \t\n\r\f"))
        if not parts or parts == [""]:
            self.space = self.space or bool(data)
            return
        fresh = not self.now
        self._open()
        if not fresh and (self.space or data[0] in " \t\n\r\f"):
            self.now.append(" ")
        self.now.append(" ".join(parts))
        self.space = data[-1] in " \t\n\r\f"

    def exact(self, data: str) -> None:
        for i, line in enumerate(data.split("\n")):
            if i:
                self.newline()
            if line:
                self._open()
                self.now.append(line)

    def newline(self) -> None:
        """A line break that the text asks for."""
        if not self.now:
            self._open()
        self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False
        self.gap = max(self.gap, 1)

    def block(self, gap: int) -> None:
        """The next text begins on a line of its own, ``gap`` - 1 lines down."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
        return lines


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.caption: list[str] = []

    def lines(self) -> list[str]:
        """Cells padded to the widths of their columns."""
        grid: list[list[tuple[int, int, list[str]]]] = []
        until: dict[int, int] = {}  # column -> the first row that no cell above reaches
        for r, row in enumerate(self.rows):
            c, placed = 0, []
            for span, down, lines in row:
                while until.get(c, 0) > r:
                    c += 1
                placed.append((c, span, lines))
                for x in range(c, c + span) if down > 1 else ():
                    until[x] = max(until.get(x, 0), r + down)
                c += span
            grid.append(placed)
        columns = max((c + s for row in grid for c, s, _ in row), default=0)
        width = [0] * columns
        for row in grid:
            for c, span, lines in row:
                if span == 1:
                    width[c] = max(width[c], max(map(len, lines), default=0))
        for row in grid:  # what a spanning cell still needs goes to its last column
            for c, span, lines in row:
                have = sum(width[c : c + span]) + 2 * (span - 1)
                width[c + span - 1] += max(0, max(map(len, lines), default=0) - have)
        start = [0]
        for w in width:
            start.append(start[-1] + w + 2)
        out = list(self.caption)
        for row in grid:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for c, _, lines in row:
                    if k < len(lines):
                        line = line.ljust(start[c]) + lines[k]
                out.append(line.rstrip())
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "")
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() else 1


def _hidden(node: Node, parent: Node) -> bool:
    a = node.attrs
    if node.foreign and (node.tag in UNSEEN_FOREIGN or a.get("display", "").strip() == "none"):
        return True
    if node.tag in UNSEEN or "hidden" in a and a["hidden"] != "until-found":
        return True
    if node.tag == "dialog" and "open" not in a or "style" in a and _HIDE.search(a["style"]):
        return True
    if parent.tag == "details" and "open" not in parent.attrs:
        return node.tag != "summary"
    return False


def render(root: Node) -> str:
    page = _Flow()
    flows, tables, lists = [page], [], []
    # (node, parent, visible, pre) to enter, or a function to call on leaving
    stack: list = [(root, root, True, False)]
    while stack:
        item = stack.pop()
        if callable(item):
            item()
            continue
        node, parent, visible, pre = item
        flow = flows[-1]
        if isinstance(node, str):
            if visible and not (parent.tag == "details" and "open" not in parent.attrs):
                (flow.exact if pre else flow.words)(node)
            continue
        if node is not root and _hidden(node, parent):
            continue
        tag = node.tag
        if "style" in node.attrs and (m := _VISIBLE.search(node.attrs["style"])):
            visible = m[1].lower() == "visible"
        elif node.foreign and (m := _VISIBLE.match("visibility:" + node.attrs.get("visibility", ""))):
            visible = m[1].lower() == "visible"
        if node.foreign:  # a label or a row of a formula has a line of its own, its cells stand apart
            flow.space = flow.space or tag == "mtd"
            tag = "div" if tag in ("text", "mtr") else ""
        if tag == "br":
            if visible:
                flow.newline()
            continue
        leave = None
        if tag == "table":
            table = _Table()
            tables.append(table)
            flow.block(2)

            def leave(table=table, flow=flow):
                tables.pop()
                lines = table.lines()
                flow.block(2)
                for line in lines:
                    if line:
                        flow._open()
                        flow.now.append(line)
                    flow.block(1 if line else 2)
                flow.block(2)
        elif tag in CELLS and tables:
            cell = _Flow()
            flows.append(cell)
            table = tables[-1]
            if not table.rows:
                table.rows.append([])

            def leave(cell=cell, table=table, node=node):
                flows.pop()
                table.rows[-1].append((_span(node, "colspan", 1000), _span(node, "rowspan", 65534), cell.done()))
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag == "caption" and tables:
            cell = _Flow()
            flows.append(cell)

            def leave(cell=cell, table=tables[-1]):
                flows.pop()
                table.caption += cell.done()
        elif tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "")
            lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            flow.block(1 if len(lists) > 1 else 2)

            def leave(flow=flow):
                lists.pop()
                flow.block(1 if lists else 2)
        elif tag == "li":
            flow.block(1)
            mark = "- "
            if lists and lists[-1][0] == "ol":
                value = node.attrs.get("value", "")
                if re.fullmatch(r"-?[0-9]{1,9}", value):
                    lists[-1][1] = int(value)
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            flow.indent.append(" " * len(mark))
            flow.mark = mark if visible else ""

            def leave(flow=flow):
                flow.block(1)
                flow.indent.pop()
                flow.mark = ""
        elif tag == "dd":
            flow.block(1)
            flow.indent.append("    ")

            def leave(flow=flow):
                flow.block(1)
                flow.indent.pop()
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            flow.block(gap)

            def leave(flow=flow, gap=gap):
                flow.block(gap)
        inner_pre = pre or tag in ("pre", "textarea", "listing", "xmp", "plaintext")
        if leave:
            stack.append(leave)
        children = node.children
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        stack.extend((c, node, visible, inner_pre) for c in reversed(children))
    return "\n".join(page.done())


def to_text(source: str | None) -> str | None:
    return None if source is None else render(build(source))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page in ``out_col``."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: to_text(s) if isinstance(s, str) else None)

    return pages.withColumn(out_col, rendered(F.col(html_col)))
