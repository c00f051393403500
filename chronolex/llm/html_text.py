"""Layout-aware rendering of HTML pages as text.

A tree builder adds the tags that authors leave out (a new list item ends the last one, a block ends a paragraph, a row
gets its table body), visibility rules drop what a browser would not show, and a renderer lays out the rest: paragraphs
with blank lines, other blocks on lines of their own, lists with markers and indents, preformatted text as it is, and
tables with their cells padded to columns. No text that is visible is left out, whatever it is: this is not an article finder.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist object iframe audio video canvas param".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul tbody thead tfoot tr caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag ends an open element of these names, unless one of the second names stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements in the head; any other start tag or text ends an open head.
IN_HEAD = frozenset("title meta link base script style template noscript".split())
SCOPE = frozenset("table td th caption html".split())
#: Deeper elements are put beside each other at this depth, as browsers do; hidden ones stay hidden.
DEEPEST = 256
#: Layout that would cost more than it shows: cells wider than CELL are not padded, tables wider than TABLE not aligned, indents end at INDENT.
CELL, TABLE, INDENT = 40, 200, 40
#: Spans of cells above these count as these, as the standard says.
COLUMNS, ROWS = 1000, 65_534

_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,10})(?![0-9])")


class Node:
    __slots__ = ("children", "name", "props")

    def __init__(self, name: str, props: dict[str, str]):
        self.name, self.props, self.children = name, props, []


class TreeBuilder(HTMLParser):
    """``open`` holds the open elements, each with the node that takes its children; ``places`` says where each name is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def _last(self, names: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def _close(self, at: int) -> None:
        for name, _ in self.open[at:]:
            self.places[name].pop()
        del self.open[at:]

    def _end_in_scope(self, names: set[str], until: set[str] | frozenset[str]) -> None:
        if (at := self._last(names)) > self._last(until):
            while at > 1 and self.open[at - 1][0] in names:
                at -= 1
            self._close(at)

    def _leave_head(self) -> None:
        if head := self.places.get("head"):
            self._close(head[0])

    def _start(self, name: str, props: dict[str, str]) -> None:
        node, home = Node(name, props), self.open[-1][1]
        deep = len(self.open) >= DEEPEST
        if not deep or displayed(node):  # a hidden element beyond the depth takes its content with it
            home.children.append(node)
        if name not in VOID:
            self.places[name].append(len(self.open))
            self.open.append((name, home if deep and displayed(node) else node))

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        props = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        if name == "html":
            self.root.props = props | self.root.props
            return
        if name not in IN_HEAD and name != "head":
            self._leave_head()
        if name in ENDS_P:
            self._end_in_scope({"p"}, SCOPE | {"button"})
        if name in ENDS:
            self._end_in_scope(*ENDS[name])
        inner = self.open[-1][0]
        if name == "tr" and inner == "table":
            self._start("tbody", {})
        elif name in ("td", "th") and inner in ("table", "tbody", "thead", "tfoot"):
            if inner == "table":
                self._start("tbody", {})
            self._start("tr", {})
        self._start(name, props)

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)

    def handle_endtag(self, name: str) -> None:
        if name == "br":
            self._start("br", {})
            return
        at = self._last({name})
        if at and (name in ("table", "body", "html") or at > self._last(SCOPE - {name})):
            self._close(at)
        elif name == "p":
            self._start("p", {})
            self._close(len(self.open) - 1)

    def handle_data(self, text: str) -> None:
        if self.open[-1][0] not in IN_HEAD and text.strip():
            self._leave_head()
        self.open[-1][1].children.append(text)


def _style(node: Node) -> dict[str, str]:
    """The element's own declarations; of several of one property an important one counts, then the last."""
    found: dict[str, str] = {}
    for part in node.props.get("style", "").split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if value and not (found.get(name, "").endswith("!important") and not value.endswith("!important")):
            found[name] = value
    return {name: value.removesuffix("!important").rstrip() for name, value in found.items()}


def displayed(node: Node) -> bool:
    """False if neither the element nor anything in it takes part in the layout."""
    props = node.props
    if node.name in HIDDEN or node.name == "input" and props.get("type", "").lower() == "hidden":
        return False
    own = _style(node).get("display") if "style" in props else None
    if own is not None:
        return own != "none"
    return not ("hidden" in props or node.name == "dialog" and "open" not in props)


def shown(node: Node, outside: bool) -> bool:
    """Whether text of the element itself is visible; elements in it can say otherwise."""
    own = _style(node).get("visibility") if "style" in node.props else None
    return {"visible": True, "hidden": False, "collapse": False}.get(own, outside)


def _number(props: dict[str, str], key: str, least: int, most: int, default: int) -> int:
    """An integer as browsers read it: what follows the digits is left out, one that 32 bits cannot hold counts as none."""
    found = _INTEGER.match(props.get(key, ""))
    if not found or not -(1 << 31) <= (value := int(found[1])) < 1 << 31:
        return default
    return min(most, value) if value >= least else default


class Lines:
    """Text laid out in lines. Spaces run together over inline elements; a blank line is asked for at most once in a row."""

    def __init__(self, visible: bool = True):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent, self.marker, self.visible = "", "", visible

    def text(self, text: str) -> None:
        if not self.visible:
            self.space = self.space or bool(text)
            return
        for part in re.split(r"([ \t\n\r\f]+)", text):
            if not part:
                continue
            if part[0] in " \t\n\r\f":
                self.space = True
                continue
            if self.space and self.line:
                self.line.append(" ")
            self.space = False
            self.line.append(part)

    def end(self) -> None:
        if self.line:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append((self.indent[:INDENT] + self.marker + line).rstrip())
        if self.marker:
            self.marker = " " * len(self.marker)

    def gap(self) -> None:
        self.end()
        self.blank = True


def _rows(table: Node, visible: bool) -> tuple[list[Node], list[tuple[Node, bool]], list[Node]]:
    """Captions, rows (head first, foot last; with their visibility) and whatever else stands in a table."""
    parts: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
    captions, others = [], []
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                others.append(child)
        elif not displayed(child) or child.name in ("colgroup", "col"):
            continue
        elif child.name == "caption":
            captions.append(child)
        elif child.name in parts:
            inside = shown(child, visible)
            for row in child.children:
                if isinstance(row, Node) and row.name == "tr":
                    if displayed(row):
                        parts[child.name].append((row, shown(row, inside)))
                elif isinstance(row, Node) and displayed(row) or isinstance(row, str) and row.strip():
                    others.append(row)
        else:
            others.append(child)
    return captions, parts["thead"] + parts["tbody"] + parts["tfoot"], others


def _grid(rows: list[tuple[Node, bool]]) -> list[dict[int, list[str]]]:
    """Lines of each cell that has any, by column, for each row. A cell over several columns or rows fills the first.

    ``held`` has the columns that cells of rows above take, from left to right: first column, the one after the last, last row.
    """
    grid: list[dict[int, list[str]]] = []
    held: list[tuple[int, int, int]] = []
    for y, (row, visible) in enumerate(rows):
        cells: dict[int, list[str]] = {}
        held = [h for h in held if h[2] >= y]
        own: list[tuple[int, int, int]] = []
        x = k = 0
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                node, inside = Node("td", {}), [cell]
            elif not displayed(cell):
                continue
            else:
                node, inside = cell, cell.children if cell.name in ("td", "th") else [cell]
            while k < len(held) and held[k][0] <= x:
                x, k = max(x, held[k][1]), k + 1
            if lines := render_lines(inside, shown(node, visible)):
                cells[x] = lines
            wide, high = _number(node.props, "colspan", 1, COLUMNS, 1), _number(node.props, "rowspan", 0, ROWS, 1)
            if high != 1:
                own.append((x, x + wide, y + high - 1 if high else len(rows)))
            x += wide
        held = sorted(held + own) if own else held
        grid.append(cells)
    return grid


def _table(out: Lines, table: Node) -> None:
    captions, rows, others = _rows(table, out.visible)
    for node in [*captions, *others]:
        _walk(out, [node])
        out.end()
    grid = [row for row in _grid(rows) if row]
    widths: dict[int, int] = {}
    for row in grid:
        for x, lines in row.items():
            widths[x] = max(widths.get(x, 0), *(len(line) if len(line) <= CELL else 0 for line in lines))
    begins, width = {}, 0
    for x in sorted(widths):
        begins[x], width = width, width + widths[x] + 2
    for row in grid:
        left = sorted(row.items())
        i = 0
        while left:
            line = ""
            for x, lines in left:
                if width <= TABLE:
                    line = (line + "  " if line else "").ljust(begins[x]) + lines[i]
                else:
                    line += ("  " if line else "") + lines[i]
            out.put(line)
            i += 1
            left = [(x, lines) for x, lines in left if len(lines) > i]


def _walk(out: Lines, nodes: list) -> None:
    for node in nodes:
        if isinstance(node, str):
            out.text(node)
            continue
        if not displayed(node):
            continue
        outside, out.visible = out.visible, shown(node, out.visible)
        _element(out, node)
        out.visible = outside


def _element(out: Lines, node: Node) -> None:
    name = node.name
    if name == "br":
        if out.line or not out.visible:
            out.end()
        else:
            out.put("")
        return
    if name == "hr":
        out.gap()
        return
    if name == "q":
        out.text("“")
        _walk(out, node.children)
        out.space = False
        out.text("”")
        return
    if name not in BLOCK:
        if name in ("td", "th"):
            out.space = True
        _walk(out, node.children)
        return
    nested = name in ("ul", "ol", "menu", "dir") and bool(out.marker or out.indent)
    (out.gap if name in SPACED and not nested else out.end)()
    if name == "table":
        _table(out, node)
    elif name == "pre":
        _pre(out, node)
    elif name in ("ul", "ol", "menu", "dir"):
        _list(out, node)
    elif name in ("blockquote", "dd"):
        own, out.indent = out.indent, out.indent + " " * len(out.marker) + "  "
        held, out.marker = out.marker, ""
        _walk(out, node.children)
        out.end()
        out.indent, out.marker = own, held
    elif name == "details" and "open" not in node.props:
        _walk(out, [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1])
    else:
        _walk(out, node.children)
    (out.gap if name in SPACED and not nested else out.end)()


def _list(out: Lines, node: Node) -> None:
    if out.marker.strip() and out.visible:  # an item that begins with a list: its marker has a line of its own
        out.put("")
    lowest, highest = -(1 << 31), (1 << 31) - 1
    own, held, number = out.indent, out.marker, _number(node.props, "start", lowest, highest, 1)
    out.indent, out.marker = own + " " * len(held), ""
    for child in node.children:
        if isinstance(child, str) or child.name != "li":
            _walk(out, [child])
        elif displayed(child):
            out.end()
            if node.name == "ol":
                number = _number(child.props, "value", lowest, highest, number)
                out.marker, number = f"{number}. ", number + 1
            else:
                out.marker = "- "
            outside, out.visible = out.visible, shown(child, out.visible)
            before = len(out.lines)
            _walk(out, child.children)
            out.end()
            out.blank = out.blank and len(out.lines) == before
            out.marker, out.visible = "", outside
    out.end()
    out.indent, out.marker = own, held


def _pre(out: Lines, node: Node) -> None:
    texts: list[str] = []
    stack = [(child, out.visible) for child in reversed(node.children)]
    while stack:
        child, visible = stack.pop()
        if isinstance(child, str):
            if visible:
                texts.append(child)
        elif child.name == "br":
            texts.append("\n")
        elif displayed(child):
            inside = shown(child, visible)
            stack.extend((c, inside) for c in reversed(child.children))
    text = "".join(texts).replace("\r\n", "\n").replace("\r", "\n")
    if text.strip() or out.visible:
        for line in text.removeprefix("\n").rstrip().split("\n"):
            out.put(line)


def render_lines(nodes: list, visible: bool = True) -> list[str]:
    out = Lines(visible)
    _walk(out, nodes)
    out.end()
    return out.lines


def render(html: str | None) -> str:
    """All visible text of a page, laid out. Null and empty pages give an empty text; broken markup is repaired, never refused.

    Visibility comes from elements, the ``hidden`` attribute and ``style`` attributes; rules of style sheets are not looked at.
    Time and memory are in proportion to the page: layout adds at most INDENT characters to a line and TABLE to a row.
    """
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    if not displayed(builder.root):
        return ""
    return "\n".join(render_lines(builder.root.children, shown(builder.root, True))).strip("\n")


def extract(pages: DataFrame, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in ``keep``, text, n_chars, n_lines for each row of ``pages``; other columns are not read.

    Null and empty html gives an empty text. Repeated rows and null keys come out as they are, an empty table gives an empty
    result. A kept column (or key) named as one of the result's is called ``page_`` and its name. A page is held whole in
    memory, one at a time, with its tree.
    """
    made = ("text", "n_chars", "n_lines")
    names = [f"page_{c}" if c in made else c for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, *made])

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{n}` {kinds[c]}" for n, c in zip(names, (key, *keep), strict=True))
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, (key, *keep), strict=True)], F.col(f"`{html}`").alias("_chronolex_html"))
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long, n_lines long")
