"""Visible text of HTML pages, laid out.

A tokenizer and a tree builder with implied tags turn markup into begin and end
events, so unclosed and misnested elements end where a browser would end them.
Text that no browser shows is left out. Blocks stand on lines of their own,
paragraphs, headings, lists and tables behind an empty line; list items have
their bullet or number and are indented by depth; cells of a table are aligned.

A page is handled by itself in the task that scans it, in one walk without
recursion.

Defined results
    null or empty html  empty text
    unclosed tag        ends with the page; what follows it is not text
    wide cells          a column is padded to ``WIDEST`` characters at most
    null page_id        kept as it is
    repeated rows       one row each
    empty table         no rows
    further columns     not read
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from trustlake.llm.common import slices

WIDEST = 60
SCHEMA = "page_id long, text string"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Content up to the end tag of the same name, without markup.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set(
    "head script style template noscript title iframe object audio video canvas svg math "
    "datalist select textarea noembed noframes map".split()
)
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCKS = PARAGRAPHS | set(
    "html body div section article aside header footer nav main address form fieldset legend "
    "figcaption hgroup details summary dialog menu li dt dd center caption search".split()
)
# An element that begins ends open ones of these kinds, up to an element of the last column.
_SCOPE = frozenset("html body table td th caption template button".split())
_LISTS = _SCOPE | {"ul", "ol", "menu", "dl"}
_CELLS = frozenset(["td", "th"])
_SECTIONS = frozenset(["thead", "tbody", "tfoot"])
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li", "p"]), _LISTS),
    "dt": (frozenset(["dt", "dd", "p"]), _LISTS),
    "dd": (frozenset(["dt", "dd", "p"]), _LISTS),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (_CELLS | {"caption", "p"}, frozenset(["tr", "table", "template"])),
    "th": (_CELLS | {"caption", "p"}, frozenset(["tr", "table", "template"])),
    "tr": (_CELLS | {"tr", "caption", "p"}, frozenset(["table", "template"])),
    **dict.fromkeys(
        _SECTIONS, (_CELLS | _SECTIONS | {"tr", "caption", "colgroup", "p"}, frozenset(["table", "template"]))
    ),
    "body": (frozenset(["head"]), frozenset()),
    **dict.fromkeys(BLOCKS - {"html", "body", "li", "dt", "dd"}, (frozenset(["p"]), _SCOPE)),
    "hr": (frozenset(["p"]), _SCOPE),
}
# Elements that make an open head end.
_NOT_HEAD = (BLOCKS | {"a", "span", "b", "i", "em", "strong", "img", "br", "hr"}) - {"html"}
# An end tag does not reach beyond these.
_WALLS = {"td": {"table"}, "th": {"table"}, "tr": {"table"}, "li": {"ul", "ol", "menu", "table"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)"""
    r"""(?P<attrs>(?:[^"'>]++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""", re.S
)
_INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Cell:
    lines: list[str]
    columns: int
    rows: int


@dataclass
class Flow:
    """Lines of a page or of a cell, and the line that is being filled."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    gap: int = 0
    margins: list[str] = field(default_factory=list)
    marker: str = ""

    def text(self, text: str, as_is: bool) -> None:
        if as_is:
            first, *rest = text.split("\n")
            self.line.append(first)
            for part in rest:
                self.end(empty=True)
                self.line.append(part)
            return
        text = _BLANK.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            text = text[1:]
        if text:
            self.line.append(text)

    def end(self, empty: bool = False) -> None:
        """End the line, if it holds anything or ``empty`` lines count."""
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if not text and not empty:
            return
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        margin = "".join(self.margins)
        if self.marker:
            margin = margin[: -len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((margin + text).rstrip(" "))

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def block_of(self, lines: list[str]) -> None:
        for line in lines:
            self.line.append(line)
            self.end(empty=True)

    def done(self) -> list[str]:
        self.end()
        return self.lines


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)

    def lines(self) -> list[str]:
        """Cells in columns, padded to the widest cell of the column."""
        taken: dict[int, int] = {}
        placed: list[list[tuple[int, Cell]]] = []
        for row in self.rows:
            at, line, held = 0, [], {c: n for c, n in taken.items() if n > 0}
            for cell in row:
                while held.get(at, 0):
                    at += 1
                line.append((at, cell))
                for c in range(at, at + cell.columns):
                    taken[c] = cell.rows
                at += cell.columns
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            placed.append(line)
        width: dict[int, int] = {}
        for line in placed:
            for at, cell in line:
                if cell.columns == 1:
                    widest = max(map(len, cell.lines), default=0)
                    width[at] = max(width.get(at, 0), min(widest, WIDEST))
        out = []
        for line in placed:
            for k in range(max((len(c.lines) for _, c in line), default=0)):
                text, edge = "", 0
                for at, cell in line:
                    left = sum(width.get(c, 0) + 3 for c in range(edge, at))
                    if edge:
                        text = text + " | "
                    text += " " * left + (cell.lines[k] if k < len(cell.lines) else "")
                    room = sum(width.get(c, 0) for c in range(at, at + cell.columns))
                    shown = len(cell.lines[k]) if k < len(cell.lines) else 0
                    text += " " * (room + 3 * (cell.columns - 1) - shown)
                    edge = at + cell.columns
                out.append(text.rstrip(" "))
        return out


def _number(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.isdecimal() and len(value) < 6 else 1


class Renderer:
    """Follows begin and end events and fills the flows."""

    def __init__(self) -> None:
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[int | None] = []
        self.open: list[tuple[str, dict[str, str]]] = []
        self.count: dict[str, int] = {}
        self.hidden = 0
        self.kept = 0  # open elements in which white space counts

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def begin(self, name: str, attrs: dict[str, str]) -> None:
        self._imply(name)
        hidden = (
            name in HIDDEN
            or "hidden" in attrs
            or (name == "input" and attrs.get("type", "").lower() == "hidden")
            or bool(_INVISIBLE.search(attrs.get("style", "")))
        )
        if name in VOID:
            if not self.hidden and not hidden:
                self._void(name)
            return
        self.open.append((name, {"hidden": ""} if hidden else attrs))
        self.count[name] = self.count.get(name, 0) + 1
        if self.hidden or hidden:
            self.hidden += hidden
            return
        self._show(name, attrs)

    def _imply(self, name: str) -> None:
        if name in _NOT_HEAD and self.count.get("head"):
            self._close_to("head")
        if name in ENDS:
            ended, walls = ENDS[name]
            if left := sum(self.count.get(n, 0) for n in ended):
                last = None
                for i in range(len(self.open) - 1, -1, -1):
                    if not left or self.open[i][0] in walls:
                        break
                    if self.open[i][0] in ended:
                        last, left = i, left - 1
                if last is not None:
                    self._pop(last)
        if name in _CELLS and self.tables and not self._inside("tr"):
            self.begin("tr", {})

    def _inside(self, name: str) -> bool:
        for open_name, _ in reversed(self.open):
            if open_name == name:
                return True
            if open_name == "table":
                return False
        return False

    def _void(self, name: str) -> None:
        if name == "br":
            self.flow.end(empty=True)
        elif name == "hr":
            self.flow.block(1)

    def _show(self, name: str, attrs: dict[str, str]) -> None:
        if name in PARAGRAPHS:
            nested = name in ("ul", "ol") and bool(self.lists)
            self.flow.block(1 if nested else 2)
        elif name in BLOCKS:
            self.flow.block(1)
        if name in ("ul", "menu"):
            self.lists.append(None)
        elif name == "ol":
            self.lists.append(_number(attrs.get("start"), 99_999))
        elif name == "li":
            kind = self.lists[-1] if self.lists else None
            marker = "- " if kind is None else f"{kind}. "
            if kind is not None:
                self.lists[-1] = kind + 1
            self.flow.margins.append(" " * len(marker))
            self.flow.marker = marker
        elif name in ("dd", "blockquote"):
            self.flow.margins.append("  ")
        elif name == "pre":
            self.kept += 1
        elif name == "table":
            self.tables.append(Table())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in _CELLS and self.tables:
            self.flows.append(Flow())

    def _hide(self, name: str, attrs: dict[str, str]) -> None:
        """The end of an element that was shown."""
        if name in _CELLS and self.tables and len(self.flows) > 1:
            cell = Cell(
                self.flows.pop().done(),
                _number(attrs.get("colspan"), 100),
                _number(attrs.get("rowspan"), 1000),
            )
            if self.tables[-1].rows:
                self.tables[-1].rows[-1].append(cell)
        elif name == "table" and self.tables:
            self.flow.block_of(self.tables.pop().lines())
        elif name in ("ul", "ol", "menu") and self.lists:
            self.lists.pop()
        elif name in ("li", "dd", "blockquote") and self.flow.margins:
            self.flow.end(empty=bool(self.flow.marker))
            self.flow.margins.pop()
            self.flow.marker = ""
        elif name == "pre":
            self.kept -= 1
        if name in PARAGRAPHS:
            nested = name in ("ul", "ol") and bool(self.lists)
            self.flow.block(1 if nested else 2)
        elif name in BLOCKS:
            self.flow.block(1)

    def _pop(self, index: int) -> None:
        while len(self.open) > index:
            name, attrs = self.open.pop()
            self.count[name] -= 1
            if "hidden" in attrs:
                self.hidden -= 1
            elif not self.hidden:
                self._hide(name, attrs)

    def _close_to(self, name: str) -> None:
        walls = _WALLS.get(name, ())
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self._pop(i)
                return
            if self.open[i][0] in walls:
                return

    def finish(self, name: str) -> None:
        if self.count.get(name):
            self._close_to(name)
        elif name == "p" and not self.hidden:
            self.flow.block(2)
        elif name == "br" and not self.hidden:
            self.flow.end(empty=True)

    def text(self, text: str) -> None:
        if self.count.get("head") and self.open[-1][0] == "head" and text.strip():
            self._close_to("head")
        # Between rows and cells only what is in a cell is shown in the table.
        if not self.hidden:
            self.flow.text(text, bool(self.kept))

    def result(self) -> str:
        self._pop(0)
        lines = self.flows[0].done()
        return "\n".join(lines).strip("\n")


def extract(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    out, at = Renderer(), 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            out.text(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["end"]:
            out.finish(name)
            continue
        attrs = {}
        for a, *values in _ATTRIBUTE.findall(m["attrs"]):
            attrs.setdefault(a.lower(), entities.unescape("".join(values)))
        out.begin(name, attrs)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            out.finish(name)
            at = close.end() if close else len(page)
    if at < len(page):
        out.text(entities.unescape(page[at:]))
    return out.result()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [extract(h) for h in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"]
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page."""
    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(_extract, SCHEMA)
