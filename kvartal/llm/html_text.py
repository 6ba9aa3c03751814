"""Visible text of web pages, laid out as a reader sees it."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<slash>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
HIDING = re.compile(r"display\s*:\s*none", re.I)
# The last one of a style counts; it holds for all below that say nothing else.
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)", re.I)
INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,18})")
SPACE = re.compile(r"[ \t\n\r\f]+")
SPAN = re.compile(r"[ \t\n\r\f]*\+?([0-9]+)")

# Element classes of HTML.
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset(
    "script style title iframe noembed noframes noscript template head datalist audio video canvas object svg math".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset hr".split())
# Anything else, and text that is not blank, ends an open head.
HEAD = frozenset("base basefont bgsound link meta script style title noscript noframes template".split())
BLOCK = SPACED | frozenset(
    "html body div section article header footer nav aside main address li dt dd tr td th thead tbody tfoot "
    "caption details summary figcaption legend dialog center option optgroup menu".split()
)
# An opening tag closes the nearest of these, unless one of the bounds lies between.
LISTS, ROWS = frozenset(("ul", "ol", "menu")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th", "caption")), ROWS | {"tr"}),
    "th": (frozenset(("td", "th", "caption")), ROWS | {"tr"}),
    "tr": (frozenset(("tr", "caption")), ROWS),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption")), ROWS),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption")), ROWS),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption")), ROWS),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
KEEPS_P = frozenset(("td", "th", "caption", "button", "table"))
PARAGRAPH = (frozenset(("p",)), KEEPS_P)
LINK = (frozenset(("a",)), BLOCK | KEEPS_P | UNSEEN)
CELLS = frozenset(("td", "th"))
# The most columns and rows that HTML lets a cell span.
COLUMNS, DOWN = 1000, 65534
# A line longer than this runs on into the next column instead of padding its own in all rows.
WIDE = 200
# These outlive a link that is closed around them.
FORMATTING = frozenset("b big code em font i nobr s small strike strong tt u".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "nests")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.nests = False  # is a cell that holds a table

    def attributes(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(self.attrs))}


def parse(page: str) -> Element:
    """Element tree of any depth. Open elements are closed as the rules imply."""
    root = Element("html")
    stack, at = [root], 0
    opened: dict[str, list[int]] = defaultdict(list)  # tag -> places in the stack, so that no close searches it

    def push(element: Element) -> None:
        opened[element.tag].append(len(stack))
        stack.append(element)

    def cut(start: int) -> None:
        while len(stack) > start:
            opened[stack.pop().tag].pop()

    def nearest(tags: frozenset) -> int:
        place = 0
        for tag in tags:
            if (places := opened.get(tag)) and places[-1] > place:
                place = places[-1]
        return place

    def close(tags: frozenset, bounds: frozenset) -> None:
        if (start := nearest(tags)) and start >= nearest(bounds):
            cut(start)

    def put(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            cut(len(stack) - 1)
        stack[-1].children.append(text)

    while found := TOKEN.search(page, at):
        if found.start() > at:
            put(unescape(page[at : found.start()]))
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                put(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if stack[-1].tag == "head" and (tag not in HEAD if not found["slash"] else tag == "br"):
            cut(len(stack) - 1)
        if found["slash"]:
            if tag == "br":
                stack[-1].children.append(Element("br"))
            else:
                close(frozenset((tag,)), frozenset(("table",)) - {tag} if tag in BLOCK else KEEPS_P)
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag in BLOCK:
            close(*PARAGRAPH)
        elif tag == "a" and opened["a"]:
            if all(visible(x) for x in stack[opened["a"][-1] + 1 :] if x.tag in FORMATTING):
                close(*LINK)
        element = Element(tag, found["attrs"])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            if tag == "textarea" or tag == "xmp":
                # The line break that opens a textarea is none of its text.
                element.children.append(re.sub(r"\A(?:\r\n?|\n)", "", unescape(inner)) if tag == "textarea" else inner)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            push(element)
            if tag == "table":
                if cell := nearest(CELLS):
                    stack[cell].nests = True
                if row := opened["tr"]:
                    stack[row[-1] + 1].nests = True
    if at < len(page):
        put(unescape(page[at:]))
    return root


def visible(element: Element) -> bool:
    if element.tag in UNSEEN:
        return False
    if not element.attrs:
        return element.tag != "dialog"
    attrs = element.attributes()
    if "hidden" in attrs or HIDING.search(attrs.get("style", "")):
        return False
    return not (element.tag == "input" and attrs.get("type", "").lower() == "hidden") and not (
        element.tag == "dialog" and "open" not in attrs
    )


def hides(element: Element, hidden: bool) -> bool:
    """Whether text right inside isn't shown: the element says so, or what is around it does."""
    if "visibility" not in element.attrs.lower():
        return hidden
    found = VISIBILITY.findall(element.attributes().get("style", ""))
    return found[-1].lower() != "visible" if found else hidden


def _integer(element: Element, name: str) -> int | None:
    found = INTEGER.match(element.attributes().get(name, "")) if element.attrs else None
    return int(found[1]) if found else None


Work = Iterator["Work"]


class Layout:
    """Lines of text. Blank lines asked for by neighbours are shared, and none come first or last.

    What goes down the tree is a generator of the work below it, for ``run``. Hidden text takes
    no room, but what is visible inside it is shown.
    """

    def __init__(self):
        self.lines, self.blank, self.indent, self.mark = [], False, "", ""
        self.begin()

    def begin(self, line: str = "") -> None:
        """A new line. It is kept in pieces, so that a long one is joined once."""
        self.pieces, self.open = [line], not line or line.endswith(" ")

    def add(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            self.open = text.endswith(" ")

    def text(self, text: str, kept: bool = False) -> None:
        if kept:
            first, *rest = text.split("\n")
            self.add(first)
            for part in rest:
                self.end(force=True)
                self.begin(part)
            return
        text = SPACE.sub(" ", text)
        self.add(text.lstrip(" ") if self.open else text)

    def end(self, force: bool = False) -> None:
        line = "".join(self.pieces).rstrip(" ")
        self.begin()
        if not line and not force:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if self.mark:
            line, self.mark = self.indent[: -len(self.mark)] + self.mark + line, ""
        elif line:
            line = self.indent + line
        self.lines.append(line)

    def block(self, spaced: bool) -> None:
        self.end()
        self.blank = self.blank or (spaced and bool(self.lines))

    def element(self, node: Element, kept: bool = False, hidden: bool = False) -> Work:
        tag = node.tag
        if not visible(node):
            return
        hidden = hides(node, hidden)
        if tag == "br":
            if not hidden:
                self.end(force=True)
            return
        if tag == "table":
            yield self.table(node, hidden)
            return
        is_block = tag in BLOCK
        if is_block:
            self.block(tag in SPACED and not (tag in LISTS and self.indent))
        if tag in LISTS:
            yield self.list(node, hidden)
        else:
            held = self.indent
            if tag in ("blockquote", "dd"):
                self.indent += "    "
            folded = tag == "details" and "open" not in node.attributes()
            children = [c for c in node.children if not folded or getattr(c, "tag", "") == "summary"]
            yield self.inside(children, kept or tag in ("pre", "textarea"), hidden)
            if is_block:
                self.end()
            self.indent = held
        if is_block:
            self.block(tag in SPACED and not (tag in LISTS and self.indent))

    def inside(self, children: list, kept: bool = False, hidden: bool = False) -> Work:
        for child in children:
            if not isinstance(child, str):
                yield self.element(child, kept, hidden)
            elif not hidden:
                self.text(child, kept)

    def list(self, node: Element, hidden: bool = False) -> Work:
        """Items with marks. An ``ol`` counts from ``start``, down if ``reversed``; an item's ``value`` resets it."""
        held, step = self.indent, 1
        number = _integer(node, "start")
        if node.tag == "ol" and "reversed" in node.attributes():
            step = -1
            if number is None:
                number = sum(not isinstance(c, str) and c.tag == "li" and visible(c) for c in node.children)
        number = 1 if number is None else number
        for child in node.children:
            if isinstance(child, str) or child.tag != "li":
                yield self.inside([child], False, hidden)
                continue
            if not visible(child):
                continue
            self.end()
            if node.tag == "ol" and (value := _integer(child, "value")) is not None:
                number = value
            unseen = hides(child, hidden)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += step
            self.indent, self.mark = held + " " * len(mark), "" if unseen else mark
            yield self.inside(child.children, False, unseen)
            self.end()
            self.mark, self.indent = "", held

    def table(self, node: Element, hidden: bool = False) -> Work:
        """Rows as lines, cells padded to their column's width, cells of several lines side by side.

        The cells of a row come one below the other if one of them holds a table or blank lines.
        """
        rows, other, taken = [], [], {}
        for part in node.children:
            unseen = hidden if isinstance(part, str) else hides(part, hidden)
            grouped = not isinstance(part, str) and part.tag in ("thead", "tbody", "tfoot") and visible(part)
            if grouped:
                taken = {}
            for row in part.children if grouped else [part]:
                if isinstance(row, str):
                    if row.strip():
                        other.append((row, unseen))
                elif row.tag == "tr" and visible(row):
                    own = hides(row, unseen)
                    rows.append(placed([c for c in row.children if not isinstance(c, str) and visible(c)], len(rows), taken, own))
                    other += [(c, own) for c in row.children if isinstance(c, str) and c.strip()]
                elif row.tag in CELLS and visible(row):
                    rows.append(placed([row], len(rows), taken, unseen))
                elif row.tag != "tr":
                    other.append((row, unseen))
            if grouped:
                taken = {}
        self.block(True)
        for child, own in other:  # captions, and text that stands outside cells
            yield self.inside([child], False, own)
        self.end()
        aligned = []
        for row in rows:
            nests = any(c.node.nests for c in row)
            for cell in row if not nests else ():
                yield cell.lay_out()
            aligned.append(not nests and not any("" in c.lines[1:] for c in row))
        columns, offsets = _columns([r for r, in_line in zip(rows, aligned) if in_line])
        for row, in_line in zip(rows, aligned):
            if in_line:
                for i in range(max((len(c.lines) for c in row), default=0)):
                    line = ""
                    for cell in row:
                        if offset := offsets[columns[cell.start]]:
                            line = (line + "  ").ljust(offset)
                        line += cell.lines[i] if i < len(cell.lines) else ""
                    self.begin(line)
                    self.end()
                continue
            for cell in row:
                self.block(True)
                if cell.lines:
                    for line in cell.lines:
                        self.begin(line)
                        self.end(force=len(cell.lines) > 1)
                else:
                    yield self.inside(cell.node.children if cell.node.tag in CELLS else [cell.node], False, cell.hidden)
                self.block(True)
        self.block(True)


class Cell:
    """A table cell from column ``start`` to before ``stop``."""

    __slots__ = ("node", "start", "stop", "hidden", "lines")

    def __init__(self, node: Element, start: int, stop: int, hidden: bool):
        self.node, self.start, self.stop, self.hidden, self.lines = node, start, stop, hides(node, hidden), []

    def lay_out(self) -> Work:
        inner = Layout()
        yield inner.inside(self.node.children, False, self.hidden)
        inner.end()
        lines = [x if x.strip() else "" for x in inner.lines]
        while lines and not lines[-1]:
            lines.pop()
        first = next((i for i, x in enumerate(lines) if x), 0)
        self.lines = lines[first:] if len(lines) > first + 1 else [x.strip() for x in lines[first:]] or [""]

    def width(self) -> int:
        return max((len(x) for x in self.lines if len(x) <= WIDE), default=0)


def _span(node: Element, name: str, most: int) -> int:
    if "span" not in node.attrs.lower() or node.tag not in CELLS:
        return 1
    found = SPAN.match(node.attributes().get(name, ""))
    return min(int(found[1][:9]), most) if found else 1


def placed(nodes: list[Element], row: int, taken: dict[int, float], hidden: bool = False) -> list[Cell]:
    """The cells of a row in their columns. ``taken``: column -> the first row that has it free again."""
    cells, at = [], 0
    for node in nodes:
        while taken.get(at, 0) > row:
            at += 1
        stop, down = at + (_span(node, "colspan", COLUMNS) or 1), _span(node, "rowspan", DOWN)
        cells.append(Cell(node, at, stop, hidden))
        if down != 1:  # 0 is the rest of the group
            taken.update(dict.fromkeys(range(at, stop), row + down if down else float("inf")))
        at = stop
    return cells


def _columns(rows: list[list[Cell]]) -> tuple[dict[int, int], list[int]]:
    """The columns in which a cell starts, numbered, and the place in the line where each begins."""
    starts = sorted({c.start for row in rows for c in row})
    number = {c: i for i, c in enumerate(starts)}
    widths, wider = [0] * len(starts), []
    for row in rows:
        for cell in row:
            first, stop = number[cell.start], bisect_left(starts, cell.stop)
            if stop == first + 1:
                widths[first] = max(widths[first], cell.width())
            elif cell is not row[-1]:
                wider.append((first, stop, cell.width()))
    for first, stop, width in wider:
        widths[stop - 1] += max(0, width - sum(widths[first:stop]) - 2 * (stop - first - 1))
    offsets = [0]
    for width in widths:
        offsets.append(offsets[-1] + width + 2)
    return number, offsets


def run(work: Work) -> None:
    """Do the work, and what it yields before it goes on, without recursion."""
    open_work = [work]
    while open_work:
        for below in open_work[-1]:
            open_work.append(below)
            break
        else:
            open_work.pop()


def extract(page: str) -> str:
    layout = Layout()
    run(layout.inside(parse(page).children))
    layout.end()
    while layout.lines and not layout.lines[-1]:
        layout.lines.pop()
    return "\n".join(layout.lines)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p or "") for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines, text_sha256 for every page.

    Each page is laid out by itself; nothing is shuffled. A null or empty page has an empty text
    of no lines; markup that is cut off is read to its end; rows that repeat are each laid
    out; an empty table gives no rows. Only page_id and html are read.
    """
    kind = dict(pages.dtypes)["page_id"]
    texts = pages.select("page_id", "html").mapInArrow(_extracted, f"page_id {kind}, text string")
    return texts.select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )
