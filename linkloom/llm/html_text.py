"""Visible text of HTML pages by layout.

A tokenizer reads tags, attributes, comments and raw-text elements; a tree builder supplies the end tags that HTML lets
authors leave out; visibility rules drop what a browser would not paint; a renderer lays out the rest: blocks on lines
of their own with blank lines where browsers leave margins, list items with their markers and indents, preformatted text
as it is, and tables with their cells aligned in columns.

What may not stand in a table goes before it, and rows and cells leave whatever else they stand in, as in browsers.

Rows: a null page gives a null text, an empty one an empty text; broken markup never fails; nesting of any depth is
walked without recursion; repeated rows are rendered alike; an empty table gives an empty result; other columns of any
name are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_CONCEALED = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas svg datalist param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Blocks with a margin: a blank line before and after.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
LISTS = frozenset("ul ol menu dir".split())
#: What a start tag ends if it is open, and the elements that shield it.
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("thead", "tbody", "tfoot"))
IMPLIED = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr"} | _CELLS, {"table"}), "td": (_CELLS, {"table", "tr"}), "th": (_CELLS, {"table", "tr"}), "thead": (_ROWS | {"tr"} | _CELLS, {"table"}), "tbody": (_ROWS | {"tr"} | _CELLS, {"table"}), "tfoot": (_ROWS | {"tr"} | _CELLS, {"table"}), "body": ({"head"}, {"html"})}
_ENDS_P = BLOCK - {"body", "html", "li", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "legend", "summary", "figcaption"} | {"hr"}
_SHIELDS_P = frozenset("button table td th caption object".split())
#: What may stand in a head; anything else, and text, ends it.
_IN_HEAD = frozenset("base link meta noframes noscript script style template title".split())
#: Elements of which only the first child is painted, in formulas.
_ONE_CHILD = frozenset(("semantics", "maction"))
#: What a table holds outside its cells and captions; what may stand there; and what else a part of a table leaves for its place.
_FRAME = _ROWS | {"table", "tr", "colgroup"}
_PARTS = _ROWS | _CELLS | {"tr", "caption", "colgroup", "col"}
_IN_FRAME = _PARTS | {"script", "style", "template"}
_PLACES = {"td": _ROWS | {"table", "tr"}, "th": _ROWS | {"table", "tr"}, "tr": _ROWS | {"table"}, "col": {"table", "colgroup"}}
_WHITE = " \t\r\n\f"


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def build(page: str) -> Node:
    root = Node("html", {})
    stack, at = [root], 0

    def close(tags, shields) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in shields or stack[k].tag == "template":
                return

    def close_all(tags, shields) -> None:
        n = 0
        while n != len(stack):
            n = len(stack)
            close(tags, shields)

    def end_head() -> None:
        if stack[-1].tag == "head":
            stack.pop()

    def open_table() -> int:
        """The place of the innermost table that no cell or template inside it shields, or 0."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "table":
                return k
            if stack[k].tag in _CELLS or stack[k].tag == "template":
                return 0
        return 0

    def place(x) -> None:
        if stack[-1].tag in _FRAME and (x.strip(_WHITE) if isinstance(x, str) else x.tag not in _IN_FRAME) and (k := open_table()):
            stack[k - 1].children.insert(-1, x)  # an open table is the last of its parent
        else:
            stack[-1].children.append(x)

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            text = html.unescape(text)
            if text.strip(_WHITE):
                end_head()
            place(text)
        if not m:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                end_head()
                place(Node("br", {}))
            elif name == "p" and not any(x.tag == "p" for x in stack):
                place(Node("p", {}))
            elif name not in ("html", "body"):
                close({name}, _SHIELDS_P if name not in _SHIELDS_P and name not in ("tr", "thead", "tbody", "tfoot", "template") else ())
        elif m[2]:
            name = m[2].lower()
            if name in ("html", "body") and name != "body":
                continue
            if name not in _IN_HEAD:
                end_head()
            if name in _ENDS_P:
                close({"p"}, _SHIELDS_P)
            if name in IMPLIED:
                close_all(*IMPLIED[name])
            if name in _PARTS and (k := open_table()):
                while stack[-1].tag not in _PLACES.get(name, ("table",)):
                    stack.pop()
            elif name == "table" and (k := open_table()) and not any(x.tag == "caption" for x in stack[k:]):
                del stack[k:]
            elif name == "form" and stack[-1].tag in _FRAME:
                continue
            attributes = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(m[3] or "")}
            node = Node(name, attributes)
            formula = (name == "mphantom" or stack[-1].tag in _ONE_CHILD) and any(x.tag == "math" for x in stack)
            if formula and (name == "mphantom" or any(isinstance(x, Node) for x in stack[-1].children)):
                attributes["hidden"] = ""
            place(node)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                inner = page[at : end.start() if end else len(page)]
                node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
                at = end.end() if end else len(page)
            elif name not in VOID and not (formula and m[3].endswith("/")):
                stack.append(node)
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _CONCEALED.search(a["style"]))


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under way: text gathers in a line, and gaps between blocks merge into the largest."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.marker = "", 0, "", ""

    def end_line(self) -> None:
        text = self.line.rstrip(" ")
        if text or self.marker:
            if self.lines:
                self.lines.extend([""] * self.gap)
            head = self.indent
            if self.marker:
                head = self.indent[: len(self.indent) - len(self.marker)] + self.marker
            self.lines.append((head + text).rstrip(" "))
            self.gap, self.marker = 0, ""
        self.line = ""

    def block(self, gap: int) -> None:
        if self.line.strip(" ") or gap == 0:
            marker = self.marker
            if not self.line.strip(" "):
                self.marker = ""
            self.end_line()
            if marker and not self.marker and not self.lines:
                self.marker = marker
            elif marker and self.lines and not self.lines[-1].strip().startswith(marker.strip()):
                self.marker = marker
        if not self.marker:
            self.gap = max(self.gap, gap)

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def verbatim(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append((self.indent + line).rstrip())


def _rows(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """(cells of each row, captions) of a table, without those of tables inside."""
    rows, captions, todo = [], [], list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or not visible(x):
            continue
        if x.tag == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and c.tag in _CELLS and visible(c)])
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag in _CELLS:
            rows.append([x])
        elif x.tag in _ROWS:
            todo.extend(reversed(x.children))
    return rows, captions


def _span(cell: Node) -> int:
    n = cell.attributes.get("colspan", "1")
    return min(max(int(n), 1), 1000) if n.isdecimal() and len(n) < 6 else 1


#: Tables inside tables deeper than this are laid out as blocks.
DEPTH = 20


def _lay_table(page: Page, table: Node, depth: int) -> None:
    rows, captions = _rows(table)
    for c in captions:
        page.block(1)
        for line in render(c, depth + 1).split("\n"):
            page.verbatim(line)
    cells = [[(render(c, depth + 1).split("\n"), _span(c)) for c in row] for row in rows]
    widths: list[int] = []
    for row in cells:
        at = 0
        for lines, span in row:
            widths.extend([0] * (at + span - len(widths)))
            if span == 1:
                widths[at] = max(widths[at], max(map(width, lines)))
            at += span
    for row in cells:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            out, at = [], 0
            for lines, span in row:
                text = lines[k] if k < len(lines) else ""
                room = sum(widths[at : at + span]) + 3 * (span - 1)
                out.append(text + " " * max(0, room - width(text)))
                at += span
            page.verbatim(" | ".join(out))


def render(root: Node, depth: int = 0) -> str:
    page, numbers, quotes = Page(), [], [0]
    # (node or text, preformatted, list depth) or a function to call on the way out
    todo: list = [(x, False) for x in reversed(root.children)]
    while todo:
        step = todo.pop()
        if callable(step):
            step()
            continue
        x, pre = step
        if isinstance(x, str):
            if not pre:
                page.inline(x)
            else:
                first, *rest = x.replace("\r\n", "\n").split("\n")
                page.line += first
                for line in rest:
                    page.verbatim(page.line)
                    page.line = line
            continue
        if not visible(x):
            continue
        tag = x.tag
        if tag == "br":
            if page.line.strip(" ") or page.marker:
                page.end_line()
            elif page.lines:
                page.gap = max(page.gap, 1)
            continue
        if tag == "hr":
            page.block(0)
            page.verbatim("---")
            continue
        if tag == "img":
            if x.attributes.get("alt", "").strip():
                page.inline(x.attributes["alt"])
            continue
        if tag == "input":
            if x.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") and x.attributes.get("value"):
                page.inline(x.attributes["value"])
            continue
        if tag == "table" and depth < DEPTH:
            page.block(1)
            _lay_table(page, x, depth)
            page.block(1)
            continue
        if tag not in BLOCK:
            todo.extend((c, pre) for c in reversed(x.children))
            continue
        nested = tag in LISTS and bool(numbers)
        gap = 1 if tag in SPACED and not nested else 0
        page.block(gap)
        before = page.indent
        if tag in LISTS:
            start = x.attributes.get("start", "1")
            numbers.append([tag == "ol", int(start) if start.isdecimal() and len(start) < 9 else 1])
        elif tag == "li":
            kind = numbers[-1] if numbers else [False, 1]
            page.marker = f"{kind[1]}. " if kind[0] else "- "
            kind[1] += 1
            page.indent += " " * len(page.marker)
        elif tag == "dd":
            page.indent += "    "
        elif tag == "blockquote":
            page.indent += "> "

        def leave(tag=tag, gap=gap, before=before, preformatted=tag == "pre") -> None:
            if preformatted and page.line:
                page.verbatim(page.line)
                page.line = ""
            page.end_line()
            if not page.marker:
                page.gap = max(page.gap, gap)
            page.indent, page.marker = before, ""
            if tag in LISTS:
                numbers.pop()

        todo.append(leave)
        children = x.children
        if tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        todo.extend((c, pre or tag == "pre") for c in reversed(children))
    page.end_line()
    return "\n".join(page.lines).replace("\xa0", " ")


def text_of(page: str | None) -> str | None:
    return None if page is None else render(build(page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x) for x in batch.column(1).to_pylist()]
            lines = [None if t is None else t.count("\n") + bool(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, text string, n_lines long")
