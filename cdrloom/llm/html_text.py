"""Layout-aware rendering of HTML to plain text.

A tree builder reads tags with the implied ones (a paragraph ends before a
block, an item before the next item, a cell opens its row, and so on). The
renderer walks the tree without recursion and emits all visible text: blocks
start on lines of their own, paragraphs and headings stand between blank lines,
list items get bullets or numbers and a hanging indent, table cells are aligned
in columns, preformatted text keeps its line breaks.

Invisible are the elements in ``HIDDEN``, elements with a ``hidden`` attribute
and those whose inline style says ``display:none`` or ``visibility:hidden``.
Scripting is off, so ``noscript`` is visible; closed ``details`` count as visible.

Defined cases: null and empty pages give an empty text; broken markup never
fails (an unclosed tag at the end is text, stray end tags are ignored); repeated
rows give equal texts; extra columns are dropped before the work.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import in_arrow, keyed, text_slices

FOREIGN = frozenset({"svg", "math"})  # where a start tag may end itself
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template title iframe object audio video canvas svg math datalist".split())
RAW = frozenset("script style textarea title xmp iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header "
    "hgroup hr html legend li main menu nav ol p pre section summary table ul caption".split()
)
#: Blocks with a blank line before and behind.
SPACED = HEADINGS | frozenset("p ul ol dl pre blockquote table figure".split())
#: Start tags that end an open element of the set, up to a boundary element.
CLOSES = {
    **{t: (frozenset({"p"}), frozenset({"td", "th", "table", "caption"})) for t in BLOCKS - {"html", "body", "caption", "legend"}},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu", "dir", "td", "th"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "td", "th"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl", "td", "th"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "p", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p", "caption"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "p", "caption"}), frozenset({"table", "tr"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset({"head"}), frozenset()),
}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
#: Elements that may stand in a head; any other start tag ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Characters up to which cells of a column are padded; longer lines stand as they are.
PADDED = 120
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class Stack(list):
    """Open elements, with the number of open ones per tag."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.open[node.tag] += 1
        self.append(node)

    def cut(self, k: int) -> None:
        self.open.subtract(node.tag for node in self[k:])
        del self[k:]

    def holds(self, tags: frozenset[str]) -> bool:
        return any(self.open[t] > 0 for t in tags)


def build(page: str) -> Node:
    """Tree of a page; children are nodes and strings with entities resolved."""
    root = Node("", {})
    stack = Stack(root)
    at, last = 0, page.rfind(">")

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and raw.strip():
                stack.cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(raw))

    while at < len(page):
        sign = page.find("<", at)
        if sign < 0 or sign > last:
            text(page[at:])
            break
        text(page[at:sign])
        if page.startswith("<!--", sign):
            stop = page.find("-->", sign + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), sign):
            at = page.find(">", sign) + 1
            continue
        found = TAG.match(page, sign)
        if not found:
            text("<")
            at = sign + 1
            continue
        at = found.end()
        end, tag, rest = found[1], found[2].lower(), found[3]
        if end:
            _close(stack, tag)
            continue
        if stack[-1].tag == "head" and tag not in HEAD_CONTENT:
            stack.cut(len(stack) - 1)
        _imply(stack, tag)
        node = Node(tag, {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            raw = page[at:stop.start() if stop else len(page)]
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = len(page) if not stop else page.find(">", stop.start()) + 1 or len(page)
        elif tag not in VOID and not (rest.endswith("/") and (tag in FOREIGN or stack.holds(FOREIGN))):
            stack.push(node)
    return root


def _imply(stack: Stack, tag: str) -> None:
    """Close what the start tag ends; open the row a cell needs."""
    if tag in CLOSES and stack.holds(CLOSES[tag][0]):
        ends, stops = CLOSES[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                break
            if stack[k].tag in ends:
                stack.cut(k)
                if tag not in ("tr", "td", "th", "thead", "tbody", "tfoot", "li", "dt", "dd"):
                    break
            elif stack[k].tag in BLOCKS and tag not in ("li", "dt", "dd", "tr", "td", "th"):
                break
    if tag in HEADINGS and stack[-1].tag in HEADINGS:
        stack.cut(len(stack) - 1)
    if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
        row = Node("tr", {})
        stack[-1].children.append(row)
        stack.push(row)


def _close(stack: Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    if stack.open[tag] <= 0:
        return
    stops = {"table"} if tag in ("tr", "td", "th", "thead", "tbody", "tfoot") else {"td", "th", "caption"} if tag != "table" else set()
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            stack.cut(k)
            return
        if stack[k].tag in stops:
            return


class Flow:
    """Lines of text with collapsed blanks and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.blank, self.gap = False, 0

    def add(self, raw: str, keep: bool) -> None:
        if keep:
            first, *more = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in more:
                self.line(True)
                self._put(line)
            return
        parts = BLANKS.split(raw)
        for k, word in enumerate(parts):
            if k:
                self.blank = True
            if word:
                self._put((" " if self.blank and self.words else "") + word)
                self.blank = False

    def _put(self, piece: str) -> None:
        if not piece:
            return
        if self.gap and not self.words:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
        self.words.append(piece)

    def line(self, forced: bool = False) -> None:
        """End the line; ``forced``: also an empty one."""
        if self.words or forced:
            if not self.words and self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
                self.gap = 0
            self.lines.append("".join(self.words).rstrip(" "))
        self.words, self.blank = [], False

    def block(self, gap: int) -> None:
        """End the line and ask for a margin: 1, a new line; 2, a blank line."""
        self.line()
        self.gap = max(self.gap, gap)

    def put_lines(self, lines: list[str], gap: int) -> None:
        if not lines:
            return
        self.block(gap)
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.lines += lines
        self.gap = gap

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def _visible(node: Node) -> bool:
    own = node.attributes
    return node.tag not in HIDDEN and "hidden" not in own and not UNSEEN.search(own.get("style", ""))


def _grid(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of cells (lines, columns spanned) as lines with aligned columns."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *(min(PADDED, len(line)) for line in lines)])
            at += span
    out = []
    for row in rows:
        for k in range(max([0, *(len(lines) for lines, _ in row)])):
            line, at = "", 0
            for lines, span in row:
                width = sum(widths[at:at + span]) + 3 * (span - 1)
                line += ("" if not at else " | ") + (lines[k] if k < len(lines) else "").ljust(width)
                at += span
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """Visible text of a page."""
    if not page:
        return ""
    flows, tables, numbers = [Flow()], [], []
    preformatted = 0
    todo: list[tuple[str, Node | str]] = [("enter", build(page))]
    while todo:
        what, node = todo.pop()
        if isinstance(node, str):
            flows[-1].add(node, preformatted > 0)
            continue
        tag = node.tag
        gap = 2 if tag in SPACED else 1
        if what == "enter":
            if not _visible(node):
                continue
            if tag == "br":
                flows[-1].line(True)
            elif tag in ("tr", "td", "th") and tables:
                if tag == "tr" or not tables[-1]:
                    tables[-1].append([])
                if tag != "tr":
                    flows.append(Flow())
            elif tag == "table":
                tables.append([])
            elif tag in ("li", "dd", "blockquote"):
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                numbers.append(int(start) - 1 if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 0 if tag == "ol" else None)
                flows[-1].block(1 if len(numbers) > 1 else 2)
            elif tag in BLOCKS:
                flows[-1].block(gap)
            preformatted += tag in ("pre", "textarea", "xmp")
            todo.append(("exit", node))
            todo += [("enter", child) for child in reversed(node.children)]
            continue
        preformatted -= tag in ("pre", "textarea", "xmp")
        if tag in ("td", "th") and tables:
            span = node.attributes.get("colspan", "1")
            tables[-1][-1].append((flows.pop().done(), min(1000, max(1, int(span))) if re.fullmatch(r"\d{1,9}", span) else 1))
        elif tag == "table":
            flows[-1].put_lines(_grid([row for row in tables.pop() if row]), 2)
        elif tag in ("li", "dd", "blockquote"):
            lines = flows.pop().done()
            mark = "  "
            if tag == "li":
                mark = "- "
                if numbers and numbers[-1] is not None:
                    numbers[-1] += 1
                    mark = f"{numbers[-1]}. "
            indent = " " * len(mark)
            flows[-1].put_lines([(mark if not k else indent) + x if x else "" for k, x in enumerate(lines)], gap)
        elif tag in ("ul", "ol", "menu", "dir"):
            numbers.pop()
            flows[-1].block(1 if numbers else 2)
        elif tag in BLOCKS:
            flows[-1].block(gap)
    return "\n".join(flows[0].done()).replace("\xa0", " ")


def extract(df: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: id, text, n_chars, n_lines (lines with text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [render(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(map(bool, t.split("\n"))) for t in texts], pa.int64()),
                ], ["id", "text", "n_chars", "n_lines"])

    rows = keyed(df, id_column, html_column)
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, text string, n_chars long, n_lines long").withColumnRenamed("id", id_column)
