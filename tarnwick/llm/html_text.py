"""The visible text of HTML pages, laid out as a browser would set it in plain text.

A tokenizer reads tags, comments and raw text in one pass; a tree builder puts up the elements that
HTML lets authors leave out (end tags of paragraphs, list items, table parts and options; rows and
bodies of tables; the end of the head), moves what may not stand in a table before it, and closes what
stays open. Layout works from the leaves up: inline content flows into lines, blocks stand on lines of
their own, paragraphs and the like with an empty line around them, lists get markers and indents by
depth, table cells are aligned in columns, spans of rows and columns counted, preformatted text keeps
its white space. What is never shown (head, script, style, templates ...), hidden by attribute or
inline style, in a closed details or dialog element, and hidden inputs give nothing; a visible child of an
element with visibility: hidden is shown. Of a select element the chosen option shows, of a list box all.

Limits, which cost no text: elements nested more than DEPTH deep stand beside each other, as
browsers have it; a column's width counts up to CELL characters and cells are aligned up to LINE
characters, beyond which they follow each other; indents are drawn up to INDENT columns; and the blanks of indents and of alignment come to at most
BLANKS characters for each of the page, after which lines start at the margin and cells stand two spaces apart.

Defined results: null and empty pages have an empty text; pages of any length are read whole, in time
linear in their length, by loops and not by recursion; text without any tag is laid out as one flow;
broken markup never fails, and a tag that the page's end leaves open is dropped, as by browsers; repeated
rows are each extracted; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import arrow_rows

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object embed audio video canvas datalist meta link base param source track area map defs desc metadata symbol annotation annotation-xml rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary caption tr thead tbody tfoot td th".split()
)
HEAD = frozenset("meta link title style script base noscript template".split())
#: A start tag of the key ends open elements of the value, up to the nearest fence.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
#: Block starts that end an open paragraph.
CLOSE_P = BLOCKS - frozenset("html body tr thead tbody tfoot td th caption option optgroup".split())
P_FENCES = ("td", "th", "table", "caption", "button")
#: Parts of tables that hold no text themselves, and what may stand in them; the rest goes before the table.
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
#: The depth at which browsers stop nesting; the greatest colspan and rowspan of HTML.
DEPTH, MOST_COLUMNS, MOST_ROWS = 512, 1_000, 65_534
CELL, LINE, INDENT, BLANKS = 80, 1_000, 40, 3

TAG = re.compile(r"[^ \t\n\f\r/>]*")
NAME = re.compile(r"[ \t\n\f\r/]*([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)?[ \t\n\f\r]*")
BARE = re.compile(r"[^ \t\n\f\r>]*")
AFTER_EQUALS = re.compile(r"=[ \t\n\f\r]*")
WHITE = re.compile(r"[ \t\n\r\f]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Break:
    """A forced line break."""


class Nest:
    """Lines that stand behind a mark: what goes before the first line and before the others, and before empty ones of both.

    It takes the place of one line among others; prefixes are put together only when a page or a table is drawn, so that no line is written anew at
    each level.
    """

    __slots__ = ("lines", "first", "first_empty", "rest", "empty", "ends_empty")

    def __init__(self, lines: list, first: str, first_empty: str, rest: str, empty: str):
        self.lines, self.first, self.first_empty, self.rest, self.empty = lines, first, first_empty, rest, empty
        self.ends_empty = ends_empty(lines) and not (first_empty if len(lines) == 1 else empty)


def ends_empty(lines: list) -> bool:
    return lines[-1].ends_empty if isinstance(lines[-1], Nest) else lines[-1] == ""


def drawn(lines: list, blanks: list[int]) -> list[str]:
    """Lines as texts; blanks[0] is what is left for prefixes, but for those of first lines, which the page itself pays for."""
    out: list[str] = []
    # level: its lines, the place in them, and the four prefixes; a level's first ones hold until its first line
    stack = [[iter(lines), "", "", "", ""]]
    while stack:
        level = stack[-1]
        line = next(level[0], None)
        if line is None:
            stack.pop()
            continue
        first, first_empty, rest, empty = level[1:]
        level[1], level[2] = rest, empty
        if isinstance(line, Nest):
            stack.append([
                iter(line.lines), first + line.first, first + line.first_empty if line.first_empty else first_empty, (rest + line.rest)[:INDENT], (rest + line.empty)[:INDENT] if line.empty else empty,
            ])
            continue
        prefix = first if line else first_empty
        if first is rest and prefix:
            prefix = prefix if blanks[0] >= len(prefix) else ""
            blanks[0] -= len(prefix)
        out.append(prefix + line)
    return out


class Block:
    """Laid-out lines; gap: whether an empty line stands around them."""

    __slots__ = ("lines", "gap")

    def __init__(self, lines: list, gap: bool):
        self.lines, self.gap = lines, gap


class Pre(str):
    """Text that keeps its white space."""


class Cell:
    """A table cell: its lines, and over how many columns and rows it stands."""

    __slots__ = ("lines", "columns", "rows")

    def __init__(self, lines: list, columns: int, rows: int):
        self.lines, self.columns, self.rows = lines, columns, rows


def read_tag(source: str, at: int) -> tuple[str, dict[str, str], bool, int] | None:
    """Name, attributes, whether it closes itself, and end of the tag whose name begins at `at`; None if the page ends in it."""
    m = TAG.match(source, at)
    tag, at = m[0].lower(), m.end()
    attrs: dict[str, str] = {}
    while True:
        m = NAME.match(source, at)
        at = m.end()
        if at >= len(source):
            return None
        name = m[1]
        if name is None:
            if source[at] == ">":
                return tag, attrs, source[at - 1] == "/", at + 1
            continue
        value = ""
        if source[at] == "=":
            at = AFTER_EQUALS.match(source, at).end()
            quote = source[at : at + 1]
            if quote in ("\"", "'") and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            else:
                m = BARE.match(source, at)
                value, at = m[0], m.end()
        attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)


class Builder:
    """The element tree of a page, with implied tags put up."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def within(self, tags, fences) -> int | None:
        """The place of the innermost open element of `tags`, unless a fence stands further in."""
        k = self.last(tags)
        return k if k >= 0 and k > self.last(fences) else None

    def close_from(self, k: int) -> None:
        for node in self.stack[k:]:
            self.places[node.tag].pop()
        del self.stack[k:]

    def end(self, tags, fences) -> None:
        while (k := self.within(tags, fences)) is not None:
            self.close_from(k)

    def put(self, child, fits: bool) -> None:
        """Adds a child to the open element, or before the table in which it may not stand."""
        here = self.stack[-1]
        if here.tag in TABLE_PARTS and not fits and (k := self.last(("table",))) > 0:
            self.stack[k - 1].children.insert(-1, child)  # an open table is the last child of what holds it
        else:
            here.children.append(child)

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        if len(self.stack) >= DEPTH:
            self.close_from(DEPTH - 1)
        self.put(node, tag in IN_TABLE)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        return node

    def text(self, piece: str) -> None:
        if not piece:
            return
        here = self.stack[-1].tag
        if piece.isspace():
            if here in TABLE_PARTS:
                return
        elif here == "head":
            self.close_from(len(self.stack) - 1)  # the body begins with the first text
        self.put(unescape(piece) if "&" in piece else piece, False)

    def end_tag(self, tag: str) -> None:
        if tag == "p" and self.within(("p",), P_FENCES) is None:
            self.push("p", {})
            self.close_from(len(self.stack) - 1)
        elif tag == "br":
            self.put(Node("br", {}), False)
        elif (k := self.within((tag,), () if tag in ("table", "body") else ("table",))) is not None:
            self.close_from(k)

    def start_tag(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag == "html":
            return None
        if self.places.get("svg") or self.places.get("math"):
            if closed:
                return None
        elif tag == "body":
            self.end(("head",), ())
        elif self.stack[-1].tag == "head" and tag not in HEAD:
            self.close_from(len(self.stack) - 1)  # the head ends where the body's content begins
        if tag in CLOSE_P:
            self.end(("p",), P_FENCES)
        if tag in ENDS:
            self.end(*ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag != "tr":
            if (k := self.within(("tr",), ("table",))) is not None:
                self.close_from(k + 1)
            elif (k := self.within(("table",), ())) is not None:
                if self.stack[-1].tag not in TABLE_PARTS:
                    self.close_from(max(k, self.last(("thead", "tbody", "tfoot"))) + 1)
                self.push("tr", {})
        if tag in VOID:
            self.put(Node(tag, attrs), tag in IN_TABLE or tag == "input" and attrs.get("type", "").lower() == "hidden")
            return None
        return self.push(tag, attrs)


def build(source: str) -> Node:
    """The element tree of a page."""
    tree, at, size = Builder(), 0, len(source)
    while at < size:
        k = source.find("<", at)
        if k < 0:
            tree.text(source[at:])
            break
        mark = source[k + 1 : k + 2]
        if mark.isascii() and mark.isalpha():
            tree.text(source[at:k])
            read = read_tag(source, k + 1)
            if read is None:
                break
            tag, attrs, closed, at = read
            node = tree.start_tag(tag, attrs, closed)
            if node is not None and tag in RAW:
                end = RAW_END[tag].search(source, at) if tag != "plaintext" else None
                stop = end.start() if end else size
                body = source[at:stop]
                if tag not in ("script", "style") and body:
                    node.children.append(unescape(body) if tag in ("textarea", "title") else body)
                tree.close_from(len(tree.stack) - 1)
                after = source.find(">", stop) if end else -1
                at = after + 1 if after >= 0 else size
        elif mark == "/" and (first := source[k + 2 : k + 3]).isascii() and first.isalpha():
            tree.text(source[at:k])
            read = read_tag(source, k + 2)
            if read is None:
                break
            tree.end_tag(read[0])
            at = read[3]
        elif mark in ("!", "?", "/") and mark:
            tree.text(source[at:k])
            if source.startswith("<!--", k):
                end = k + 4 if source.startswith((">", "->"), k + 4) else source.find("-->", k + 4)
                at = source.find(">", end) + 1 if end >= 0 else size
            else:
                at = source.find(">", k) + 1 or size
        else:  # a sign in the text
            tree.text(source[at : k + 1])
            at = k + 1
    return tree.root


def styles(attrs: dict[str, str]) -> dict[str, str]:
    """The declarations of an inline style; of repeated ones the last."""
    found = {}
    for part in attrs.get("style", "").lower().split(";"):
        name, _, value = part.partition(":")
        found[name.strip()] = value.replace("!important", "").strip()
    return found


def unseen(node: Node, parent: Node, summary: Node | None) -> bool:
    """Whether nothing of an element is shown; summary: the first one of the parent."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    if parent.tag == "details" and "open" not in parent.attrs and node is not summary:
        return True
    return "style" in a and styles(a).get("display") == "none" or node.tag == "input" and a.get("type", "").lower() == "hidden"


def chosen(select: Node) -> tuple[list[str], bool]:
    """The texts of the options that a select element shows, and whether it is a list box, which shows all."""
    options, stack = [], [select]
    while stack:
        node = stack.pop()
        if node.tag == "option":
            text, inner = [], [node]
            while inner:
                x = inner.pop()
                if isinstance(x, str):
                    text.append(x)
                else:
                    inner += reversed(x.children)
            options.append((node.attrs, WHITE.sub(" ", "".join(text)).strip(" ")))
        else:
            stack += reversed([c for c in node.children if isinstance(c, Node) and not ("hidden" in c.attrs or c.tag in UNSEEN)])
    size = select.attrs.get("size", "")
    if "multiple" in select.attrs or size.isascii() and size.isdigit() and size.strip("0") not in ("", "1"):
        return [x for _, x in options], True
    shown = [x for a, x in options if "selected" in a][-1:] or [x for a, x in options if "disabled" not in a][:1]
    return shown, False


def lay(flow: list) -> tuple[list, bool]:
    """Lines of a flow of texts, breaks and blocks, and whether a gap stands around a lone block."""
    solid = [x for x in flow if not (isinstance(x, str) and not isinstance(x, Pre) and not x.strip(" \t\n\r\f"))]
    if len(solid) == 1 and isinstance(solid[0], Block):
        return solid[0].lines, solid[0].gap
    lines: list = []
    held: list[str] = []
    gap = False

    def flush() -> None:
        nonlocal gap
        if held:
            whole = "".join(held)
            held.clear()
            rows = whole.split("\0")
            if rows and not rows[-1].strip():
                rows.pop()  # a break at the end of a block makes no line
            for k, row in enumerate(rows):
                if "\1" in row:  # kept white space between marks
                    parts = row.split("\1")
                    row = "".join(p if i % 2 else WHITE.sub(" ", p) for i, p in enumerate(parts)).rstrip()
                else:
                    row = WHITE.sub(" ", row).strip(" ")
                if row or 0 < k < len(rows):
                    if gap and lines and not ends_empty(lines):
                        lines.append("")
                    gap = False
                    lines.append(row)

    for x in flow:
        if isinstance(x, Block):
            flush()
            if x.lines:
                if (gap or x.gap) and lines and not ends_empty(lines):
                    lines.append("")
                lines += x.lines
                gap = x.gap
        elif x is Break:
            held.append("\0")
        elif isinstance(x, Pre):
            held.append("\0".join(f"\1{p}\1" for p in x.replace("\0", "").replace("\1", "").split("\n")))
        else:
            held.append(x.replace("\0", "").replace("\1", ""))
    flush()
    return lines, False


def width(text: str) -> int:
    """The columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Each row's cells with their columns: a cell goes to the first column that no cell from a row above takes."""
    out = []
    until = last = None  # until: by column, the first row that is free again; last: the greatest of them
    for k, row in enumerate(rows):
        here, at = [], 0
        for cell in row:
            if last is not None and k < last:
                free = np.flatnonzero(until[at:] <= k)
                at = at + int(free[0]) if len(free) else MOST_COLUMNS
            here.append((at, cell))
            at = min(at + cell.columns, MOST_COLUMNS)
        for at, cell in here:
            if cell.rows > 1:
                if last is None:
                    until, last = np.zeros(MOST_COLUMNS, np.int64), 0
                taken = slice(at, at + cell.columns)
                until[taken] = np.maximum(until[taken], k + cell.rows)
                last = max(last, k + cell.rows)
        out.append(here)
    return out


def table_lines(rows: list[list[Cell]], blanks: list[int]) -> list[str]:
    """Cells aligned in columns, two spaces apart; a cell of several lines makes its row as high. blanks[0] is what is left for alignment."""
    for row in rows:
        for cell in row:
            cell.lines = drawn(cell.lines, blanks)
    laid = placed(rows)
    starts = sorted({at for row in laid for at, _ in row})
    ends: dict[int, list[tuple[int, int]]] = {}
    for row in laid:
        for at, cell in row:
            ends.setdefault(at + cell.columns, []).append((at, min(CELL, max(map(width, cell.lines), default=0))))
    offset: dict[int, int] = {}
    closing = sorted(ends)
    least = k = 0
    for n, at in enumerate(starts):
        while k < len(closing) and closing[k] <= at:
            least = max([least, *(offset[a] + w + 2 for a, w in ends[closing[k]])])
            k += 1
        offset[at] = min(LINE, max(least, offset[starts[n - 1]] if n else 0))
    out = []
    for row in laid:
        for k in range(max((len(cell.lines) for _, cell in row), default=0)):
            parts, at = [], 0
            for column, cell in row:
                if k < len(cell.lines) and (text := cell.lines[k]):
                    apart = 2 if parts else 0
                    more = max(0, offset[column] - at - apart)
                    if more > blanks[0]:
                        more = 0
                    blanks[0] -= more
                    pad = apart + more
                    parts.append(" " * pad + text)
                    at += pad + width(text)
            out.append("".join(parts).rstrip())
    return out


def spanned(node: Node, name: str, most: int) -> int:
    """colspan or rowspan of a cell, within HTML's own bounds; rowspan 0 reaches to the end."""
    value = node.attrs.get(name, "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    n = int(value) if len(value) < 9 else most
    return min(n, most) if n else (most if name == "rowspan" else 1)


def render(root: Node, size: int) -> str:
    """The laid-out text of a tree, from the leaves up and without recursion; size: the page's characters."""
    blanks = [BLANKS * size]

    # frame: node, next child, flow (inline elements use that of what holds them), kept white space, next list number, table cells or rows, hidden, first summary
    def frame(node: Node, pre: bool, flow: list, hid: bool):
        start = node.attrs.get("start", "") if node.tag == "ol" else ""
        if "style" in node.attrs and (said := styles(node.attrs).get("visibility")):
            hid = said in ("hidden", "collapse") or said == "inherit" and hid
        return [node, 0, [] if node.tag in BLOCKS else flow, pre or node.tag in ("pre", "textarea"), int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, [], hid, None]

    stack = [frame(root, False, [], False)]
    drawings = 0  # open svg elements, in which only text elements show
    while True:
        node, k, flow, pre, _, _, hid, _ = here = stack[-1]
        if k < len(node.children):
            here[1] += 1
            child = node.children[k]
            if here[7] is None and isinstance(child, Node) and child.tag == "summary":
                here[7] = child
            if isinstance(child, str):
                closed = node.tag == "details" and "open" not in node.attrs
                if not hid and not closed and not (drawings and node.tag not in ("text", "tspan", "textpath", "a")):
                    flow.append(Pre(child) if pre else child)
            elif unseen(child, node, here[7]):
                pass
            elif child.tag == "br":
                flow.append(Break)
            elif child.tag == "hr":
                if not hid:
                    flow.append(Block(["---"], True))
            elif child.tag == "img":
                if not hid and (alt := child.attrs.get("alt", "").strip()):
                    flow.append(alt)
            elif child.tag == "input":
                if not hid and child.attrs.get("type", "text").lower() not in ("checkbox", "radio", "file", "image") and (value := child.attrs.get("value", "")):
                    flow.append(value)
            elif child.tag == "select":
                if not hid:
                    options, all_ = chosen(child)
                    flow.append(Block([x for x in options if x], False)) if all_ else flow.extend(options)
            elif child.tag == "wbr":
                pass
            else:
                if child.tag == "svg":
                    drawings += 1
                if child.tag == "text":
                    flow.append(" ")
                stack.append(frame(child, pre, flow, hid))
            continue
        stack.pop()
        if not stack:
            return "\n".join(drawn(lay(flow)[0], blanks)).strip("\n")
        up = stack[-1]
        tag = node.tag
        if tag == "svg":
            drawings -= 1
            flow.append(" ")
        elif tag in ("td", "th"):
            cell = Cell(lay(flow)[0], spanned(node, "colspan", MOST_COLUMNS), spanned(node, "rowspan", MOST_ROWS))
            for above in reversed(stack):
                if above[0].tag in ("tr", "table"):
                    above[5].append(cell)
                    break
            else:
                up[2].append(Block(cell.lines, False))
        elif tag == "tr":
            for above in reversed(stack):
                if above[0].tag == "table":
                    above[5].append(here[5])
                    break
            else:
                up[2].append(Block(lay(flow)[0] + table_lines([here[5]], blanks), False))
        elif tag in ("thead", "tbody", "tfoot"):
            up[2] += flow
        elif tag == "table":
            up[2].append(Block(lay(flow)[0] + table_lines([r if isinstance(r, list) else [r] for r in here[5]], blanks), True))
        elif tag == "li":
            lines, _ = lay(flow)
            if lines:
                mark = "- "
                for above in reversed(stack):
                    if above[0].tag in ("ul", "ol", "menu"):
                        if above[0].tag == "ol":
                            mark = f"{above[4]}. "
                            above[4] += 1
                        break
                pad = " " * len(mark)
                up[2].append(Block([Nest(lines, mark, mark, pad, "")], False))
        elif tag in ("ul", "ol", "menu"):
            lines, _ = lay(flow)
            nested = any(f[0].tag == "li" for f in stack)
            up[2].append(Block(lines, not nested))
        elif tag == "dd":
            lines = lay(flow)[0]
            up[2].append(Block([Nest(lines, "    ", "", "    ", "")] if lines else [], False))
        elif tag == "blockquote":
            lines = lay(flow)[0]
            up[2].append(Block([Nest(lines, "> ", ">", "> ", ">")] if lines else [], True))
        elif tag == "pre":
            if flow and isinstance(flow[0], Pre) and flow[0].startswith("\n"):
                flow[0] = Pre(flow[0][1:])
            up[2].append(Block(lay(flow)[0], True))
        elif tag in BLOCKS:
            lines, gap = lay(flow)
            up[2].append(Block(lines, gap or tag in SPACED))


def html_text(source: str | None) -> str:
    """The visible text of one page."""
    return render(build(source), len(source)) if source else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row of pages; one scan, no shuffle."""

    def run(batches):
        for b in batches:
            yield {"page_id": b.column(0), "text": [html_text(x.as_py()) for x in b.column(1)]}

    return arrow_rows(pages.select(F.col(id_col).cast("long"), F.col(html_col)), run, "page_id long, text string")
