"""Visible text of HTML pages by layout-aware rendering of a tree built with implied tags.

A tokenizer reads the page once from left to right, with HTML's states for attributes. The page
becomes a tree as browsers build it in the common cases: start tags close what cannot stay open,
missing rows and ends are implied, script and style are raw text. Rendering walks the tree with a
stack of its own: what is not displayed is left out with all inside it, what is not visible but for
those inside that are; white space collapses except in preformatted text, blocks get lines and margins
of their own, list items their bullets or numbers, and table cells are aligned in their columns.

Style rules count for display and visibility. Selectors of one element are known (a tag, ids, classes
and *, alone or together), by specificity and order; rules with others are passed over.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The elements with special roles.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
INVISIBLE = {
    "head", "script", "style", "title", "template", "noscript", "iframe", "noembed", "noframes", "datalist",
    "object", "audio", "video", "canvas", "svg", "math", "meta", "link", "base", "colgroup", "param", "map",
}
PLAIN_BLOCKS = {
    "address", "article", "aside", "body", "center", "details", "dialog", "div", "dd", "dt", "fieldset", "footer",
    "form", "header", "hgroup", "html", "legend", "li", "main", "nav", "option", "optgroup", "search", "section",
    "summary", "caption", "tr", "td", "th", "thead", "tbody", "tfoot", "hr",
}
SPACED_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "menu", "dir", "dl", "table", "pre", "blockquote", "figure", "figcaption", "listing", "xmp", "plaintext"}
#: What a start tag closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = (PLAIN_BLOCKS | SPACED_BLOCKS) - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body"}
KEEPS_P = {"table", "td", "th", "caption", "button", "object", "template"}
HEAD_ONLY = {"base", "link", "meta", "script", "style", "title", "template", "noscript"}

BLANK = re.compile(r"[ \t\n\r\f]+")
TAG_NAME = re.compile(r"[^ \t\n\r\f/>]+")
BETWEEN = re.compile(r"[ \t\n\r\f/]*")
NAME = re.compile(r"=?[^ \t\n\r\f/>=]*")
EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
BARE_VALUE = re.compile(r"[^ \t\n\r\f>]*")
COMMENT_END = re.compile(r"--!?>")
GAP = "  "
#: Indentation stops to grow at so many columns, so that deep nesting cannot square a page's size.
INDENT = 400
#: A table is aligned unless that takes more blanks than this many times its text, and this many more.
BLANKS, FREE_BLANKS = 64, 1_000_000


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def tag_at(page: str, at: int) -> tuple[str, dict[str, str], int]:
    """The tag whose name begins here: name, attributes, and where the page goes on; nowhere (-1) if
    the tag never ends."""
    name = TAG_NAME.match(page, at)
    at, found = name.end(), {}
    while True:
        at = BETWEEN.match(page, at).end()
        if at == len(page):
            return name[0].lower(), found, -1
        if page[at] == ">":
            return name[0].lower(), found, at + 1
        key = NAME.match(page, at)
        at, value = key.end(), ""
        equals = EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"'):
                end = page.find(quote, at + 1)
                if end < 0:
                    return name[0].lower(), found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE_VALUE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), html.unescape(value) if "&" in value else value)


def declared(text: str) -> dict[str, tuple[str, bool]]:
    """display and visibility of a list of declarations, and whether they are important."""
    found: dict[str, tuple[str, bool]] = {}
    for part in text.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            bare = value.removesuffix("!important").strip()
            important = len(bare) < len(value)
            if important or not found.get(name, ("", False))[1]:
                found[name] = bare, important
    return found


COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[#.][\w-]+)*)")


class Sheet:
    """The rules of a page's styles for display and visibility."""

    def __init__(self, styles: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        for style in styles:
            self._read(style)

    def _read(self, style: str) -> None:
        bare, at = [], 0
        while at >= 0:
            begin = style.find("/*", at)
            bare.append(style[at : begin if begin >= 0 else len(style)])
            end = style.find("*/", begin + 2) if begin >= 0 else -1
            at = end + 2 if end >= 0 else -1
        style, opened, last = "".join(bare), [], 0
        for found in re.finditer(r"[{}]", style):
            piece, last = style[last : found.start()], found.end()
            if found[0] == "{":
                opened.append(piece.rsplit(";", 1)[-1].strip())
            elif opened:
                selectors = opened.pop()
                if not selectors.startswith("@") and all(_for_screens(x) for x in opened):
                    self._rule(selectors, piece)

    def _rule(self, selectors: str, body: str) -> None:
        own = declared(body)
        if not own:
            return
        for selector in selectors.split(","):
            found = COMPOUND.fullmatch(selector.strip())
            if not found or not found[0]:
                continue
            tag = (found[1] or "*").lower()
            parts = re.findall(r"[#.][\w-]+", found[2])
            weight = sum(100 if x[0] == "#" else 10 for x in parts) + (tag != "*")
            key = parts[-1] if parts else tag
            self.rules[key].append((weight, sum(map(len, self.rules.values())), tag, frozenset(parts), own))

    def of(self, node: Node) -> dict[str, str]:
        """An element's own display and visibility, as far as anything is said of them."""
        style = node.attributes.get("style", "")
        said = []
        if self.rules:
            names = {f".{x}" for x in node.attributes.get("class", "").split()}
            if node.attributes.get("id"):
                names.add(f"#{node.attributes['id']}")
            for key in (node.tag, "*", *names):
                for weight, order, tag, parts, own in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and parts <= names:
                        said += [(important, weight, order, name, value) for name, (value, important) in own.items()]
        if style:
            said += [(important, 1_000_000, 0, name, value) for name, (value, important) in declared(style).items()]
        return {name: value for _, _, _, name, value in sorted(said)}

    def displayed(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether an element is displayed at all, and whether its own text is visible."""
        if node.tag in INVISIBLE:
            return False, False
        own = self.of(node) if self.rules or "style" in node.attributes else {}
        gone = "hidden" in node.attributes or node.tag == "dialog" and "open" not in node.attributes
        if "display" in own:
            gone = own["display"] == "none"
        seen = own.get("visibility", "inherit")
        return not gone, {"visible": True, "hidden": False, "collapse": False}.get(seen, visible)


def _for_screens(rule: str) -> bool:
    """Whether what stands inside this rule counts."""
    if not rule.startswith("@media"):
        return rule.startswith(("@supports", "@layer"))
    asked = rule.removeprefix("@media").strip().lower()
    return asked in ("", "all", "screen") or asked.startswith(("screen ", "all ", "only screen"))


class Builder:
    """The open elements are a stack; places holds the positions of each tag in it, so that a tag
    costs the same however deep it is."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.styles: list[str] = []
        self.tables = 0  # how deep tables stand inside tables
        self.places: dict[str, list[int]] = defaultdict(list)

    def _cut(self, at: int) -> None:
        """Closes the element at this position and all inside it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def _last(self, tags: set[str]) -> int:
        return max((self.places[x][-1] for x in tags if self.places.get(x)), default=0)

    def _close(self, tags: set[str], stops: set[str]) -> None:
        """Closes the innermost open element of these, and all inside it; none beyond a stop."""
        at = self._last(tags)
        if at and at >= self._last(stops):
            self._cut(at)

    def _close_all(self, tags: set[str], stops: set[str]) -> None:
        """Closes the outermost open element of these that has no stop inside it."""
        stop, found = self._last(stops), []
        for own in (self.places[x] for x in tags if self.places.get(x)):
            found += own[bisect_left(own, stop) :][:1]
        if found:
            self._cut(min(found))

    def _push(self, node: Node, keep: bool = True) -> None:
        self.stack[-1].children.append(node)
        if keep:
            self.places[node.tag].append(len(self.stack))
            self.stack.append(node)
            if node.tag == "table":
                self.tables = max(self.tables, len(self.places["table"]))

    def text(self, text: str) -> None:
        if text:
            if self.stack[-1].tag == "head" and not text.isspace():
                self._cut(len(self.stack) - 1)
            self.stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html":
            for name, value in attributes.items():
                self.root.attributes.setdefault(name, value)
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self._cut(len(self.stack) - 1)
        if tag in ENDS_P:
            self._close({"p"}, KEEPS_P)
        if tag in CLOSES:
            (self._close_all if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else self._close)(*CLOSES[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr"))
        self._push(Node(tag, attributes), tag not in VOID)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push(Node("br"), False)
        elif tag in ("html", "body"):
            return
        elif tag == "p" and not self.places.get("p"):
            self._push(Node("p"), False)
        else:
            stops = set() if tag in ("table", "td", "th", "tr") else {"table", "td", "th"} - {tag}
            self._close({tag}, stops)


def tree(page: str) -> Builder:
    """The tree and the texts of the page's styles, as the builder has them. The page is read once, from left to right."""
    builder, at = Builder(), 0
    while at < len(page):
        mark = page.find("<", at)
        while mark >= 0 and not (page[mark + 1 : mark + 2] in ("!", "?", "/") or _letter(page[mark + 1 : mark + 2])):
            mark = page.find("<", mark + 1)
        builder.text(page[at : mark if mark >= 0 else len(page)])
        if mark < 0:
            break
        sign = page[mark + 1]
        if page.startswith("<!--", mark):
            if page.startswith(("<!-->", "<!--->"), mark):
                at = page.index(">", mark) + 1
                continue
            end = COMMENT_END.search(page, mark + 4)
            at = end.end() if end else len(page)
        elif _letter(sign):
            tag, attributes, at = tag_at(page, mark + 1)
            if at < 0:  # a tag that never ends is no text
                break
            builder.start(tag, attributes)
            if tag in RAW or tag == "plaintext":
                at = _raw(builder, page, tag, attributes, at)
        elif sign == "/" and _letter(page[mark + 2 : mark + 3]):
            tag, _, at = tag_at(page, mark + 2)
            if at < 0:
                break
            builder.end(tag)
        elif sign == "/" and mark + 2 >= len(page):
            builder.text("</")
            break
        else:  # a declaration, or what is none
            end = page.find(">", mark + 2)
            at = end + 1 if end >= 0 else len(page)
    return builder


def _letter(sign: str) -> bool:
    return sign.isascii() and sign.isalpha()


def _raw(builder: Builder, page: str, tag: str, attributes: dict[str, str], at: int) -> int:
    """Takes in an element whose content is no markup; where the page goes on."""
    closing = re.compile(rf"</{tag}(?=[ \t\n\r\f/>]|\Z)", re.I).search(page, at) if tag != "plaintext" else None
    stop = closing.start() if closing else len(page)
    text = page[at:stop]
    if tag == "style":
        if _for_screens(f"@media {attributes.get('media', '')}"):
            builder.styles.append(text)
    else:
        builder.stack[-1].children.append(html.unescape(text) if tag in ("textarea", "title") else text)
    return stop


class Flow:
    """Lines of text in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.margin = False
        self.indent, self.marker = 0, None

    def _begin(self) -> None:
        if not self.line:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            before, mark = (self.indent, "") if self.marker is None else self.marker
            self.line.append(" " * min(before, INDENT) + mark)
            self.marker = None

    def text(self, text: str) -> None:
        words = [x for x in BLANK.split(text) if x]
        if not words:
            self.space = self.space or bool(self.line)
            return
        started = bool(self.line)
        self._begin()
        if started and (self.space or text[0] in " \t\n\r\f"):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = text[-1] in " \t\n\r\f"

    def exact(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.newline()
            if part:
                self._begin()
                self.line.append(part)
        self.space = False

    def newline(self) -> None:
        if not self.line:
            self._begin()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def block(self, margin: bool) -> None:
        if self.line:
            self.newline()
        self.space = False
        self.margin = self.margin or margin

    def finished(self) -> list[str]:
        self.block(False)
        return self.lines


class Frame:
    """An element whose children are being rendered, and what is to be done at its end."""

    __slots__ = ("node", "rest", "exact", "depth", "seen", "number", "indent", "margin", "closing", "folded")

    def __init__(self, node, exact=False, depth=0, seen=True, number=None, indent=None, margin=None, closing=""):
        self.node, self.rest = node, iter(node.children)
        self.exact, self.depth, self.seen, self.number = exact, depth, seen, number
        self.indent, self.margin, self.closing = indent, margin, closing
        self.folded = node.tag == "details" and "open" not in node.attributes


def render(node: Node, flow: Flow, sheet: Sheet, depth: int = 0, seen: bool = True) -> None:
    """Renders an element's children. depth counts the lists around, seen is its own visibility."""
    work = [Frame(node, depth=depth, seen=seen)]
    while work:
        frame = work[-1]
        child = next(frame.rest, None)
        if child is None:
            work.pop()
            _leave(frame, flow)
        elif frame.folded and not (isinstance(child, Node) and child.tag == "summary"):
            continue
        elif isinstance(child, str):
            if frame.seen:
                (flow.exact if frame.exact else flow.text)(child)
        else:
            displayed, visible = sheet.displayed(child, frame.seen)
            if displayed:
                entered = _enter(child, frame, flow, sheet, visible)
                if entered:
                    work.append(entered)


def _leave(frame: Frame, flow: Flow) -> None:
    if frame.closing and frame.seen:
        flow.text(frame.closing)
    if frame.margin is not None:
        flow.block(frame.margin)
    if frame.indent is not None:
        if frame.node.tag == "li":
            flow.marker = None
        flow.indent = frame.indent


def _enter(child: Node, frame: Frame, flow: Flow, sheet: Sheet, seen: bool) -> Frame | None:
    """Begins an element; the frame of its children, if they are to be rendered."""
    tag, exact, depth, before = child.tag, frame.exact, frame.depth, flow.indent
    if tag == "br":
        flow.newline()
    elif tag in ("input", "img", "area"):
        if seen:
            _replaced(child, flow)
    elif tag == "table":
        flow.block(True)
        _table(child, flow, sheet, depth, seen)
        flow.block(True)
    elif tag in ("ul", "ol", "menu", "dir"):
        flow.block(depth == 0)
        number = _whole(child.attributes.get("start", "1"), 1)
        return Frame(child, exact, depth + 1, seen, number, margin=depth == 0)
    elif tag == "li" and frame.number is not None:
        number = _whole(child.attributes.get("value", ""), frame.number)
        frame.number = number + 1
        mark = f"{number}. " if frame.node.tag == "ol" else "- "
        flow.block(False)
        if seen:
            flow.marker = before, mark
        flow.indent = before + len(mark)
        return Frame(child, exact, depth, seen, indent=before, margin=False)
    elif tag in SPACED_BLOCKS or tag in PLAIN_BLOCKS:
        margin = tag in SPACED_BLOCKS
        flow.block(margin)
        flow.indent += 4 * (tag == "dd") + 2 * (tag == "blockquote")
        if tag == "pre" and child.children and isinstance(child.children[0], str):
            child.children[0] = child.children[0].removeprefix("\r").removeprefix("\n")
        return Frame(child, exact or tag in ("pre", "listing", "xmp", "plaintext"), depth, seen, indent=before, margin=margin)
    else:
        if tag == "q" and seen:
            flow.text("“")
        return Frame(child, exact or tag == "textarea", depth, seen, closing="”" if tag == "q" else "")
    return None


def _replaced(node: Node, flow: Flow) -> None:
    """The text that shows in an element's place."""
    if node.tag == "img":
        flow.text(node.attributes.get("alt", ""))
    elif node.tag == "input" and node.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search"):
        flow.text(node.attributes.get("value", ""))


def _whole(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text) else default


def _holding(child) -> Node:
    made = Node("div")
    made.children = [child]
    return made


def _groups(node: Node, sheet: Sheet, seen: bool, captions: list) -> list[list[tuple[Node, bool]]]:
    """The row groups of a table, footers last: rows and whether they are visible."""
    early, late, own = [], [], []
    for child in node.children:
        if isinstance(child, str):
            if not child.isspace():
                captions.append((_holding(child), seen))
            continue
        displayed, visible = sheet.displayed(child, seen)
        if not displayed:
            continue
        if child.tag == "tr":
            own.append((child, visible))
        elif child.tag in ("thead", "tbody", "tfoot"):
            early.append(own)
            own = []
            (late if child.tag == "tfoot" else early).extend(_groups(child, sheet, visible, captions))
        else:
            captions.append((_holding(child), seen))
    return [x for x in [*early, own, *late] if x]


def _table(node: Node, flow: Flow, sheet: Sheet, depth: int, seen: bool) -> None:
    """Cells become blocks of lines, in a grid in which they may span columns and, inside a group,
    rows. A column is as wide as its widest line."""
    captions: list[tuple[Node, bool]] = []
    rows, widths, letters = [], defaultdict(int), 0
    for group in _groups(node, sheet, seen, captions):
        taken: dict[int, int] = {}  # columns that cells from above still fill, and for how many rows
        for row, visible in group:
            cells, column, new = [], 0, []
            for child in row.children:
                if isinstance(child, str):
                    if child.isspace():
                        continue
                    cell, shown = _holding(child), visible
                else:
                    displayed, shown = sheet.displayed(child, visible)
                    if not displayed:
                        continue
                    cell = child if child.tag in ("td", "th") else _holding(child)
                inner = Flow()
                render(cell, inner, sheet, 0, shown)
                lines = inner.finished()
                while taken.get(column, 0) > 0:
                    column += 1
                span = min(max(1, _whole(cell.attributes.get("colspan", "1"), 1)), 1000)
                down = min(max(0, _whole(cell.attributes.get("rowspan", "1"), 1)), 65_534) or len(group)
                if span == 1:
                    widths[column] = max(widths[column], max(map(len, lines), default=0))
                if down > 1:
                    new += [(x, down) for x in range(column, column + span)]
                letters += sum(map(len, lines))
                cells.append((column, span, lines))
                column += span
            taken = {x: n - 1 for x, n in taken.items() if n > 1}
            taken.update((x, n - 1) for x, n in new)
            rows.append(cells)
    for caption, shown in captions:
        render(caption, flow, sheet, depth, shown)
        flow.block(False)
    starts = _starts(widths)
    blanks = sum(starts(cells[-1][0]) * max((len(x) for _, _, x in cells), default=0) for cells in rows if cells)
    aligned = blanks <= BLANKS * letters + FREE_BLANKS
    for cells in rows:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, length = [], 0
            for column, _, lines in cells:
                text = lines[k] if k < len(lines) else ""
                if aligned:
                    gap = starts(column) - length
                    if length:
                        gap = max(gap, len(GAP))
                else:
                    gap = len(GAP) if length else 0
                if text:
                    line.append(" " * gap + text)
                    length += gap + len(text)
            flow.exact("".join(line))
            flow.newline()


def _starts(widths: dict[int, int]):
    """Where each column begins: behind all before it that have a text of their own."""
    known = sorted(x for x, width in widths.items() if width)
    sums = [0]
    for column in known:
        sums.append(sums[-1] + widths[column] + len(GAP))
    return lambda column: sums[bisect_left(known, column)]


def visible_text(page: str) -> str:
    flow = Flow()
    built = tree(page.replace("\0", ""))
    sheet = Sheet(built.styles)
    # tables alone are rendered by calls inside calls, which Python keeps off the machine's stack
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * built.tables + 1000))
    displayed, seen = sheet.displayed(built.root, True)
    if displayed:
        render(built.root, flow, sheet, 0, seen)
    lines = flow.finished()
    while lines and not lines[-1]:
        lines.pop()
    first = next((k for k, x in enumerate(lines) if x), 0)
    return "\n".join(lines[first:])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: id, text.

    Null, empty and tag-only pages give an empty text. Repeated rows give the same text; a null id
    stays null; an empty table gives no rows; other columns are not read. Pages may be of any length
    and nesting of any depth; time and memory are linear in the page but for tables inside tables, whose
    lines are laid out once for each table around them. All visible text is emitted; what is bounded is
    its layout: indentation beyond INDENT columns, and a table whose blanks would outweigh its text
    (BLANKS), which stands unaligned.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                texts = [visible_text(x) for x in some.column(1).to_pylist()]
                yield pa.record_batch([some.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), text_of(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
