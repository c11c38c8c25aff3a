"""Layout-aware rendering of HTML to plain text.

A small tree builder reads a page as browsers do where it matters for text: end tags that may be
left out are implied, stray ones ignored, raw-text elements and comments skipped.  Visibility follows
the elements that are never shown, ``hidden``, ``display`` and ``visibility`` in style attributes and
in plain rules of style sheets, closed ``details`` and ``dialog``.  The renderer then emits all
visible text: blocks on lines of their own with blank lines where browsers put margins, list items
behind their bullet or number and indented, table cells padded to columns, preformatted text as is.

Work is page by page in Arrow batches; nothing is shuffled.

Edge cases: a null page gives a null text, an empty one an empty text; broken markup never fails,
text is kept where a browser would keep it; trees deeper than ``MAX_DEPTH`` go on at that depth, as in
browsers; repeated rows get equal results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import pieces

#: HTML's own element classes, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title plaintext".split())
NEVER = frozenset("head script style template noscript iframe noembed noframes title object canvas audio video datalist svg math area base col colgroup link meta param source track".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul xmp caption tr td th thead tbody tfoot".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir xmp".split())
CLOSES_P = BLOCK - frozenset("html body caption tr td th thead tbody tfoot option optgroup li dd dt legend".split()) | {"li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, up to the nearest of those.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("thead tbody tfoot table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: End tags look for their element no further up than these.
WALLS = frozenset("table td th caption html".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
MAX_DEPTH = 150
CELL_GAP = "  "

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.DOTALL)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SPACE = re.compile(r"[ \t\n\f\r]+")
HIDES = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
BLANKS = " \t\n\f\r"


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        value = values[0] or values[1] or values[2]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


class Builder:
    """The element tree of a page; ``styles`` gathers the style sheets' text."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.open, self.styles = [self.root], []
        at = 0
        while m := TAG.search(page, at):
            self.text(page[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                else:
                    self.start(tag, m[3])
                    if tag in RAW:
                        at = self.raw(tag, page, at)
            elif m[0].startswith("<![CDATA["):
                self.text(m[0][9:].removesuffix("]]>"))
        self.text(page[at:])

    def raw(self, tag: str, page: str, at: int) -> int:
        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at) if tag != "plaintext" else None
        inside = page[at : close.start() if close else len(page)]
        if tag == "style":
            self.styles.append(inside)
        elif tag in ("textarea", "xmp", "plaintext"):
            self.add(html.unescape(inside) if tag == "textarea" else inside)
        self.end(tag)
        return close.end() if close else len(page)

    def add(self, child: Node | str) -> None:
        here = self.open[-1]
        # text and other elements directly inside a table's frame stand before the table
        loose = child.strip(BLANKS) if isinstance(child, str) else child.tag not in TABLE_PARTS and child.tag not in (
            "td", "th", "caption", "colgroup", "col", "script", "style", "template"
        )
        if here.tag in TABLE_PARTS and loose:
            place = max(i for i, n in enumerate(self.open) if n.tag == "table") if any(n.tag == "table" for n in self.open) else 0
            if place:
                outer = self.open[place - 1].children
                outer.insert(len(outer) - 1, child)
                return
        here.children.append(child)

    def text(self, source: str) -> None:
        if source:
            self.add(html.unescape(source) if "&" in source else source)

    def start(self, tag: str, source: str) -> None:
        attrs = attributes(source) if source.strip(" /\t\n") else {}
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            for n in self.open:
                if n.tag == tag:
                    for k, v in attrs.items():
                        n.attrs.setdefault(k, v)
            return
        if tag in CLOSES_P:
            self.close_up_to(frozenset("p"), WALLS | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED:
            self.close_up_to(*IMPLIED[tag])
        elif self.open[-1].tag == "head" and tag not in NEVER and tag not in RAW:
            self.open.pop()
        if len(self.open) > MAX_DEPTH:
            self.open.pop()
        node = Node(tag, attrs)
        self.add(node)
        if tag not in VOID:
            self.open.append(node)

    def close_up_to(self, closed: frozenset[str], walls: frozenset[str]) -> None:
        """Close the nearest open elements of a class, as far up as the next wall."""
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in walls:
                break
            if self.open[i].tag in closed:
                last = i
        if last is not None:
            del self.open[last:]

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if tag in ("body", "html"):  # what follows still belongs to the body
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in WALLS and tag not in TABLE_PARTS and tag not in ("td", "th", "caption"):
                return
        if tag == "p":
            self.add(Node("p", {}))


class Sheet:
    """Plain rules of style sheets that hide or show: tag, ``.class``, ``#id`` and ``tag.class``."""

    def __init__(self, styles: list[str]):
        self.rules: dict[str, str] = {}
        for style in styles:
            for names, body in RULE.findall(re.sub(r"/\*.*?\*/", "", style, flags=re.DOTALL)):
                if HIDES.search(body) or VISIBILITY.search(body):
                    for name in names.split(","):
                        name = name.strip().lower()
                        if re.fullmatch(r"[a-z0-9]*[.#]?[\w-]+", name):
                            self.rules[name] = self.rules.get(name, "") + ";" + body

    def style(self, node: Node) -> str:
        own = node.attrs.get("style", "")
        if not self.rules:
            return own
        names = [node.tag, "#" + node.attrs.get("id", "").lower(), node.tag + "#" + node.attrs.get("id", "").lower()]
        for c in node.attrs.get("class", "").lower().split():
            names += ["." + c, node.tag + "." + c]
        return ";".join([*(self.rules[n] for n in names if n in self.rules), own])


class Writer:
    """Lines of one box: collapses white space and keeps blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = 0

    def text(self, text: str) -> None:
        words = SPACE.split(text)
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self.line.append(word)

    def exact(self, text: str) -> None:
        first, *others = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for line in others:
            self.newline()
            self.line.append(line)
        self.space = False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.extend([""] * self.blank)
        self.blank = 0
        self.lines.append(line.replace("\xa0", " ").rstrip())

    def newline(self) -> None:
        self.put("".join(self.line))
        self.line, self.space = [], False

    def break_line(self) -> None:
        if self.line:
            self.newline()
        self.space = False

    def margin(self, blank: int) -> None:
        self.break_line()
        self.blank = max(self.blank, blank)

    def box(self, lines: list[str], first: str, rest: str) -> None:
        """Another box's lines behind a marker."""
        self.break_line()
        for i, line in enumerate(lines):
            self.put((first if i == 0 else rest) + line if line or i == 0 else "")

    def done(self) -> list[str]:
        self.break_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Renderer:
    def __init__(self, sheet: Sheet):
        self.sheet = sheet
        self.lists = 0

    def shown(self, node: Node, parent: Node | None) -> bool:
        if node.tag in NEVER or "hidden" in node.attrs:
            return False
        if node.tag == "dialog" and "open" not in node.attrs:
            return False
        if parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
            return False
        return not HIDES.search(self.sheet.style(node))

    def flow(self, node: Node, out: Writer, visible: bool, pre: bool) -> None:
        """The children of a node, into the writer."""
        number = counter(node)
        for child in node.children:
            if isinstance(child, str):
                if visible and not (node.tag == "details" and "open" not in node.attrs):
                    (out.exact if pre else out.text)(child)
            elif self.shown(child, node):
                number = self.element(child, out, visible, pre, number)

    def element(self, node: Node, out: Writer, visible: bool, pre: bool, number: tuple[int, int] | None):
        """One element into the writer; gives the number that the next list item gets."""
        tag = node.tag
        if said := VISIBILITY.findall(self.sheet.style(node)):
            visible = said[-1].lower() == "visible"
        if tag == "br":
            out.newline()
        elif tag == "hr":
            out.margin(1)
        elif tag == "wbr" or tag == "img":
            pass
        elif tag == "input":
            if visible and node.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                out.text(node.attrs.get("value", ""))
        elif tag == "table":
            out.margin(1)
            self.table(node, out, visible, pre)
            out.margin(1)
        elif tag == "li":
            marker = "- "
            if number is not None:
                value = node.attrs.get("value", "")
                at = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number[0]
                marker, number = f"{at}. ", (at + number[1], number[1])
            box = self.boxed(node, visible, pre)
            if box:
                out.box(box, marker, " " * len(marker))
        elif tag in ("blockquote", "dd"):
            blank = int(tag == "blockquote")
            out.margin(blank)
            out.box(self.boxed(node, visible, pre), "  ", "  ")
            out.margin(blank)
        elif tag in BLOCK or tag == "textarea":
            # lists inside lists have no margins
            listed = tag in ("ul", "ol", "menu", "dir")
            blank = int(tag in SPACED and not (listed and self.lists))
            self.lists += listed
            out.margin(blank)
            exact = pre or tag in ("pre", "xmp", "textarea")
            if exact and not pre and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\r\n").removeprefix("\n")
            self.flow(node, out, visible, exact)
            self.lists -= listed
            out.margin(blank)
        else:
            self.flow(node, out, visible, pre)
        return number

    def boxed(self, node: Node, visible: bool, pre: bool) -> list[str]:
        box = Writer()
        self.flow(node, box, visible, pre)
        lines = box.done()
        while lines and not lines[0]:
            lines.pop(0)
        return lines

    def table(self, table: Node, out: Writer, visible: bool, pre: bool) -> None:
        """Caption, then rows with each column as wide as its widest cell."""
        rows: list[list[tuple[list[str], int, str]]] = []
        frames = [(table, visible)]
        while frames:
            frame, seen = frames.pop(0)
            inner = []
            for child in frame.children:
                if isinstance(child, str) or not self.shown(child, frame):
                    continue
                said = VISIBILITY.findall(self.sheet.style(child))
                see = said[-1].lower() == "visible" if said else seen
                if child.tag == "caption":
                    out.box(self.boxed(child, see, pre), "", "")
                elif child.tag == "tr":
                    rows.append([self.cell(c, see, pre) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and self.shown(c, child)])
                elif child.tag in ("td", "th"):
                    rows.append([self.cell(child, see, pre)])
                else:
                    inner.append((child, see))
            frames = inner + frames
        widths: dict[int, int] = {}
        for row in rows:
            at = 0
            for lines, span, _ in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
                at += span
        for row in rows:
            height = max((len(lines) for lines, *_ in row), default=0)
            for i in range(height):
                at, parts = 0, []
                for lines, span, align in row:
                    width = sum(widths.get(c, 0) for c in range(at, at + span)) + len(CELL_GAP) * (span - 1)
                    text = lines[i] if i < len(lines) else ""
                    parts.append(text.rjust(width) if align == "right" else text.center(width) if align == "center" else text.ljust(width))
                    at += span
                out.put(CELL_GAP.join(parts))

    def cell(self, node: Node, visible: bool, pre: bool) -> tuple[list[str], int, str]:
        said = VISIBILITY.findall(self.sheet.style(node))
        span = node.attrs.get("colspan", "1")
        aligned = re.search(r"text-align\s*:\s*(\w+)", node.attrs.get("style", ""))
        align = aligned[1] if aligned else node.attrs.get("align", "")
        see = said[-1].lower() == "visible" if said else visible
        return self.boxed(node, see, pre), max(1, int(span)) if re.fullmatch(r"\d{1,3}", span) else 1, align.lower()


def counter(node: Node) -> tuple[int, int] | None:
    """First number and step of an ordered list."""
    if node.tag != "ol":
        return None
    items = sum(1 for c in node.children if isinstance(c, Node) and c.tag == "li")
    back = "reversed" in node.attrs
    start = node.attrs.get("start", "")
    return int(start) if re.fullmatch(r"-?\d{1,9}", start) else items if back else 1, -1 if back else 1


def rendered(page: str | None) -> str | None:
    """All visible text of a page."""
    if page is None:
        return None
    built = Builder(page)
    out = Writer()
    renderer = Renderer(Sheet(built.styles))
    renderer.element(built.root, out, True, False, None)
    return "\n".join(out.done())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id`` and the rendered ``text`` of each page, with its characters and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [rendered(p) for p in batch.column(1).to_pylist()]
            counts = [(None, None) if t is None else (len(t), t.count("\n") + bool(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array([c for c, _ in counts], pa.int64()),
                    pa.array([n for _, n in counts], pa.int64()),
                ],
                ["page_id", "text", "n_chars", "n_lines"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, n_chars bigint, n_lines bigint")
