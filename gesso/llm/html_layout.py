"""Layout-aware text of HTML pages.

A page is read tag by tag into a stack of open elements, with the end tags that
HTML implies, and rendered on the way: elements that browsers don't show are
left out, blocks begin on lines of their own with blank lines where browsers
have margins, list items get bullets or numbers and indents, and tables become
aligned columns. All visible text is kept, that of formulas (math) and drawings
(svg) included; style sheets are not read.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from gesso.llm.spans import map_texts

#: fixed values of HTML: elements without content, with raw content, never shown, blocks, blocks with margins
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe object audio video canvas datalist noembed noframes".split())
#: elements inside drawings and formulas that browsers don't show where they stand
UNSEEN_IN = {"svg": frozenset("defs symbol desc metadata clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table hr".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address form fieldset details summary li dt dd figcaption tr thead tbody tfoot caption center option optgroup legend".split()
)
#: an opening tag closes the open elements named, up to the nearest of the bounds
IMPLIED = {
    "li": ("li", "ul ol menu td th table caption"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot caption colgroup", "table"), "thead": ("tr td th thead tbody tfoot caption colgroup", "table"), "tfoot": ("tr td th thead tbody tfoot caption colgroup", "table"),
    "body": ("head", "html"),
}
IMPLIED_SETS = {t: (frozenset(a.split()), frozenset(b.split())) for t, (a, b) in IMPLIED.items()}
#: what a head may hold; any other start tag, and any text, ends it
HEAD = frozenset("base basefont bgsound link meta title style script template noscript noframes html head".split())
#: boxes (list items, quotes, cells, tables) drawn one in another; deeper ones go on without indents and columns of their own
MOST_BOXES = 64
#: what a paragraph ends at, and what an end tag doesn't reach beyond
ENDS_P = (BLOCKS - frozenset("li dt dd tr thead tbody tfoot caption option optgroup html body".split())) | frozenset(["li", "dt", "dd"])
SCOPE = frozenset("table td th caption html".split())

#: as HTML's tokenizer: quotes delimit a value right after "=" only, elsewhere they belong to a name or an unquoted value
_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?|=)*+)>?)", re.S
)
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*))?)?")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)\b", re.I)
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>][^\s>]*\Z")
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def attributes(raw: str) -> dict[str, str]:
    """The first value of each attribute, names in lower case."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def width(text: str) -> int:
    """Columns a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


@dataclass
class Box:
    """Lines rendered so far in the page, a list item or a cell."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    blank: bool = False  # a blank line is due before the next text
    gap: bool = False  # a blank is due before the next word

    def end_line(self) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line, self.gap = [], False
        if text:
            self.put(text)

    def put(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(text)

    def words(self, text: str) -> None:
        parts = _BLANKS.sub(" ", text)
        if not parts:
            return
        if parts[0] == " " and self.line:
            self.gap = True
        core = parts.strip(" ")
        if core:
            self.line.append((" " if self.gap else "") + core)
            self.gap = parts[-1] == " "

    def raw(self, text: str) -> None:
        """Preformatted text: line breaks and blanks stay."""
        head, *more = text.split("\n")
        self.line.append(head)
        for part in more:
            self.put("".join(self.line).rstrip()) if self.line and "".join(self.line).strip() else self.lines.append("")
            self.line = [part]

    def text(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass
class Open:
    """An open element: its box if it has one of its own, and what it hides or counts."""

    tag: str
    box: Box | None = None
    gone: bool = False  # not displayed, nor is anything inside
    veiled: bool = False  # invisible, unless an element inside is made visible again
    count: int = 0
    rows: list[list[tuple[list[str], int]]] | None = None
    span: int = 1


class Page:
    """Renders one page; ``feed`` it once."""

    def __init__(self) -> None:
        self.stack = [Open("html", Box())]
        self.boxes = [self.stack[0].box]
        self.tables: list[Open] = []
        self.lists: list[Open] = []
        self.opened: Counter[str] = Counter()  # open elements by tag, so that no lookup walks a deep stack
        self.body = False  # whether the page's body has begun, with or without its tag

    def box(self) -> Box:
        return self.boxes[-1]

    def feed(self, source: str) -> str:
        at = 0
        while at < len(source):
            m = _TAG.search(source, at)
            if not m:
                break
            self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if (self.opened["svg"] or self.opened["math"]) and source.startswith("<![CDATA[", m.start()):
                    stop = source.find("]]>", m.start() + 9)
                    stop, at = (len(source), len(source)) if stop < 0 else (stop, stop + 3)
                    self.text(source[m.start() + 9 : stop], False)
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.open(tag, m[3])
            if tag in RAW and not self.empty(m[3]):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if tag in ("textarea", "xmp"):
                    self.text(source[at:stop], tag == "textarea")
                at = stop
        else:
            at = len(source)
        self.text(source[at:])
        while len(self.stack) > 1:
            self.pop()
        return "\n".join(self.stack[0].box.text())

    def empty(self, raw: str) -> bool:
        """Whether a start tag closes itself, as it can in drawings and formulas only."""
        return raw.endswith("/") and bool(self.opened["svg"] or self.opened["math"]) and not _UNQUOTED_END.search(raw)

    def text(self, raw: str, unescape: bool = True) -> None:
        if self.stack[-1].tag in ("head", "html") and raw.strip(" \t\n\f\r"):
            self.end_head()
        if not raw or self.stack[-1].gone or self.stack[-1].veiled:
            return
        text = entities.unescape(raw) if unescape and "&" in raw else raw
        if self.opened["pre"]:
            self.box().raw(text)
        elif self.stack[-1].tag not in ("table", "tr", "tbody", "thead", "tfoot") or text.strip(" \t\n\f\r"):
            self.box().words(text)

    def end_head(self) -> None:
        self.body = True
        if self.stack[-1].tag == "head":
            self.pop()

    def open(self, tag: str, raw: str) -> None:
        if self.stack[-1].tag in ("head", "html") and tag not in HEAD:
            self.end_head()
        if tag == "head" and (self.body or self.opened["head"]):
            return  # a second head, or one inside the body, is none
        if tag in ENDS_P and self.opened["p"]:
            self.close("p", implied=True)
        if tag in IMPLIED_SETS:
            ends, bounds = IMPLIED_SETS[tag]
            self.close_any(ends, bounds)
        named = attributes(raw) if raw.strip() else {}
        style = named.get("style", "")
        gone = self.stack[-1].gone or tag in UNSEEN or any(tag in inner and self.opened[t] for t, inner in UNSEEN_IN.items()) or "hidden" in named or (tag == "dialog" and "open" not in named) or bool(_GONE.search(style))
        said = _VISIBILITY.findall(style)
        veiled = said[-1].lower() in ("hidden", "collapse") if said else self.stack[-1].veiled
        unseen = gone or veiled
        if tag == "img" and not unseen and named.get("alt"):
            self.box().words(" " + named["alt"] + " ")
        if tag == "input" and not unseen and named.get("type", "text").lower() in ("submit", "button", "reset", "text") and named.get("value"):
            self.box().words(" " + named["value"] + " ")
        if tag == "br" and not unseen:
            box = self.box()
            box.end_line() if box.line else box.lines.append("")
        if tag == "hr" and not unseen:
            self.box().end_line()
            self.box().blank = True
        if tag in VOID or self.empty(raw):
            return
        new = Open(tag, gone=gone, veiled=veiled)
        if not gone:
            self.start(new, named)
        self.stack.append(new)
        self.opened[tag] += 1
        for kind, own in ((self.boxes, new.box), (self.tables, new if tag == "table" and not gone else None), (self.lists, new if tag in ("ul", "ol", "menu") else None)):
            if own is not None:
                kind.append(own)

    def start(self, new: Open, named: dict[str, str]) -> None:
        tag, box = new.tag, self.box()
        if tag in BLOCKS:
            box.end_line()
            nested = tag in ("ul", "ol") and self.opened["li"]
            box.blank |= tag in SPACED and not nested
        if tag == "text" and self.opened["svg"]:
            box.gap = bool(box.line)
        if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", named.get("start", "")):
            new.count = int(named["start"]) - 1
        deep = len(self.boxes) > MOST_BOXES
        if deep and tag == "li":
            box.line.append(self.mark())
        if deep and tag in ("td", "th"):
            box.gap = bool(box.line)
        if tag == "table" and not deep:
            new.rows = []
        table = self.table()
        if tag == "tr" and table and table.rows is not None:
            table.rows.append([])
        if tag in ("td", "th") and table and table.rows is not None:
            if not table.rows:
                table.rows.append([])
            span = named.get("colspan", "1")
            new.span = min(1000, max(1, int(span))) if span.isascii() and span.isdigit() and len(span) < 9 else 1
        if not deep and tag in ("li", "dd", "blockquote", "td", "th", "caption", "table"):
            new.box = Box()

    def mark(self) -> str:
        """The bullet or number of the next item of the innermost list."""
        up = self.lists[-1] if self.lists else None
        if up is None or up.tag != "ol":
            return "- "
        up.count += 1
        return f"{up.count}. "

    def table(self) -> Open | None:
        return self.tables[-1] if self.tables else None

    def close(self, tag: str, implied: bool = False) -> None:
        if tag == "p" and not implied and not self.opened["p"]:
            if not self.stack[-1].gone:
                self.box().end_line()
                self.box().blank = True
            return
        if not self.opened[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                while len(self.stack) > depth:
                    self.pop()
                return
            if self.stack[depth].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                return

    def close_any(self, ends: frozenset[str], bounds: frozenset[str]) -> None:
        if not any(self.opened[t] for t in ends):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in bounds:
                return
            if self.stack[depth].tag in ends:
                low = depth
                while low > 1 and self.stack[low - 1].tag in ends:
                    low -= 1
                while len(self.stack) > low:
                    self.pop()
                return

    def pop(self) -> None:
        done = self.stack.pop()
        self.opened[done.tag] -= 1
        if done.box is not None:
            self.boxes.pop()
        if self.tables and self.tables[-1] is done:
            self.tables.pop()
        if self.lists and self.lists[-1] is done:
            self.lists.pop()
        if done.gone:
            return
        outer = self.box()
        if done.box is not None:
            lines = done.box.text()
            if done.tag in ("td", "th") and (table := self.table()) and table.rows:
                table.rows[-1].append((lines, done.span))
            elif done.rows is not None:
                self.emit(outer, lines + aligned(done.rows))
            elif done.tag == "li":
                mark = self.mark()
                self.emit(outer, [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines or [""])] if lines else [])
            elif done.tag == "blockquote":
                self.emit(outer, ["> " + x if x else ">" for x in lines])
            elif done.tag == "dd":
                self.emit(outer, ["    " + x if x else "" for x in lines])
            else:
                self.emit(outer, lines)
        elif done.tag in BLOCKS:
            outer.end_line()
        elif done.tag == "text" and self.opened["svg"]:
            outer.gap = bool(outer.line)
        nested = done.tag in ("ul", "ol") and self.opened["li"]
        outer.blank |= done.tag in SPACED and not nested

    @staticmethod
    def emit(box: Box, lines: list[str]) -> None:
        for i, x in enumerate(lines):
            box.put(x) if i == 0 else box.lines.append(x)


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of cells in columns as wide as their widest one-column cell, two blanks apart; cells may have several lines."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *map(width, lines)])
            at += span
    out = []
    for row in rows:
        for k in range(max([len(lines) for lines, _ in row], default=0)):
            line, at, place, want = [], 0, 0, 0
            for lines, span in row:
                text = lines[k] if k < len(lines) else ""
                line.append(" " * max(0, want - place) + text)
                place = max(place, want) + width(text)
                want += sum(widths.get(c, 0) + 2 for c in range(at, at + span))
                want = max(want, place + 2) if text else want
                at += span
            out.append("".join(line).rstrip())
    return out


def render(source: str | None) -> str | None:
    """The visible text of a page; null stays null, an empty page is empty."""
    return None if source is None else Page().feed(source)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``html`` replaced by its visible ``text``; other columns stay.

    A column already called ``text`` is replaced. Repeated rows are rendered each.
    """
    rows = pages.drop(text) if text != html else pages
    schema = StructType([*[f for f in rows.schema.fields if f.name != html], StructField(text, StringType())])
    return map_texts(rows, html, schema, lambda: lambda sources: [pa.array([render(s) for s in sources], pa.string())])
