"""Layout-aware text of HTML pages.

A tokenizer and tree builder with implied start and end tags feed a renderer that
leaves out what isn't visible and keeps block spacing, line breaks, lists and
table columns.  Everything works on explicit stacks, so deep nesting is harmless.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import as_bytes, map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas annotation annotation-xml desc metadata meta link base area map param source track col colgroup".split())
#: Blocks, and the blank lines around each.
BLOCK = {
    **dict.fromkeys("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav option optgroup search section summary tr tbody thead tfoot td th caption".split(), 0),
    **dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing plaintext".split(), 1),
}
IN_HEAD = frozenset("base link meta title style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag of other names doesn't reach beyond these.
SCOPE = frozenset("table td th caption template html".split())
TABLE = frozenset("table tr td th thead tbody tfoot caption colgroup".split())
#: A start tag ends the nearest of these, unless one of those lies between.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | SCOPE),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"]) | SCOPE),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"]) | SCOPE),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | SCOPE),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])),
}
#: Levels by which lists are set in; deeper ones stand below each other.
LEVELS = 12

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=|\"|')*+(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Text:
    """Lines being filled: white space collapses, blocks ask for lines of their own."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.mark = ""
        self.level = 0

    def line(self) -> None:
        """End the line, if there is one."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
        self.now, self.space = [], False

    def block(self, blank: int) -> None:
        self.line()
        self.gap = max(self.gap, blank)

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.now.append("  " * max(0, min(self.level, LEVELS) - bool(self.mark)) + self.mark)
            self.mark = ""

    def add(self, text: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if k:
                    self.br()
                if part:
                    self._begin()
                    self.now.append(part)
            return
        parts = _SPACE.sub(" ", text)
        if parts.startswith(" "):
            self.space = True
        if word := parts.strip(" "):
            blank = self.space and bool(self.now)
            self._begin()
            self.now.append(" " + word if blank else word)
            self.space = parts.endswith(" ")

    def br(self) -> None:
        if self.now:
            self.line()
        elif self.lines and not self.gap:
            self.lines.append("")

    def laid(self, lines: list[str]) -> None:
        """Lines whose inner spacing stays."""
        for x in lines:
            self._begin()
            self.now.append(x)
            self.line()

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Rows of cells, each with its column: cells of rows above may reach down into a row."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str], int]]] = []
        self.caption: list[str] = []
        self.held: dict[int, int] = {}  # columns that are taken, for so many rows, this one counted
        self.at = 0

    def row(self) -> None:
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1}
        self.rows.append([])
        self.at = 0

    def cell(self, lines: list[str], span: int, deep: int) -> None:
        if not self.rows:
            self.row()
        while self.at in self.held:
            self.at += 1
        self.rows[-1].append((self.at, lines, span))
        if deep > 1:
            self.held.update(dict.fromkeys(range(self.at, self.at + span), deep))
        self.at += span

    def laid(self) -> list[str]:
        """Columns as wide as their widest cell of one column; a wider cell that spans several may stick out."""
        width: Counter = Counter()
        for at, lines, span in (cell for row in self.rows for cell in row):
            if span == 1:
                width[at] = max(width[at], max(map(len, lines), default=0))
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                line, want, done = "", 0, 0
                for at, lines, _ in row:
                    want += sum(width[c] + 2 for c in range(done, at))
                    done = at
                    if k < len(lines) and lines[k]:
                        line = line.ljust(want) if len(line) <= want else line + "  "
                        line += lines[k]
                out.append(line.rstrip(" "))
        return out


def _number(attributes: dict[str, str], name: str) -> int:
    """Columns or rows of a cell; a rowspan of 0 reaches to the end."""
    said = attributes.get(name, "1").strip()
    return int(said) if said.isdecimal() and len(said) < 6 else 1


class Renderer:
    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []  # name, and whether it hides
        self.count: Counter = Counter()
        self.unseen = 0
        self.texts = [Text()]
        self.tables: list[Table] = []
        self.spans: list[tuple[int, int]] = []
        self.lists: list[list] = []  # kind, next number

    def _push(self, name: str, hides: bool) -> None:
        self.open.append((name, hides))
        self.count[name] += 1
        self.unseen += hides
        if self.unseen:
            return
        text = self.texts[-1]
        if name == "table":
            text.block(BLOCK[name])
            self.tables.append(Table())
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name in ("td", "th", "caption") and self.tables:
            self.texts.append(Text())
        elif name in BLOCK:
            text.block(0 if name in ("ul", "ol") and self.lists else BLOCK[name])
            if name in ("ul", "ol", "menu", "dir"):
                self.lists.append([name, 1])
                text.level += 1
            elif name == "li":
                kind = self.lists[-1] if self.lists else ["ul", 1]
                text.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
            elif name == "dd":
                text.level += 1

    def _pop(self) -> None:
        name, hides = self.open.pop()
        self.count[name] -= 1
        self.unseen -= hides
        if self.unseen or hides:
            return
        if name == "table":
            table = self.tables.pop()
            self.texts[-1].laid(table.laid())
            self.texts[-1].block(BLOCK[name])
        elif name in ("td", "th", "caption") and self.tables:
            lines = self.texts.pop().done()
            if name == "caption":
                self.tables[-1].caption += lines
            else:
                self.tables[-1].cell(lines, *self.spans.pop())
        elif name in BLOCK and not (name == "tr" and self.tables):
            text = self.texts[-1]
            text.block(0 if name in ("ul", "ol") and len(self.lists) > 1 else BLOCK[name])
            if name in ("ul", "ol", "menu", "dir"):
                self.lists.pop()
                text.level -= 1
            elif name == "li":
                text.mark = ""
            elif name == "dd":
                text.level -= 1

    def _close(self, names: frozenset, stop: frozenset) -> bool:
        """End the elements down to the last of ``names``, if none of ``stop`` lies above it."""
        if not any(self.count[n] for n in names):
            return False
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in names:
                while len(self.open) > i:
                    self._pop()
                return True
            if name in stop:
                return False
        return False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if self.count["head"] and name not in IN_HEAD and name not in ("head", "html"):
            self._close(frozenset(["head"]), frozenset())
        if name in ("html", "body", "head") and self.count[name]:
            return
        if name in BLOCK and name not in TABLE or name == "table":
            self._close(frozenset(["p"]), SCOPE | {"button"})
        if name in HEADINGS:
            if self.open and self.open[-1][0] in HEADINGS:
                self._pop()
        elif name in ENDS:
            while self._close(*ENDS[name]) and name in ("optgroup", "thead", "tbody", "tfoot"):
                pass
        if name in ("td", "th") and self.count["table"] and not self._inside("tr"):
            self._push("tr", False)
        if name in VOID:
            if not self.unseen and not self._hides(name, attributes):
                if name == "br":
                    self.texts[-1].br()
                elif name == "hr":
                    self.texts[-1].block(1)
            return
        hides = self._hides(name, attributes)
        if name in ("td", "th") and not hides and not self.unseen and self.tables:
            self.spans.append((max(1, min(1000, _number(attributes, "colspan"))), _number(attributes, "rowspan") or 65534))
        self._push(name, hides)

    def _inside(self, name: str) -> bool:
        """In a row of the innermost table."""
        return next((n == name for n, _ in reversed(self.open) if n in ("table", name)), False)

    @staticmethod
    def _hides(name: str, attributes: dict[str, str]) -> bool:
        if name in HIDDEN or "hidden" in attributes and attributes["hidden"].lower() != "until-found":
            return True
        if name == "dialog" and "open" not in attributes or name == "input":
            return True
        return bool("style" in attributes and _UNSEEN.search(attributes["style"]))

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name in ("body", "html"):
            return  # what follows is still shown
        elif name in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif name in BLOCK or name in TABLE or name in HIDDEN or name in RAW:
            self._close(frozenset([name]), frozenset(["table"]) if name in TABLE else SCOPE - {name})
        elif self.count[name]:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == name:
                    if any(n in BLOCK for n, _ in self.open[i + 1 :]):  # blocks outlast a format that ends inside
                        _, hides = self.open.pop(i)
                        self.count[name] -= 1
                        self.unseen -= hides
                    else:
                        while len(self.open) > i:
                            self._pop()
                    return
                if self.open[i][0] in SCOPE:
                    return

    def text(self, text: str) -> None:
        if self.count["head"] and text.strip() and self.open[-1][0] == "head":
            self._pop()
        if not self.unseen and text:
            self.texts[-1].add(text, bool(self.count["pre"] or self.count["textarea"] or self.count["listing"] or self.count["xmp"] or self.count["plaintext"]))

    def done(self) -> str:
        while self.open:
            self._pop()
        return "\n".join(self.texts[0].done())


def render(page: str) -> str:
    """The visible text of a page."""
    page = page.replace("\x00", "")
    low = page.lower() if len(page.lower()) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
    out, at = Renderer(), 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            out.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            out.text(html.unescape(page[at : m.start()]))
        at, tag = m.end(), m[0]
        if tag.startswith("<![CDATA["):
            out.text(tag[9:].removesuffix("]]>"))
        elif name := _NAME.match(tag):
            if not tag.endswith(">"):
                continue  # the page ends in it
            kind = name[1].lower()
            if tag[1] == "/":
                out.end(kind)
                continue
            attributes: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(tag, name.end(), len(tag) - 1):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            out.start(kind, attributes)
            if kind in RAW:
                end = -1 if kind == "plaintext" else low.find(f"</{kind}", at)
                body = page[at:] if end < 0 else page[at:end]
                out.text(html.unescape(body) if kind in ("textarea", "title") else body)
                at = len(page) if end < 0 else end
                if end < 0:
                    break
    return out.done()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) for every row; null and empty pages have the empty text.

    Repeated rows repeat, other columns aren't read, bytes that aren't UTF-8 are
    replaced.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [render((page or b"").decode("utf-8", "replace")) for page in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["page_id", "text"])

    return map_arrow(pages.select(F.col(id_col).alias("page_id"), as_bytes(html_col).alias("html")), rows, f"page_id {kind}, text string")
