"""HTML extraction by layout-aware rendering.

A tree builder turns tags into properly nested starts and ends: it adds the tags that HTML lets authors leave out
(a paragraph ends where a block starts, a list item or table cell where the next one starts, a cell without a row opens one) and
drops ends without a start. A renderer follows the nesting with a stack, so depth is no limit: it leaves out what a
browser does not show (head, scripts, templates, hidden elements and the like), collapses white space except in
``pre``, sets blocks on lines of their own and paragraphs apart by an empty line, numbers or marks list items and
indents nested lists, and renders each table cell by itself to set the cells of a table in aligned columns.

A map over whole pages without a shuffle. Cases: null and empty html give empty text; text without any tag is a
paragraph; unclosed tags, comments and quotes end with the page; repeated rows and null ids give a row each; an empty table gives an
empty result. Only id and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import map_rows, query, table

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Elements by what HTML says of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript iframe noembed noframes object svg math canvas audio video datalist".split())
APART = set("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure table fieldset".split())
LISTS = set("ul ol menu dir".split())
BLOCKS = APART | LISTS | set(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup hr html legend li main nav option optgroup search section summary tbody td tfoot th thead tr".split()
)
#: What a start tag ends if it is open, and what it cannot reach beyond.
ENDS = {
    "li": ({"li"}, LISTS | {"td", "th", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, set()),
}
CLOSES_P = (BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "option", "optgroup", "caption"}) | {"li"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of texts, starts and ends in the order of the page."""
    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at:
            yield "text", "", page[at : tag.start()]
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            yield "end", name, ""
            continue
        yield "start", name, tag[3] or tag[6] or ""
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            body, at = (page[at:], len(page)) if stop is None else (page[at : stop.start()], stop.start())
            if body:
                yield "text", "", body
    if at < len(page):
        yield "text", "", page[at:]


def events(page: str) -> Iterator[tuple[str, str, object]]:
    """Properly nested (start, name, attributes), (text, '', text) and (end, name, None)."""
    open_: list[str] = []
    count: dict[str, int] = {}

    def push(name: str, attributes: dict) -> Iterator:
        open_.append(name)
        count[name] = count.get(name, 0) + 1
        yield "start", name, attributes

    def pop_to(size: int) -> Iterator:
        while len(open_) > size:
            name = open_.pop()
            count[name] -= 1
            yield "end", name, None

    def place(names: set[str], stops: set[str]) -> int | None:
        if not any(count.get(n) for n in names):
            return None
        for k in range(len(open_) - 1, -1, -1):
            if open_[k] in names:
                return k
            if open_[k] in stops:
                return None
        return None

    for kind, name, rest in _pieces(page):
        if kind == "text":
            yield "text", "", rest
        elif kind == "start":
            if name in CLOSES_P and (k := place({"p"}, {"td", "th", "table", "button", "object", "caption"})) is not None:
                yield from pop_to(k)
            if name in ENDS and (k := place(*ENDS[name])) is not None:
                yield from pop_to(k)
            if name in ("td", "th") and count.get("table") and place({"tr"}, {"table"}) is None:
                yield from push("tr", {})
            yield from push(name, _attributes(rest) if rest.strip(" \n\t/") else {})
            if name in VOID:
                yield from pop_to(len(open_) - 1)
        else:
            inner = set() if name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else {"td", "th", "table"}
            if (k := place({name}, inner)) is not None:
                yield from pop_to(k)
            elif name == "br":
                yield from push("br", {})
                yield from pop_to(len(open_) - 1)
    yield from pop_to(0)


class Canvas:
    """Lines of text that grow from above: the page, or one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indents: list[str] = []
        self.mark: str | None = None

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.line.append(text)

    def feed(self, forced: bool = False) -> None:
        """End the line."""
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if text or forced or self.mark:
            self.put([text])

    def put(self, lines: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indents)
        for text in lines:
            if self.mark is not None:
                text, self.mark = f"{indent[: len(indent) - len(self.mark)]}{self.mark}{text}", None
            else:
                text = indent + text
            self.lines.append(text.rstrip(" "))

    def apart(self, gap: int) -> None:
        if self.line:
            self.feed()
        self.gap = max(self.gap, gap)


def _aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Cells in columns; a cell over several columns does not widen them."""
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for lines, span in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
            column += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            text, column = "", 0
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                text += (lines[k] if k < len(lines) else "").ljust(width) + "  "
                column += span
            out.append(text.rstrip(" "))
    return out


def render(page: str) -> str:
    """All visible text of a page, laid out."""
    canvas = Canvas()
    tables: list[tuple[Canvas, list, Canvas]] = []  # canvas round the table, its rows, what stands between cells
    lists: list[int | None] = []
    hidden = pre = 0
    for kind, name, more in events(page):
        if hidden:
            hidden += {"start": 1, "end": -1}.get(kind, 0)
        elif kind == "text":
            text = html.unescape(more)
            if pre:
                first, *others = text.split("\n")
                canvas.line.append(first)
                for line in others:
                    canvas.feed(forced=True)
                    canvas.line.append(line)
            else:
                canvas.write(text)
        elif kind == "start":
            if name in UNSEEN or "hidden" in more or _INVISIBLE.search(more.get("style", "")) or (name == "input" and more.get("type", "").lower() == "hidden"):
                hidden = 1
                continue
            if name in APART:
                canvas.apart(1)
            elif name in LISTS:
                canvas.apart(0 if lists else 1)
            elif name in BLOCKS:
                canvas.apart(0)
            if name == "br":
                canvas.feed(forced=True)
            elif name == "pre":
                pre += 1
            elif name in LISTS:
                lists.append(int(more.get("start", "1")) if name == "ol" and re.fullmatch(r"-?\d{1,9}", more.get("start", "1")) else 1 if name == "ol" else None)
            elif name == "li":
                number = lists[-1] if lists else None
                canvas.mark = "* " if number is None else f"{number}. "
                if number is not None:
                    lists[-1] = number + 1
                canvas.indents.append(" " * len(canvas.mark))
            elif name in ("blockquote", "dd"):
                canvas.indents.append("    ")
            elif name == "table":
                tables.append((canvas, [], stray := Canvas()))
                canvas = stray
            elif name == "tr" and tables:
                tables[-1][1].append([])
            elif name in ("td", "th") and tables:
                canvas = Canvas()
                span = more.get("colspan", "1")
                tables[-1][1][-1].append((canvas, min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,4}", span) else 1))
        else:
            if name in BLOCKS and name not in ("table", "td", "th"):
                canvas.apart(1 if name in APART or (name in LISTS and len(lists) < 2) else 0)
            if name == "pre":
                pre -= 1
            elif name in LISTS:
                lists.pop()
            elif name == "li":
                canvas.feed()
                canvas.indents.pop()
            elif name in ("blockquote", "dd"):
                canvas.indents.pop()
            elif name in ("td", "th") and tables:
                canvas.feed()
                canvas = tables[-1][2]
            elif name == "table":
                canvas.feed()
                canvas, rows, stray = tables.pop()
                lines = _aligned([[(c.lines, span) for c, span in row] for row in rows])
                canvas.apart(1)
                if stray.lines or lines:
                    canvas.put(stray.lines + lines)
                canvas.apart(1)
    canvas.feed()
    return "\n".join(canvas.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each page."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return map_rows(rows, lambda got: {"page_id": got["page_id"], "text": [render(x) for x in got["html"]]}, "page_id long, text string")


@query("op4_html_rendering")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return found.select("page_id", F.char_length("text").cast("long").alias("n_chars"), lines.alias("n_lines"), "text")
