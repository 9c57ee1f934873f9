"""HTML extraction by layout-aware rendering.

The tree builder turns markup into balanced events: it supplies tags that HTML implies (a list item
ends the one before, a block ends a paragraph, a row belongs to a table) and ends what is left open.
The renderer walks the events once, without recursion, so depth of nesting is no limit: visibility
rules drop hidden parts, blocks are spaced as they are laid out, lists get marks and indents, and the
cells of a table are aligned in columns.  Alignment and indents are bounded, so the text is at most a small
multiple of the page, and every scan of the markup is linear, whatever is left open in it.
"""

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: The most that lists are indented, and the widest cell that a column is aligned to.
INDENT, ALIGNED = 64, 64
#: Most characters that alignment makes of one of a row's own; a row beyond that is written without.
GROWTH = 16

# Fixed values of the markup language: which elements are empty, raw, invisible, blocks or spaced.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe object audio video canvas datalist".split())
#: Drawings and formulas, and what HTML is in again; of their elements, those that are not shown and those that are labels.
ROOTS = frozenset("svg math foreignobject".split())
METADATA = frozenset("annotation annotation-xml title desc defs metadata symbol clippath mask pattern marker".split())
LABELS = frozenset("text mi mn mo ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header "
                            "hgroup html legend li main menu nav section summary tr caption".split())
#: Element -> (elements that its start ends, elements that this does not reach beyond).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption".split())
HEAD = frozenset("base link meta title style script noscript template head html".split())

Event = tuple[str, str, dict]


class Closing:
    """First ``mark`` outside of quotes from a place on.

    Answers are kept by the quotes and marks that they pass, so all questions together cost one
    pass over the source.
    """

    def __init__(self, source: str, mark: str):
        self.source, self.mark = source, mark
        self.special = re.compile(f"[\"'{re.escape(mark)}]")
        self.known: dict[int, int] = {}
        self.run = (0, -1)
        self.none_from = len(source)

    def _next(self, at: int) -> int:
        """The next quote or mark."""
        if at >= self.none_from:
            return -1
        if not self.run[0] <= at <= self.run[1]:
            found = self.special.search(self.source, at)
            if not found:
                self.none_from = at
                return -1
            self.run = (at, found.start())
        return self.run[1]

    def __call__(self, at: int) -> int:
        passed = []
        while True:
            place = self._next(at)
            if place < 0 or place in self.known:
                found = self.known.get(place, -1)
                break
            passed.append(place)
            if self.source[place] == self.mark:
                found = place
                break
            end = self.source.find(self.source[place], place + 1)
            if end < 0:
                found = -1
                break
            at = end + 1
        for place in passed:
            self.known[place] = found
        return found


class Markup:
    """Tags, comments and declarations of a page, in order."""

    def __init__(self, source: str):
        self.source, self.closing, self.last = source, Closing(source, ">"), source.rfind(">")

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, tag, attributes) of what follows; comments and declarations have no tag."""
        while (at := self.source.find("<", at)) >= 0:
            if self.source.startswith("<!--", at):
                end = self.source.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(self.source), False, "", ""
            if self.source[at + 1: at + 2] in ("!", "?"):
                if at < self.last:
                    return at, self.source.index(">", at) + 1, False, "", ""
            elif (name := NAME.match(self.source, at)) and (end := self.closing(name.end())) >= 0:
                return at, end + 1, bool(name[1]), name[2].lower(), self.source[name.end(): end]
            at += 1
        return None


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in ATTRIBUTE.finditer(source)}


def tree_events(source: str) -> Iterator[Event]:
    """("start" | "end", tag, attributes) and ("text", text, {}), balanced and with implied tags."""
    open_: list[str] = []
    counts: dict[str, int] = {}
    roots: list[str] = []

    def start(tag: str, found: dict) -> Event:
        open_.append(tag)
        counts[tag] = counts.get(tag, 0) + 1
        if tag in ROOTS:
            roots.append(tag)
        return "start", tag, found

    def end() -> Event:
        tag = open_.pop()
        counts[tag] -= 1
        if tag in ROOTS:
            roots.pop()
        return "end", tag, {}

    def reach(tags: set | frozenset, border: set | frozenset) -> int:
        """How many elements end with the innermost open one of ``tags`` inside ``border``; 0 without one."""
        if any(counts.get(t) for t in tags):
            for n, tag in enumerate(reversed(open_), 1):
                if tag in tags:
                    return n
                if tag in border:
                    return 0
        return 0

    at, markup = 0, Markup(source)
    while at < len(source):
        found = markup.next(at)
        text = source[at: found[0] if found else len(source)]
        if text:
            if counts.get("head") and text.strip():
                for _ in range(reach({"head"}, set())):
                    yield end()
            yield "text", html.unescape(text), {}
        if not found:
            break
        begin, at, ends, tag, inside = found
        foreign = roots and roots[-1] != "foreignobject"
        if not tag:
            if foreign and source.startswith("<![CDATA[", begin):
                close = source.find("]]>", begin)
                yield "text", source[begin + 9: close if close >= 0 else len(source)], {}
                at = close + 3 if close >= 0 else len(source)
            continue
        if ends:
            # An inline element that a block was opened in stays open: its end tag ends no block.
            n = reach({tag}, set() if tag in SCOPE else SCOPE if tag in BLOCKS else BLOCKS | SCOPE)
            for _ in range(n):
                yield end()
            if not n and tag in ("p", "br"):
                yield "start", tag, {}
                yield "end", tag, {}
            continue
        if tag not in HEAD and counts.get("head"):
            for _ in range(reach({"head"}, set())):
                yield end()
        if tag in BLOCKS:
            for _ in range(reach({"p"}, SCOPE)):
                yield end()
        if tag in IMPLIED:
            # Of a row or a group of rows, all that is inside the table ends.
            ended, border = IMPLIED[tag]
            while n := reach(ended, border):
                for _ in range(n):
                    yield end()
                if tag in ("li", "dt", "dd"):
                    break
        if tag in ("td", "th") and counts.get("table") and not reach({"tr"}, {"table"}):
            yield start("tr", {})
        opened = start(tag, attributes(inside))
        yield opened
        # Only drawings and formulas have elements that end themselves.
        if tag in VOID or (foreign and inside.endswith("/")):
            yield end()
        elif tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            yield "text", source[at: close.start() if close else len(source)], {}
            at = close.end() if close else len(source)
            yield end()
    while open_:
        yield end()


def declarations(style: str) -> Iterator[str]:
    """What is between semicolons that are in no quotes or brackets; one that is never closed encloses nothing."""
    closing, unclosed, begin, at = Closing(style, ")"), set(), 0, 0
    while at < len(style):
        c = style[at]
        if c == ";":
            yield style[begin:at]
            begin = at + 1
        elif c in "\"'" and c not in unclosed:
            end = style.find(c, at + 1)
            if end < 0:
                unclosed.add(c)
            at = max(at, end)
        elif c == "(":
            at = max(at, closing(at + 1))
        at += 1
    yield style[begin:]


def declared(style: str) -> dict[str, str]:
    """Properties of a style attribute; of several the last counts, one that is important before others."""
    found, important = {}, set()
    for declaration in declarations(COMMENT.sub(" ", style.lower())):
        name, _, value = declaration.partition(":")
        name, value = name.strip(), value.strip()
        plain = re.sub(r"\s*!\s*important$", "", value)
        if plain != value:
            important.add(name)
        elif name in important:
            continue
        found[name] = plain
    return found


def hidden(tag: str, found: dict, foreign: bool) -> bool:
    """Whether an element is not shown; ``foreign`` in drawings and formulas, where attributes are properties too."""
    style = {**(found if foreign else {}), **declared(found.get("style", ""))}
    return (tag in UNSEEN or (foreign and tag in METADATA) or "hidden" in found or style.get("display") == "none"
            or style.get("visibility") == "hidden" or (tag == "input" and found.get("type", "").lower() == "hidden"))


class _Flow:
    """Lines of a column of text: inline text is collected and broken off at blocks."""

    def __init__(self):
        self.lines: list[str] = []
        #: Characters of text that went in, without what layout adds.
        self.weight = 0
        self.current = ""
        self.lead = self.indent = ""
        self.gap = False

    def add(self, text: str, kept: bool) -> None:
        self.weight += len(text)
        if kept:
            first, *more = text.split("\n")
            self.current += first
            for line in more:
                self.break_line(keep=True)
                self.current = line
            return
        words = text.split()
        if text[:1].isspace() and self.current and not self.current.endswith(" "):
            self.current += " "
        self.current += " ".join(words)
        if words and text[-1:].isspace():
            self.current += " "

    def break_line(self, keep: bool = False) -> None:
        line = self.current if keep else self.current.strip()
        self.current = ""
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.lead + line).rstrip())
            self.lead = self.indent

    def space(self) -> None:
        self.break_line()
        self.gap = True


class _Table:
    def __init__(self):
        #: Per row the cells: lines, columns and weight.
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        """Rows with columns as wide as their widest cell up to ``ALIGNED``; a cell over several columns widens none.

        Wider lines are not filled up, and what follows them stands where they end.  A row that alignment
        would make more than ``GROWTH`` times as long as it is keeps single gaps between its cells.
        """
        widths: dict[int, int] = {}
        for row in self.rows:
            column = 0
            for text, span, _ in row:
                if span == 1:
                    widths[column] = max([widths.get(column, 0), *(n for n in map(len, text) if n <= ALIGNED)])
                column += span
        out = []
        for row in self.rows:
            out += self._row(row, widths)
        return [x for x in out if x]

    def _row(self, row: list[tuple[list[str], int, int]], widths: dict[int, int]) -> list[str]:
        room, column, filled = [], 0, 0
        for text, span, _ in row:
            room.append(min(ALIGNED, sum(widths.get(c, 0) for c in range(column, min(column + span, len(widths)))) + 2 * (span - 1)))
            column += span
        height = max([1, *(len(text) for text, _, _ in row)])
        for i in range(height if row else 0):
            last = max((k for k, (text, _, _) in enumerate(row) if i < len(text)), default=-1)
            filled += sum(room[:last]) + 2 * last + (len(row[last][0][i]) if last >= 0 else 0)
            if filled > GROWTH * (sum(w for _, _, w in row) + 4 * len(row)):
                return ["  ".join(text[k] for text, _, _ in row if k < len(text)) for k in range(height)]
        out = []
        for i in range(height):
            line = ""
            for (text, _, _), width in zip(row, room):
                line += (text[i] if i < len(text) else "").ljust(width) + "  "
            out.append(line.rstrip())
        return out


def render(source: str | None) -> str:
    """The visible text of a page; null and empty pages give the empty text."""
    flows, tables, lists, rows = [_Flow()], [], [], []
    unseen = pre = 0
    #: Open drawings, formulas and HTML inside them, each with whether it has had a label.
    roots: list[list] = []
    for kind, value, found in tree_events(source or ""):
        flow = flows[-1]
        if kind == "text":
            if not unseen:
                flow.add(value, bool(pre))
            continue
        foreign = bool(roots) and roots[-1][0] != "foreignobject"
        if unseen or (kind == "start" and hidden(value, found, foreign or value in ("svg", "math"))):
            unseen += (1 if kind == "start" else -1)
            continue
        if value in ROOTS:
            roots.append([value, False]) if kind == "start" else roots.pop()
        elif foreign and kind == "start" and value in LABELS:
            if roots[-1][1]:
                flow.add(" ", False)
            roots[-1][1] = True
        if kind == "start":
            if value == "br":
                flow.break_line(keep=bool(flow.current) or bool(flow.lines))
                continue
            if value in SPACED and not lists:
                flow.space()
            elif value in BLOCKS:
                flow.break_line()
            if value == "pre":
                pre += 1
            elif value in ("ul", "ol", "menu", "dl"):
                lists.append([value, 0, flow.indent])
            elif value == "li":
                outer = lists[-1] if lists else ["ul", 0, ""]
                outer[1] += 1
                mark = f"{outer[1]}. " if outer[0] == "ol" else "- "
                flow.lead, flow.indent = outer[2] + mark, (outer[2] + " " * len(mark))[:INDENT]
            elif value == "table":
                tables.append(_Table())
                rows.append(len(flows))
            elif value == "tr" and tables:
                tables[-1].rows.append([])
            elif value in ("td", "th") and tables and tables[-1].rows:
                span = found.get("colspan", "")
                tables[-1].rows[-1].append(([], min(max(int(span), 1), 1000) if span.isdecimal() and len(span) < 9 else 1, 0))
                flows.append(_Flow())
            elif value in ("td", "th"):
                flow.add(" ", False)
            continue
        if value == "pre":
            flow.break_line(keep=True) if flow.current.strip() else flow.break_line()
            pre -= 1
        if value in ("td", "th") and tables and len(flows) > rows[-1]:
            flow.break_line()
            flows.pop()
            _, span, _ = tables[-1].rows[-1].pop()
            tables[-1].rows[-1].append(([x for x in flow.lines if x], span, flow.weight))
            continue
        if value == "table" and tables:
            table = tables.pop()
            rows.pop()
            flow.weight += sum(weight for row in table.rows for _, _, weight in row)
            for line in table.lines():
                flow.current = line
                flow.break_line(keep=True)
        if value in SPACED and not lists:
            flow.space()
        elif value in BLOCKS:
            flow.break_line()
        if value in ("ul", "ol", "menu", "dl") and lists:
            flow.lead = flow.indent = lists.pop()[2]
            if not lists:
                flow.space()
        elif value == "li":
            flow.lead = flow.indent = lists[-1][2] if lists else ""
    while len(flows) > 1:
        flows.pop().break_line()
    flows[0].break_line()
    return "\n".join(flows[0].lines).strip("\n")


def visible_text(pages: DataFrame, id: str = "page_id", source: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep`` and the rendered text of every row.

    Null and empty pages give the empty text; rows are independent, whatever repeats.  Markup that is
    no HTML is text.  Other columns are ignored.
    """
    @F.pandas_udf("string")
    def rendered(pages: pd.Series) -> pd.Series:
        return pages.map(render)

    return pages.select(F.col(id), *keep, rendered(F.col(source)).alias("text"))
