"""Visible text of HTML pages, laid out as a reader would see it.

Tags go through a tree builder: a stack of open elements, to which implied tags are added and
from which elements that a tag closes by implication are taken (a paragraph by a block, an
item by the next item, a cell by the next cell, a head by content). Text is emitted if no open element is
hidden: by kind (head, script, style, template, …), by attribute (hidden, closed dialog or details), or by ``display: none``;
and if the innermost element that says so is visible (``visibility`` is inherited and may be set again inside).
Both properties come from the element's own style and from the style sheets before it: selectors of tags, ids and classes, compound, inside
others (``a b``) or right below them (``a > b``), by importance, specificity and order; rules of other selectors
(attributes, states, siblings) are passed over. Rules for media count if a screen ``SCREEN`` pixels wide has them; what is asked of a medium
besides its width is taken as not given. ``html`` and ``body`` are always seen.

Layout: white space collapses outside ``pre``; blocks begin new lines, and paragraphs, headings, lists, quotes and tables
are set off by an empty line; items get a mark or number and an indent; cells of a table
are aligned in columns, with spanned columns and rows left open.

Defined results: null and empty pages give empty text; a page cut off anywhere is laid out as
far as it goes; unknown tags are inline; unmatched end tags are ignored. Pages are rendered row by row.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from labelloom.llm import common

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes title textarea plaintext".split())
UNSEEN = set(
    "head script style template title noscript iframe noembed noframes object audio video canvas svg math datalist meta link base".split()
)
HEAD_ONLY = set("head title meta link base script style template noscript".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table ul caption legend "
    "optgroup option".split()
)
APART = set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre figure table".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "optgroup", "option"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LISTS = {"ul", "ol", "menu", "dir"}
SECTIONS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
# What an element ends when it begins, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, LISTS),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "a": ({"a"}, BLOCKS),
}
FENCES = {"table", "td", "th", "caption", "html"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CSS_MARK = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|([{};])")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_MEDIUM = re.compile(r"(?:(not|only)\s+)?([a-z-]+)?((?:\s*(?:and)?\s*\([^()]*\))*)")
_WIDTH = re.compile(r"(min|max)-width\s*:\s*([0-9.]+)(px|em|rem)")
# Width of the screen that rules for media are read for, and pixels of an em.
SCREEN, EM = 1280, 16


def on_screen(query: str) -> bool:
    """Whether a list of media has the screen; an empty one does."""
    return not query.strip() or any(_has_screen(" ".join(q.lower().split())) for q in query.split(","))


def _has_screen(query: str) -> bool:
    found = _MEDIUM.fullmatch(query)
    if found is None:
        return False
    holds = found[2] in (None, "all", "screen")
    for feature in re.findall(r"\(([^()]*)\)", found[3]):
        width = _WIDTH.fullmatch(feature.strip())
        if width is None or not re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", width[2]):
            return False
        limit = float(width[2]) * (1 if width[3] == "px" else EM)
        holds = holds and (SCREEN >= limit if width[1] == "min" else SCREEN <= limit)
    return holds != (found[1] == "not")


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """Importance and value of ``display`` and ``visibility`` among declarations, where they are given."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in body.split(";"):
        name, colon, value = declaration.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value, mark, _ = value.strip().lower().partition("!")
            if value.strip() and (bool(mark) or not found.get(name, (False, ""))[0]):
                found[name] = (bool(mark), value.strip())
    return found


def selector(text: str) -> tuple[list[tuple[frozenset, bool]], tuple[int, int, int]] | None:
    """Compounds from the outermost in, each with whether it is right below the last, and the specificity; None if unknown."""
    chain: list[tuple[frozenset, bool]] = []
    weight = [0, 0, 0]
    below = False
    for part in text.replace(">", " > ").split():
        if part == ">":
            if below or not chain:
                return None
            below = True
            continue
        found = _COMPOUND.fullmatch(part)
        if found is None:
            return None
        marks = re.findall(r"[.#][\w-]+", found[2])
        weight[0] += sum(m[0] == "#" for m in marks)
        weight[1] += sum(m[0] == "." for m in marks)
        if found[1] and found[1] != "*":
            marks.append(found[1].lower())
            weight[2] += 1
        chain.append((frozenset(marks), below))
        below = False
    return None if below or not chain else (chain, (weight[0], weight[1], weight[2]))


def marks_of(name: str, values: dict[str, str]) -> frozenset:
    """What selectors find an element by: its tag, #id and .classes."""
    own = ["#" + values["id"]] if values.get("id") else []
    return frozenset([name, *own, *["." + c for c in values.get("class", "").split()]])


class Sheet:
    """Rules on ``display`` and ``visibility``, by a mark (tag, #id, .class) that their element has."""

    def __init__(self) -> None:
        self.by_mark: dict[str, list] = {}
        self.order = 0

    def add(self, css: str) -> None:
        css = _COMMENT.sub(" ", css)
        blocks: list[bool] = []  # of the at-rules that are open, whether what is inside counts
        at = 0
        while (found := self._mark(css, at)) is not None:
            before, at = css[at : found.start()].strip(), found.end()
            if found[1] == "}":
                if blocks:
                    blocks.pop()
            elif found[1] == "{" and before.startswith("@"):
                kind, _, query = before[1:].replace("(", " (", 1).partition(" ")
                kind = kind.lower()
                blocks.append(kind == "layer" or (kind == "media" and on_screen(query)) or (kind == "supports" and not query.strip().lower().startswith("not")))
            elif found[1] == "{":
                end = at
                while (found := self._mark(css, end)) is not None and found[1] == ";":
                    end = found.end()
                body, at = css[at : found.start() if found else len(css)], found.end() if found else len(css)
                if all(blocks):
                    self._rule(before, declared(body))

    def _mark(self, css: str, at: int) -> re.Match | None:
        found = _CSS_MARK.search(css, at)
        while found is not None and not found[1]:
            found = _CSS_MARK.search(css, found.end())
        return found

    def _rule(self, selectors: str, properties: dict[str, tuple[bool, str]]) -> None:
        if properties:
            self.order += 1
            for found in map(selector, selectors.split(",")):
                if found is not None:
                    chain, weight = found
                    rule = (chain, (weight, self.order), properties)
                    self.by_mark.setdefault(min(chain[-1][0], default="*"), []).append(rule)

    def style(self, marks: frozenset, above: Callable[[], list[frozenset]], own: dict[str, tuple[bool, str]]) -> dict[str, str]:
        """Values that win for an element with ``marks``; ``above`` gives those of the elements around it, if a rule asks."""
        won: dict[str, tuple] = {}
        around = None
        for mark in (*marks, "*"):
            for chain, rank, properties in self.by_mark.get(mark, ()):
                if not chain[-1][0] <= marks:
                    continue
                if len(chain) > 1 and around is None:
                    around = above()
                if len(chain) == 1 or _inside(chain, around):
                    for name, (important, value) in properties.items():
                        won[name] = max(won.get(name, (False,)), (important, False, rank, value))
        for name, (important, value) in own.items():
            won[name] = max(won.get(name, (False,)), (important, True, value))
        return {name: found[-1] for name, found in won.items()}


def _inside(chain: list[tuple[frozenset, bool]], above: list[frozenset]) -> bool:
    """Whether elements of ``above``, from the outermost in, match all of ``chain`` but its last part."""
    ends = [False] * len(above)  # whether the parts so far match with the last of them here
    for n, (marks, below) in enumerate(chain):
        last = n == len(chain) - 1
        if last and below:
            return bool(ends) and ends[-1]
        if last:
            return any(ends)
        earlier, found = n == 0, []
        for at, here in enumerate(above):
            fits = (at > 0 and ends[at - 1]) if below else earlier
            found.append(fits and marks <= here)
            earlier = earlier or ends[at]
        ends = found
    return False


def unfold(entries: list) -> list[str]:
    """Lines of entries: a line, or a mark and the entries that it indents (no mark: taken as they are)."""
    out: list[str] = []
    # Entries still to come, prefixes of the next line and of those after it, whether lines end at their last mark.
    todo = [(iter(entries), "", False)]
    first = ""
    while todo:
        rest, indent, cut = todo[-1]
        for entry in rest:
            if isinstance(entry, str):
                out.append((first + entry).rstrip() if cut else first + entry)
                first = indent
            else:
                mark, inner = entry
                if mark is None:
                    todo.append((iter(inner), indent, cut))
                else:
                    first += mark
                    todo.append((iter(inner), indent + " " * len(mark), True))
                break
        else:
            todo.pop()
            first = todo[-1][1] if todo else ""
    return out


class Frame:
    """Lines of a block container (see ``unfold``), and the line being written."""

    def __init__(self) -> None:
        self.lines: list = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[0] == " " and (not self.inline or self.inline[-1][-1] in " \n"):
            text = text[1:]
        if text:
            self.inline.append(text)

    def flush(self) -> None:
        if self.inline:
            text = "".join(self.inline).rstrip(" \n")
            self.inline = []
            if text:
                self.add([line.strip(" ") for line in text.split("\n")])

    def add(self, lines: list) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.extend(lines)

    def block(self, apart: bool) -> None:
        self.flush()
        self.gap = self.gap or apart


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list, int, int]]] = []

    def lines(self) -> list:
        """Rows with their cells in columns; every column is as wide as its widest cell."""
        grid: list[dict[int, tuple[list, int]]] = []
        open_below: dict[int, int] = {}  # column: rows that a cell above still takes
        width: dict[int, int] = {}
        for row in self.rows:
            column, placed, below = 0, {}, {c: n - 1 for c, n in open_below.items() if n > 1}
            for lines, across, down in row:
                while open_below.get(column, 0) > 0:
                    column += 1
                placed[column] = (lines, across)
                for c in range(column, column + across):
                    if down > 1:
                        below[c] = down - 1
                column += across
            grid.append(placed)
            open_below = below
        if not any(column for placed in grid for column in placed):
            # Nothing is beside anything: tables in tables are not laid out anew at each level.
            return [(None, lines) for placed in grid for lines, _ in placed.values() if lines]
        grid = [{column: (unfold(lines), across) for column, (lines, across) in placed.items()} for placed in grid]
        for placed in grid:
            for column, (lines, across) in placed.items():
                if across == 1:
                    width[column] = max(width.get(column, 0), max(map(len, lines), default=0))
        for placed in grid:
            for column, (lines, across) in placed.items():
                if across > 1:
                    have = sum(width.get(c, 0) for c in range(column, column + across)) + 2 * (across - 1)
                    lacks = max(map(len, lines), default=0) - have
                    if lacks > 0:
                        last = column + across - 1
                        width[last] = width.get(last, 0) + lacks
        start, at = {}, 0
        for column in range(max(width, default=-1) + 1):
            start[column] = at
            at += width.get(column, 0) + 2
        out = []
        for placed in grid:
            for i in range(max((len(lines) for lines, _ in placed.values()), default=0)):
                line = ""
                for column, (lines, _) in sorted(placed.items()):
                    if i < len(lines) and lines[i]:
                        line = line.ljust(start.get(column, at)) + lines[i]
                out.append(line)
        return out


def _number(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and value.isascii() and value.isdigit() and len(value) < 6 else 1


class Page:
    """Renders one page."""

    def __init__(self) -> None:
        # Open elements: name, whether hidden, frame or table that it opened, number of its last item.
        self.open: list[list] = []
        # Places of the open elements of each name, from the outermost inwards.
        self.places: dict[str, list[int]] = {}
        self.frames = [Frame()]
        self.pre = 0
        self.sheet = Sheet()
        self.roots = {"html": frozenset({"html"}), "body": frozenset({"body"})}
        self.given: list[tuple[str, dict[str, str]]] = []  # name and attributes of the open elements
        self.visible = [True]  # of the page and the open elements

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _last(self, names: set[str]) -> int:
        """Place of the innermost open element of these names; else −1."""
        places = self.places
        return max((places[n][-1] for n in names if n in places), default=-1)

    def _first(self, names: set[str], outside: int) -> int:
        """Place of the outermost open element of these names inside the one at ``outside``; else −1."""
        found = [at[i] for n in names if (at := self.places.get(n)) and (i := bisect_right(at, outside)) < len(at)]
        return min(found, default=-1)

    def _depth(self, names: set[str], fences: set[str]) -> int:
        """Place of the innermost open element of these names, if no fence is inside; else −1."""
        at = self._last(names)
        return at if at >= 0 and self._last(fences) <= at else -1

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth >= 0:
            self._pop()

    def _pop(self) -> None:
        name, hidden, box, _ = self.open.pop()
        self.given.pop()
        self.visible.pop()
        places = self.places[name]
        places.pop()
        if not places:
            del self.places[name]
        if name == "pre":
            self.pre -= 1
        if hidden:
            return
        if name == "li" and box is not None:
            self.frames.pop()
            box.flush()
            at = self._last(LISTS)
            mark = "- "
            if at >= 0 and self.open[at][0] == "ol":
                self.open[at][3] += 1
                mark = f"{self.open[at][3]}. "
            self.frames[-1].add([(mark, box.lines or [""])])
        elif name in CELLS and box is not None:
            self.frames.pop()
            frame, table, across, down = box
            frame.flush()
            table.rows[-1].append((frame.lines, across, down))
        elif name == "table":
            frame = self.frames[-1]
            frame.block(True)
            lines = box.lines()
            if lines:
                frame.add(lines)
            frame.block(True)
        elif name in BLOCKS:
            self.frames[-1].block(name in APART and not self._tight(name))

    def _tight(self, name: str) -> bool:
        """A list inside an item is not set off."""
        return name in LISTS and self._depth({"li"}, {"table"}) >= 0

    def text(self, text: str) -> None:
        if not text or self.hidden() or (self.open and self.open[-1][0] == "details" and self.open[-1][3]):
            if text.strip() and self.open and self.open[-1][0] == "head":
                self._close_to(len(self.open) - 1)
                self.text(text)
            return
        if not self.visible[-1]:
            text = " " if not self.pre else ""  # its place is left open
        if "&" in text:
            text = html.unescape(text)
        frame = self.frames[-1]
        if not self.pre:
            frame.text(text)
            return
        frame.flush()
        frame.add([x.rstrip() for x in text.strip("\n").split("\n")])

    def start(self, name: str, attributes: str) -> None:
        if self.open and self.open[-1][0] == "head" and name not in HEAD_ONLY:
            self._close_to(len(self.open) - 1)
        values = {}
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                values.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if name in self.roots:
            self.roots[name] |= marks_of(name, values)
            return
        if name in CLOSES_P:
            self._close_to(self._depth({"p"}, FENCES))
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self._pop()
        if name in ENDS:
            ended, fences = ENDS[name]
            self._close_to(self._depth(ended, fences | FENCES))
        table = None
        if name in SECTIONS or name == "tr" or name in CELLS or name == "caption":
            at = self._depth({"table"}, set())
            if at < 0:
                return
            row = self._first({"tr"}, at)
            if name in CELLS:
                if row < 0:
                    self.start("tr", "")
                    row = self._first({"tr"}, at)
                self._close_to(row + 1)
            elif name == "tr":
                self._close_to(max(self._first(SECTIONS, at), at) + 1)
            else:
                self._close_to(at + 1)
            table = self.open[at][2]
        style = {}
        if self.sheet.by_mark or "style" in values:
            own = declared(_COMMENT.sub(" ", values.get("style", "")))
            style = self.sheet.style(marks_of(name, values), self._above, own)
        seen = not self.hidden() and not self._hides(name, values, style.get("display"))
        if name in VOID:
            if seen and name == "br":
                self.frames[-1].inline.append("\n")
            elif seen and name == "hr":
                self.frames[-1].block(True)
            return
        box = None
        if seen:
            frame = self.frames[-1]
            if name == "li":
                frame.block(False)
                box = Frame()
                self.frames.append(box)
            elif name == "table":
                frame.block(True)
                box = Table()
            elif name == "tr" and table is not None:
                table.rows.append([])
            elif name in CELLS and table is not None:
                cell = Frame()
                self.frames.append(cell)
                box = (cell, table, _number(values.get("colspan"), 1000), _number(values.get("rowspan"), 65534))
            elif name in BLOCKS:
                frame.block(name in APART and not self._tight(name))
        if name == "pre":
            self.pre += 1
        first = values.get("start", "")
        number = int(first) - 1 if name == "ol" and re.fullmatch(r"-?[0-9]{1,9}", first) else 0
        if name == "details":
            number = int("open" not in values)  # closed: only its summary is seen
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append([name, not seen, box, number])
        self.given.append((name, values))
        shown = style.get("visibility")
        self.visible.append(shown == "visible" if shown in ("visible", "hidden", "collapse") else self.visible[-1])

    def _above(self) -> list[frozenset]:
        return [*self.roots.values(), *[marks_of(*x) for x in self.given]]

    def _hides(self, name: str, values: dict[str, str], display: str | None) -> bool:
        if name in UNSEEN:
            return True
        if self.open and self.open[-1][0] == "details" and self.open[-1][3] and name != "summary":
            return True
        if display is not None:
            return display == "none"
        return "hidden" in values or (name == "dialog" and "open" not in values)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name not in ("html", "body"):
            fences = set() if name == "table" else {"table"} if name in SECTIONS | CELLS | {"tr", "caption"} else FENCES - {name}
            names = HEADINGS if name in HEADINGS else {name}
            self._close_to(self._depth(names, fences))

    def render(self, source: str) -> str:
        at = 0
        while at < len(source):
            token = _TOKEN.search(source, at)
            if token is None:
                break
            self.text(source[at : token.start()])
            at = token.end()
            name = (token[2] or token[4] or "").lower()
            if token[1]:
                self.end(token[1].lower())
            elif name:
                attributes = token[3] if token[2] else token[5]
                self.start(name, attributes or "")
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at) if name != "plaintext" else None
                    inner = source[at : stop.start() if stop else len(source)]
                    if name == "style":
                        media = next((a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(attributes or "") if a[1].lower() == "media"), "")
                        if on_screen(media) and not {"noscript", "template"} & self.places.keys():
                            self.sheet.add(inner)
                    elif inner:
                        self.text(inner)
                    at = stop.start() if stop else len(source)
        self.text(source[at:])
        self._close_to(0)
        frame = self.frames[0]
        frame.flush()
        return "\n".join(unfold(frame.lines)).strip("\n")


def render(source: str | None) -> str:
    return Page().render(source) if source else ""


def extract_text(pages: DataFrame, source: str = "html", prefix: str = "") -> DataFrame:
    """``pages`` with the visible text of ``source``, its name after ``prefix``; a column of this name is replaced."""

    def work():
        return lambda batch: [pa.array([render(x) for x in batch.column(source).to_pylist()], pa.string())]

    return common.append_columns(pages, source, [common.field(prefix + "text", "string")], work)
