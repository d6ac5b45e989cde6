"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags make a tree of a page, however broken; a walk of
the tree renders what a reader would see: blocks apart from each other, list items with their
marks and indents, tables with aligned cells, preformatted text as it is, nothing that is hidden:
by its tag, by attributes, or by rules of the page's own style sheets for a tag, a class, an id or
some of these together (selectors over several elements, media rules and scripts are not followed).

Work and output are linear in the page. Cells are wrapped at CELL_WIDTH columns, in tables of any
number of rows; a table of more than TABLE_WIDTH columns of text is given row by row without
wrapping and padding; what is nested deeper than NESTED lists, quotes, cells and tables is not
indented further.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkpact.llm.bpe import groups

# Fixed values of the HTML language: element groups by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
NEVER_SHOWN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist param source track area base link meta title desc defs metadata symbol clippath annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure table ul ol dl hr address fieldset details".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside main nav header footer form li dt dd dir menu figcaption center summary legend option optgroup caption thead tbody tfoot tr td th hgroup search".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: An opening tag closes the nearest of these, unless a bound comes first.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
#: Closing one of these does not reach out of the nearest table cell or table.
CELL_BOUND = frozenset({"td", "th", "caption", "table"})
TABLE_PARTS = frozenset({"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"})

#: Columns that a table cell is wrapped at; columns of a table that is aligned; levels that are set off.
CELL_WIDTH, TABLE_WIDTH, NESTED = 60, 240, 16
#: How often a tag may run to the page's end in search of its own. After that a tag ends at the next ">".
LOST_TAGS = 8

# Attributes by the states of HTML: a quote opens a value only directly after "="; an unquoted value
# ends at white space or ">". After a quote that never closes the tag ends at the next ">".
WHITE = r" \t\n\r\f"
ATTRIBUTE = re.compile(rf"([^{WHITE}/>][^{WHITE}/>=]*+)(?:[{WHITE}]*+=[{WHITE}]*+(?:\"([^\"]*)\"|'([^']*)'|([^{WHITE}>\"'][^{WHITE}>]*+)|(?=>|\Z)))?+")
TAG = re.compile(rf"<(/?)([a-zA-Z][^{WHITE}/>]*+)")
#: What follows the name of most tags: nothing that could be taken for another tag.
PLAIN_REST = re.compile(r"(?:[^\"'<>=]|=[^\"'<>]|=\"[^\"<>]*+\"|='[^'<>]*+')*+>")
NAME = re.compile(rf"[{WHITE}/]*+(?:(>)|[^{WHITE}/>][^{WHITE}/>=]*+(?:[{WHITE}]*+(=)[{WHITE}]*+)?+)")
BARE = re.compile(rf"[^{WHITE}>]*+")
SPACE = re.compile(r"[ \t\n\r\f]+")
SIMPLE = re.compile(r"([a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)\Z", re.I)
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([\w-]+)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "").

    Each character is looked at a bounded number of times: where the last quotes and ">" stand is
    known, and a tag that finds no end is a matter of LOST_TAGS.
    """
    at, begin, n, lost = 0, 0, len(page), 0
    final = {c: page.rfind(c) for c in "\"'>"}
    while (start := page.find("<", at)) >= 0:
        follows = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = next((start + len(c) for c in ("<!-->", "<!--->") if page.startswith(c, start)), 0)
            if not end:
                end = page.find("-->", start + 4) + 3 if page.find("-->", start + 4) >= 0 else n
            found = None
        elif (found := TAG.match(page, start)) and start < final[">"]:
            plain = PLAIN_REST.match(page, found.end())
            if plain:
                end = plain.end()
            else:
                end = tag_end(page, found.end(), final) if lost < LOST_TAGS else 0
                lost += end == 0
                end = end or page.find(">", found.end()) + 1
        elif follows and follows in "!?/" and start < final[">"]:
            end = page.find(">", start) + 1
            found = None
        else:  # a character like any other
            at = start + 1
            continue
        if start > begin:
            yield "text", html.unescape(page[begin:start]), ""
        at = begin = end
        if found is None:
            continue
        tag = found[2].lower()
        if found[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, page[found.end() : end - 1]
        if tag in RAW or tag in ESCAPABLE_RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            raw = page[at : over.start() if over else n]
            if raw:
                yield "text", html.unescape(raw) if tag in ESCAPABLE_RAW else raw, ""
            yield "close", tag, ""
            at = begin = over.end() if over else n
        elif tag == "plaintext":
            yield "text", page[at:], ""
            return
    if begin < n:
        yield "text", html.unescape(page[begin:]), ""


def tag_end(page: str, at: int, final: dict[str, int]) -> int:
    """Where the tag ends whose name ends at a place, by the states of HTML; 0 if the page ends first."""
    n = len(page)
    while at < n:
        found = NAME.match(page, at)
        if not found:
            return 0
        at = found.end()
        if found[1]:
            return at
        if found[2]:
            quote = page[at : at + 1]
            if quote in ("\"", "'"):
                if at >= final[quote]:
                    return page.find(">", at) + 1
                at = page.find(quote, at + 1) + 1
            else:
                at = BARE.match(page, at).end()
    return 0


def build(page: str) -> Node:
    """The page's tree. Tags that are left out are implied: html, head and body, the end of p
    before a block, ends of list items, definitions, options, rows and cells before the next, and
    tbody, tr and td where a table's content asks for them."""
    root = Node("html")
    stack = [root]
    #: Where in the stack elements of each tag are open.
    places: dict[str, list[int]] = {"html": [0]}

    def push(tag: str, attributes: dict[str, str] | None = None) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)

    def pop_to(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def last(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Close the nearest element of these tags, unless a bound is nearer."""
        k = last(tags)
        if k and k > last(bounds.difference(tags)):
            pop_to(k)

    for kind, value, rest in tokens(page):
        top = stack[-1].tag
        if kind == "text":
            if not value:
                continue
            if value.strip(" \t\n\r\f"):
                if top == "head":
                    pop_to(len(stack) - 1)
                elif top in ("table", "thead", "tbody", "tfoot"):
                    push("tr")
                if stack[-1].tag == "tr":
                    push("td")
            stack[-1].children.append(value)
        elif kind == "open":
            attributes = attributes_of(rest) if rest.strip(" \t\n\r\f/") else {}
            if value == "html":
                root.attributes = {**attributes, **root.attributes}
                continue
            if value == "body":
                close(frozenset({"head"}), frozenset())
                if not places.get("body"):
                    push("body", attributes)
                continue
            if value == "head":
                if not places.get("head") and not places.get("body"):
                    push("head", attributes)
                continue
            if places.get("head") and value not in HEAD_ONLY and not places.get("noscript"):
                close(frozenset({"head"}), frozenset())
            if value in BLOCKS and places.get("p"):
                close(frozenset({"p"}), CELL_BOUND | frozenset({"button", "object"}))
            if value in CLOSES:
                close(*CLOSES[value])
            if value in ("thead", "tbody", "tfoot"):
                close(frozenset({"tr"}), frozenset({"table"}))
            top = stack[-1].tag
            if value == "tr" and top == "table":
                push("tbody")
            elif value in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
                if top == "table":
                    push("tbody")
                push("tr")
            elif value not in TABLE_PARTS and value not in HEAD_ONLY and value not in ("col", "colgroup", "form") and top in ("table", "thead", "tbody", "tfoot", "tr"):
                if top != "tr":
                    push("tr")
                push("td")
            if value in VOID:
                stack[-1].children.append(Node(value, attributes))
            else:
                push(value, attributes)
        elif value == "br":
            stack[-1].children.append(Node("br"))
        elif value == "p" and not places.get("p"):
            stack[-1].children.append(Node("p"))
        elif value not in ("html", "body"):
            close(frozenset({value}), frozenset() if value in TABLE_PARTS else CELL_BOUND)
    return root


class Styles:
    """Rules of a page's style sheets that hide or show, by the names (tag, .class, #id) that an
    element must have. Rules for the same names are one, the later counts; each stands under one of
    its names, the first in an order that prefers classes and ids."""

    def __init__(self, root: Node) -> None:
        #: Names to (number of the last rule, display, visibility).
        self.rules: dict[frozenset[str], tuple[int, str, str]] = {}
        self.by_name: dict[str, set[frozenset[str]]] = {}
        todo, count = [root], 0
        while todo:
            node = todo.pop()
            if node.tag == "style":
                for rule in plain_rules("".join(c for c in node.children if isinstance(c, str))).split("}"):
                    selectors, _, body = rule.rpartition("{")
                    display, visibility = (last_of(kind, body) for kind in (DISPLAY, VISIBILITY))
                    for selector in selectors.split(",") if display or visibility else ():
                        simple = SIMPLE.match(selector.strip())
                        names = frozenset([*filter(None, [simple[1] and simple[1].lower()]), *re.findall(r"[.#][\w-]+", simple[2])] if simple else [])
                        if names:
                            _, had, seen = self.rules.get(names, (0, "", ""))
                            count += 1
                            self.rules[names] = (count, display or had, visibility or seen)
                            self.by_name.setdefault(max(names, key=lambda x: (x[0] in ".#", x)), set()).add(names)
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]

    def of(self, node: Node) -> tuple[str, str]:
        """(display, visibility) of an element, by its own style attribute first; empty: as usual."""
        a = node.attributes
        display = visibility = ""
        if self.by_name:
            names = {node.tag, *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])}
            for _, d, v in sorted(self.rules[r] for name in names for r in self.by_name.get(name, ()) if r <= names):
                display, visibility = d or display, v or visibility
        if "style" in a:
            display, visibility = last_of(DISPLAY, a["style"]) or display, last_of(VISIBILITY, a["style"]) or visibility
        return display, visibility


def last_of(kind: re.Pattern, declarations: str) -> str:
    """The last value that declarations give for a property, or the empty text."""
    found = kind.findall(declarations)
    return found[-1].lower() if found else ""


def plain_rules(sheet: str) -> str:
    """A style sheet without comments and without rules that hold other rules (media and the like)."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    if "@" not in sheet:
        return sheet
    out, depth, skip = [], 0, 0
    for piece in re.split(r"([{};])", sheet):
        if piece == "{":
            depth += 1
        elif piece == "}":
            depth = max(0, depth - 1)
        if not skip and depth == 0 and piece.lstrip().startswith("@"):
            skip = 1
            continue
        if skip:
            if depth == 0 and piece in ("}", ";"):
                skip = 0
            continue
        out.append(piece)
    return "".join(out)


def hidden(node: Node, display: str) -> bool:
    """An element that is not shown, nor anything in it."""
    if node.tag in NEVER_SHOWN or display == "none":
        return True
    a = node.attributes
    if not a:
        return node.tag == "dialog"
    return "hidden" in a and a["hidden"].lower() != "until-found" and display in ("", "none") or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden"


def shown_children(node: Node) -> list:
    """An element's children as far as they are shown: of closed details the summary, of a select
    that shows one option that one."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]
    if node.tag == "select" and "multiple" not in node.attributes:
        options, todo = [], [node]
        while todo:
            x = todo.pop()
            if x.tag == "option":
                options.append(x)
            else:
                todo += [c for c in reversed(x.children) if not isinstance(c, str)]
        chosen = [x for x in options if "selected" in x.attributes][-1:] or options[:1]
        return chosen[0].children if chosen else []
    return node.children


def width(text: str) -> int:
    """Columns of a terminal: wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Rendered lines of one block, with the line that is being written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False  # a blank line is due before the next line
        self.space = False  # a space is due before the next word

    def word(self, text: str, pre: bool) -> None:
        if pre:
            head, *more = text.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.raw(head)
            for line in more:
                self.end(force=True)
                self.raw(line)
            return
        words = SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words.endswith(" ")
        self.parts.append(words[:-1] if self.space else words)

    def raw(self, text: str) -> None:
        if text:
            if self.space and self.parts:
                self.parts.append(" ")
            self.space = False
            self.parts.append(text)

    def end(self, force: bool = False) -> None:
        """End the line, if there is one (or anyway: a line break)."""
        self.space = False
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        if line or force:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, apart: bool) -> None:
        self.end()
        self.gap = self.gap or apart and bool(self.lines)

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.put(line)

    def done(self) -> list[str]:
        self.end()
        full = [k for k, line in enumerate(self.lines) if line.strip()]
        return self.lines[full[0] : full[-1] + 1] if full else []


def span_of(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(most, max(1, int(value[:6]))) if value.isdigit() and value.isascii() else 1


def wrapped(line: str) -> list[str]:
    """A cell's line in lines of at most CELL_WIDTH columns, broken between words; longer words stay whole."""
    if width(line) <= CELL_WIDTH:
        return [line]
    out: list[str] = []
    parts: list[str] = []
    have = 0
    for word in line.split(" "):
        need = width(word)
        if parts and have + 1 + need > CELL_WIDTH:
            out.append(" ".join(parts))
            parts, have = [], 0
        have += need + (1 if parts else 0)
        parts.append(word)
    return [*out, " ".join(parts)]


Cell = tuple[list[str], int, int]


def placed_cells(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]] | None:
    """(column, columns, lines) of each row's cells; a cell that covers rows below keeps its columns there.
    None if the marks between the columns alone are wider than TABLE_WIDTH, so no row has many columns to look at."""
    out, held = [], []  # held: (first column, columns, last row), by column
    ends = len(rows)  # the first of the last rows
    for number, row in enumerate(rows, 1):
        places: list[tuple[int, int, list[str]]] = []
        at = k = 0
        covering = []
        for lines, n, down in row:
            while k < len(held) and held[k][0] < at + n:
                at = max(at, held[k][0] + held[k][1])
                k += 1
            if 3 * (at + n - 1) > TABLE_WIDTH:
                return None
            places.append((at, n, lines))
            if down > 1:
                covering.append((at, n, number + down - 1))
            at += n
        out.append(places)
        if covering or number >= ends:
            held = sorted(x for x in [*held, *covering] if x[2] > number)
            ends = min((x[2] for x in held), default=len(rows))
    return out


def table_lines(rows: list[list[Cell]]) -> list[str]:
    """Rows of (cell lines, columns, rows that it covers), each column as wide as its widest cell;
    without padding where that would be wider than TABLE_WIDTH, whatever the number of rows."""
    found = placed_cells(rows)
    placed = [[(at, n, [part for line in lines for part in wrapped(line)]) for at, n, lines in row] for row in found or []]
    columns = max((at + n for row in placed for at, n, _ in row), default=0)
    wide = [0] * columns
    for spanning in (False, True):
        for row in placed:
            for at, n, cell in row:
                need = max(map(width, cell), default=0)
                if n == 1:
                    wide[at] = max(wide[at], need)
                elif spanning:
                    wide[at + n - 1] += max(0, need - sum(wide[at : at + n]) - 3 * (n - 1))
    if found is None or sum(wide) + 3 * max(0, columns - 1) > TABLE_WIDTH:
        out = []
        for row in rows:
            short: list[str] = []
            for lines, _, _ in row:
                if len(lines) > 1:  # a cell of several lines stands alone
                    out += [" | ".join(short), *lines] if short else lines
                    short = []
                else:
                    short += lines or [""]
            while short and not short[-1]:
                short.pop()
            if short:
                out.append(" | ".join(short))
        return out
    edges = [0]
    for w in wide:
        edges.append(edges[-1] + w + 3)
    out = []
    for row in placed:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            parts, have = [], 0
            for at, _, cell in row:
                text = cell[k] if k < len(cell) else ""
                if at:
                    lead = " " * (edges[at] - 3 - have) + " | "
                    parts.append(lead)
                    have = edges[at]
                parts.append(text)
                have += width(text)
            out.append("".join(parts).rstrip(" "))
    return out


def render(root: Node) -> str:
    """All visible text of a tree. A walk with a stack of its own, so that depth has no limit."""
    styles = Styles(root)
    buffers = [Lines()]
    tables: list[list[list[Cell]]] = []
    lists: list[list] = []  # [ordered, next number]
    pre, drawing, texts = 0, 0, 0
    todo: list[tuple[object, bool, bool, bool]] = [(root, True, True, True)]  # node, entering, set off, visible
    while todo:
        node, entering, apart, visible = todo.pop()
        out = buffers[-1]
        if isinstance(node, str):
            if visible and (not drawing or texts):
                out.word(node, pre > 0)
            continue
        tag = node.tag
        if entering:
            display, visibility = styles.of(node) if node.attributes or styles.by_name else ("", "")
            if hidden(node, display):
                continue
            if visibility:
                visible = visibility not in ("hidden", "collapse")
            if tag == "br":
                out.end(force=True)
                continue
            if tag == "hr":
                out.block(True)
                if visible:
                    out.put("---")
                    out.gap = True
                continue
            if tag == "img":
                if visible and node.attributes.get("alt", "").strip():
                    out.word(node.attributes["alt"], False)
                continue
            if tag == "input":
                if visible and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                    out.word(f" {node.attributes.get('value', '')} ", False)
                continue
            apart = len(buffers) < NESTED  # deeper, blocks go on in the buffer around them
            if tag in ("td", "th"):
                if not apart or not tables:
                    out.block(False)
                if apart:
                    buffers.append(Lines())
            elif tag == "tr" and tables:
                out.block(False)
                tables[-1].append([])
            elif tag in BLOCKS:
                nested = tag in ("ul", "ol", "menu", "dir") and lists
                out.block(tag in PARAGRAPHS and not nested)
                if tag == "table":
                    if apart:
                        buffers.append(Lines())
                        tables.append([])
                elif tag in ("ul", "ol", "menu", "dir"):
                    start = node.attributes.get("start", "1").strip()
                    lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1])
                elif tag in ("li", "blockquote", "dd", "caption"):
                    if apart:
                        buffers.append(Lines())
                    elif tag == "li" and visible:
                        out.word(mark_of(node, lists), False)
                        out.space = True
                elif tag == "pre":
                    pre += 1
            elif tag == "textarea":
                pre += 1
            elif tag == "svg":
                drawing += 1
            elif tag in ("text", "foreignobject"):
                texts += 1
                out.space = True
            elif tag in ("mtd", "select"):
                out.space = True
            todo.append((node, False, apart, visible))
            todo.extend((c, True, True, visible) for c in reversed(shown_children(node)))
            continue
        # leaving
        if tag in ("td", "th"):
            if not apart:
                out.block(False)
                continue
            cell = buffers.pop().done()
            if tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, span_of(node, "colspan", 100), span_of(node, "rowspan", 65_534)))
            else:
                buffers[-1].add(cell)
        elif tag == "table":
            if apart:
                loose = buffers.pop().done()
                rows = table_lines(tables.pop())
                buffers[-1].add(loose + rows)
            buffers[-1].block(True)
        elif tag in ("li", "blockquote", "dd", "caption"):
            if apart:
                own = buffers.pop().done()
                mark = mark_of(node, lists) if tag == "li" else ""
                first, later = {"li": (mark, " " * len(mark)), "blockquote": ("> ", "> "), "dd": ("    ", "    ")}.get(tag, ("", ""))
                buffers[-1].add([f"{later if k else first}{line}".rstrip(" ") for k, line in enumerate(own)])
            buffers[-1].block(tag == "blockquote")
        elif tag in BLOCKS:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.block(not lists)
            else:
                if tag == "pre":
                    pre -= 1
                out.block(tag in PARAGRAPHS)
        elif tag == "textarea":
            pre -= 1
        elif tag == "svg":
            drawing -= 1
        elif tag in ("text", "foreignobject"):
            texts -= 1
        elif tag in ("mtd", "select"):
            out.space = True
    return "\n".join(buffers[0].done())


def mark_of(item: Node, lists: list[list]) -> str:
    """A list item's mark; counts on in ordered lists."""
    if not lists or not lists[-1][0]:
        return "- "
    value = item.attributes.get("value", "").strip()
    if re.fullmatch(r"-?\d{1,9}", value, re.A):
        lists[-1][1] = int(value)
    lists[-1][1] += 1
    return f"{lists[-1][1] - 1}. "


def visible_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, text, n_chars and n_lines of each whole page.

    Null or empty html, and pages that show nothing: empty text, no lines. Null or repeated ids:
    one row for each row. Empty table: empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x) for part in groups(batch.column(1)) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array((t.count("\n") + 1 if t else 0 for t in texts), pa.int64())], [id_col, "text", "n_chars", "n_lines"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, text string, n_chars long, n_lines long")
