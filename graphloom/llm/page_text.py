"""HTML extraction by layout-aware rendering.

A page is parsed to a tree (end tags that HTML lets authors leave out are
implied), visibility rules take out what a browser would not show, and the rest
is laid out as text: paragraphs, headings, lists, quotes and tables are set
apart by an empty line, other blocks by a line break, list items carry their
marker and indent, table cells stand in aligned columns, and preformatted text
keeps its spaces.

Each page is one row in and one row out, so nothing is shuffled.  Parsing is one
pass and rendering keeps its own stack: neither very long nor very deeply nested
pages are a problem.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tables

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe noembed noframes object audio video canvas datalist meta link base param source track area annotation annotation-xml".split()
)
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc title style script".split())  # within svg
HEAD = frozenset("title meta link base script style template noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu xmp".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary tr td th caption tbody thead tfoot".split()
)
ENDS_P = SPACED | frozenset("address article aside center details dialog dd div dt figcaption footer form header hgroup li main nav search section summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu".split())
FENCE = frozenset("table td th caption html body template object button".split())  # end tags do not reach across these

#: opening tag: (open elements that it ends, elements that the search for them stops at)
IMPLIED = {
    "li": ({"li"}, LISTS | FENCE),
    "dt": ({"dt", "dd"}, frozenset({"dl"}) | FENCE),
    "dd": ({"dt", "dd"}, frozenset({"dl"}) | FENCE),
    "tr": ({"tr", "caption", "colgroup"}, frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": ({"td", "th"}, frozenset({"tr", "table"})),
    "th": ({"td", "th"}, frozenset({"tr", "table"})),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr"}, frozenset({"table"})),
    "option": ({"option"}, frozenset({"select", "optgroup", "datalist"})),
    "optgroup": ({"option", "optgroup"}, frozenset({"select"})),
    "a": ({"a"}, FENCE),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]

# Quotes delimit a value only right after "="; elsewhere in a tag they are characters like others.
VALUE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^ \t\n\r\f>]*+))"
NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
REST = rf"(?:[ \t\n\r\f/]++|{NAME}(?:{VALUE}|(?![ \t\n\r\f]*+=)))*+".replace("([^", "(?:[^").replace("((?!", "(?:(?!")
TAG = re.compile(rf"<(?:!--(?P<note>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>{REST})>|(?P<odd>[!?/][^>]*+(?:>|\Z)))", re.S)
ATTRIBUTE = re.compile(rf"({NAME})(?:{VALUE})?")
SPACE = re.compile(r"[ \t\n\r\f]+")
STARTS = re.compile(r"[A-Za-z]")
# The next character of a style sheet that ends a prelude, a declaration or a block; comments and strings hide them.
MARK = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|\\.|[{};]", re.S)
NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
COMPOUND = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<more>(?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)$")
MORE = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
FEATURE = re.compile(r"\(\s*([a-z-]+)\s*(?::\s*([^()]*?)\s*)?\)")
# The screen that pages are shown on, and what holds for it beside its size.
SCREEN = {"width": 1280, "height": 800}
HOLDS = {("orientation", "landscape"), ("hover", "hover"), ("any-hover", "hover"), ("pointer", "fine"), ("any-pointer", "fine"), ("prefers-color-scheme", "light"), ("prefers-reduced-motion", "no-preference"), ("scripting", "none")}


class Node:
    __slots__ = ("tag", "attributes", "children", "above")

    def __init__(self, tag: str, rest: str = ""):
        self.tag = tag
        self.attributes = {}
        self.above: Node | None = None
        self.children: list[Node | str] = []
        if rest and not rest.isspace():
            for name, a, b, c in ATTRIBUTE.findall(rest):
                value = a or b or c
                self.attributes.setdefault(name.lower(), unescape(value) if "&" in value else value)


def parse(html: str) -> tuple[Node, list[str]]:
    """(root, texts of style elements)."""
    root = Node("html")
    stack, styles = [root], []
    opened: dict[str, int] = {}  # by element name, so that a search for what isn't open costs nothing
    place, n = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                pop(len(stack) - 1)
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    def add(node: Node) -> None:
        node.above = stack[-1]
        stack[-1].children.append(node)

    def push(node: Node) -> None:
        add(node)
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def pop(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def find(names, fence) -> int:
        """Place of the innermost open element of these names within the fence, or 0."""
        if any(opened.get(x) for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    return k
                if stack[k].tag in fence:
                    break
        return 0

    def close(names, fence) -> None:
        if k := find(names, fence):
            pop(k)

    while place < n:
        at = html.find("<", place)
        if at < 0:
            text(html[place:])
            break
        found = TAG.match(html, at)
        if found is None:
            if STARTS.match(html, at + 1 + (html[at + 1 : at + 2] == "/")):
                text(html[place:at])  # the page ends within a tag
                break
            text(html[place : at + 1])
            place = at + 1
            continue
        text(html[place:at])
        place = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if name == "br":
                add(Node("br"))
            elif name == "p" and not find({"p"}, FENCE):
                add(Node("p"))
            elif name in HEADING:
                close(HEADING, FENCE)
            elif name == "table":
                close({name}, frozenset())
            elif name not in ("html", "body"):
                close({name}, (FENCE if name in BLOCK or name == "head" else FENCE | BLOCK) - {name})
            continue
        if name in ("html", "body"):
            if name == "body" and stack[-1].tag == "head":
                pop(len(stack) - 1)
            root.attributes = Node(name, found["rest"]).attributes | root.attributes
            continue
        if stack[-1].tag == "head" and name not in HEAD:
            pop(len(stack) - 1)
        if name in ENDS_P:
            close({"p"}, FENCE)
        if name in HEADING and stack[-1].tag in HEADING:
            pop(len(stack) - 1)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(name, found["rest"])
        if name in VOID:
            add(node)
            continue
        if name in RAW:
            add(node)
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, place)
            body = html[place : end.start() if end else n]
            place = end.end() if end else n
            if name == "style":
                if _shown_on_screen(node.attributes.get("media", "")):
                    styles.append(body)
            elif name in ("textarea", "xmp"):
                node.children.append(unescape(body) if name == "textarea" else body)
            continue
        push(node)
        if name == "plaintext":
            node.children.append(html[place:])
            break
    return root, styles


def _blocks(text: str) -> Iterator[tuple[str, str | None]]:
    """(prelude, body) of each block of a style sheet, at any depth of braces; a statement without a block has no body."""
    begin, depth, head, inside = 0, 0, "", 0
    for found in MARK.finditer(text):
        mark = found[0]
        if mark == "{":
            if not depth:
                head, inside = text[begin : found.start()], found.end()
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
            if not depth:
                if inside:
                    yield head, text[inside : found.start()]
                begin, inside = found.end(), 0
        elif mark == ";" and not depth:
            yield text[begin : found.start()], None
            begin = found.end()
    if depth and inside:  # the sheet ends within a block
        yield head, text[inside:]
    elif not depth and text[begin:].strip():
        yield text[begin:], None


def _length(text: str) -> float | None:
    found = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)(px|em|rem)?", text)
    return float(found[1]) * (16 if (found[2] or "px") != "px" else 1) if found else None


def _holds(name: str, value: str | None) -> bool:
    """Whether a media feature holds on the screen."""
    least, _, side = name.rpartition("-")
    if side in SCREEN and value and least in ("", "min", "max"):
        size = _length(value)
        return size is not None and (SCREEN[side] == size if not least else SCREEN[side] >= size if least == "min" else SCREEN[side] <= size)
    return (name, value) in HOLDS if value else name in SCREEN or name == "color" or any(name == n for n, v in HOLDS if v != "none")


def _shown_on_screen(media: str) -> bool:
    """Whether one of the media queries matches; an empty list does."""
    queries = [q.strip().lower() for q in media.split(",")]
    if queries == [""]:
        return True
    for query in queries:
        words = re.sub(r"\([^()]*\)", " ", query).split()
        inverse = words[:1] == ["not"]
        words = [w for w in words if w not in ("not", "only", "and")]
        features = [_holds(n, v or None) for n, v in FEATURE.findall(query)]
        odd = len(words) > 1 or query.count("(") != len(features)
        if not odd and (all(features) and words in ([], ["all"], ["screen"])) != inverse:
            return True
    return False


#: Compounds in a selector, at most; a longer one matches nothing.
LONGEST = 200


class Style:
    """Display, visibility and white space by the page's own style elements and by attributes.

    Selectors are elements, classes, ids, attributes, and these below one another;
    other ones (states, siblings) match nothing.  Rules apply by importance, then
    by how specific they are, then in their order.
    """

    def __init__(self, texts: list[str]):
        #: (compound selectors from the element upwards, each with whether the next one is its parent, weight, declarations)
        self.rules: dict[str | None, list[tuple[list, tuple, dict]]] = {}  # by an id, a class or the name that the element must have
        self.known: dict[tuple[int, int], bool] = {}
        self.count = 0
        for text in texts:
            self._read(text)

    def _read(self, text: str) -> None:
        sheets = [iter(_blocks(text))]
        while sheets:
            block = next(sheets[-1], None)
            if block is None:
                sheets.pop()
                continue
            head, body = NOTE.sub(" ", block[0]).strip(), block[1]
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                name, _, bracket = name.lower().partition("(")
                if body is not None and (name in ("layer", "supports") or name == "media" and _shown_on_screen(f"({bracket} {rest}" if bracket else rest)):
                    sheets.append(iter(_blocks(body)))
            elif body is not None and (chosen := _declared(body)):
                for selector in re.findall(r"(?:\[[^\]]*\]|[^,])+", head):
                    if found := _selector(selector):
                        tag, wanted, name, *_ = found[0][0]
                        key = f"#{name[0]}" if name else f".{min(wanted)}" if wanted else tag
                        self.rules.setdefault(key, []).append((found[0], (*found[1], self.count), chosen))
                        self.count += 1

    def of(self, node: Node) -> dict[str, str]:
        a = node.attributes
        if not self.rules and not a:
            return {}
        # (important, from the element itself, weight): value
        best: dict[str, tuple] = {}
        for key in (None, node.tag, f"#{a.get('id')}", *(f".{c}" for c in set(a.get("class", "").split()))) if self.rules else ():
            for parts, weight, chosen in self.rules.get(key, ()):
                if _fits_one(parts[0], node) and _below(parts, 1, node, self.known):
                    for name, (value, important) in chosen.items():
                        best[name] = max(best.get(name, ()), ((important, False, weight), value))
        if "style" in a:
            for name, (value, important) in _declared(a["style"]).items():
                best[name] = max(best.get(name, ()), ((important, True, ()), value))
        own = {name: value for name, (_, value) in best.items()}
        if "hidden" in a and a["hidden"].lower() != "until-found":
            own.setdefault("display", "none")
        return own


def _selector(text: str) -> tuple[list, tuple[int, int, int]] | None:
    """(compounds from the last to the first, each with whether the one before it must be the parent; ids, classes, elements)."""
    words = re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+|[>\[]", text)
    parts, ids, classes, tags, child = [], 0, 0, 0, False
    for word in reversed(words):
        if word == ">":
            if child or not parts:
                return None
            child = True
            continue
        found = COMPOUND.match(word)
        if not found or not word:
            return None
        if parts:
            parts[-1][-1] = child
        tag = found["tag"]
        more = list(MORE.finditer(found["more"]))
        name = [m[2] for m in more if m[1] == "#"]
        wanted = {m[2] for m in more if m[1] == "."}
        held = [(m[3].lower(), next((v for v in m.group(4, 5, 6) if v is not None), None)) for m in more if m[3]]
        parts.append([tag.lower() if tag and tag != "*" else None, wanted, name, held, False])
        ids, classes, tags, child = ids + len(name), classes + len(wanted) + len(held), tags + (parts[-1][0] is not None), False
    return (parts, (ids, classes, tags)) if 0 < len(parts) <= LONGEST and not child else None


def _fits_one(part: list, node: Node) -> bool:
    tag, wanted, name, held, _ = part
    a = node.attributes
    if tag is not None and tag != node.tag or name and any(n != a.get("id") for n in name):
        return False
    if wanted and not wanted <= set(a.get("class", "").split()):
        return False
    return all(n in a and v in (None, a[n]) for n, v in held)


def _below(parts: list, k: int, node: Node, known: dict[tuple[int, int], bool]) -> bool:
    """Whether elements above this one match the compounds from the k-th on.  What is found for an element holds for the next ones too, so `known` keeps it."""
    if k == len(parts):
        return True
    fits = lambda up: up is not None and _fits_one(parts[k], up) and _below(parts, k + 1, up, known)
    if parts[k - 1][-1]:
        return fits(node.above)
    path, found = [], False
    while node is not None and not found:
        key = (id(parts[k]), id(node))
        if key in known:
            found = known[key]
            break
        path.append(key)
        node = node.above
        found = fits(node)
    known.update(dict.fromkeys(path, found))
    return found


def _declared(text: str) -> dict[str, tuple[str, bool]]:
    """(value, important) of the properties that matter; rules nested in the text are left out."""
    out: dict[str, tuple[str, bool]] = {}
    for part, body in _blocks(text):
        name, _, value = NOTE.sub(" ", part).partition(":")
        name = name.strip().lower()
        if body is None and name in ("display", "visibility", "white-space"):
            value, mark, word = value.lower().rpartition("!")
            important = bool(mark) and word.strip() == "important"
            kept = value.strip() if important else word.strip()
            if kept and (important or not mark) and not (out.get(name, ("", False))[1] and not important):
                out[name] = (kept, important)
    return out


class Flow:
    """Lines of text with pending space, marker and indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def add(self, text: str) -> None:
        body = SPACE.sub(" ", text)
        if body == " " or not body:
            self.space = self.space or bool(body and self.parts)
            return
        if self.parts and (self.space or body[0] == " "):
            self.parts.append(" ")
        self.space = body[-1] == " "
        self.parts.append(body.strip(" "))

    def keep(self, text: str) -> None:
        rows = text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(8).split("\n")
        for k, row in enumerate(rows):
            if k:
                self.end(force=True)
            if row:
                if self.parts and self.space:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(row)

    def end(self, force: bool = False) -> None:
        line = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        if line.strip():
            self._line(line)
        elif force and self.lines:
            self.gap = max(self.gap, 2) if not self.gap else self.gap + 1

    def _line(self, line: str) -> None:
        if self.lines and self.gap > 1:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        head = self.indent
        if self.marker:
            head = self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append(head + line)

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).replace("\xa0", " ")


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def render(html: str) -> str:
    """The text that the page shows."""
    root, styles = parse(html)
    flow = Flow()
    # tables within tables are tasks that wait for one another, at any depth
    tasks = [_walk(root, flow, Style(styles), True, False)]
    while tasks:
        inner = next(tasks[-1], None)
        if inner is None:
            tasks.pop()
        else:
            tasks.append(inner)
    return flow.text()


def _walk(top: Node, flow: Flow, style: Style, visible: bool, kept: bool) -> Iterator[Iterator]:
    """Lay out a subtree; yields what has to be laid out before it goes on."""
    stack: list[tuple] = [("in", top, visible, kept)]
    counters: list[list] = []
    while stack:
        kind, node, visible, kept = stack.pop()
        if kind == "out":
            _leave(node, flow, counters)
            continue
        if isinstance(node, str):
            if visible and kind == "in":
                (flow.keep if kept else flow.add)(node)
            continue
        tag = node.tag
        own = style.of(node)
        if kind == "svg" and tag not in ("text", "foreignobject"):  # only these hold text there
            if tag not in UNDRAWN and own.get("display") != "none":
                if "visibility" in own:
                    visible = own["visibility"] not in ("hidden", "collapse")
                stack += [("svg", c, visible, kept) for c in reversed(node.children)]
            continue
        if kind == "svg":
            flow.space = flow.space or bool(flow.parts)
        if (tag in UNSEEN and node is not top) or own.get("display") == "none" or (tag == "dialog" and "open" not in node.attributes):
            continue
        if tag == "input" or tag == "img":
            continue
        if "visibility" in own:
            visible = own["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            flow.end(force=True) if not flow.parts else flow.end()
            flow.gap = max(flow.gap, 1)
            continue
        if tag == "wbr":
            continue
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options = [c for c in _descend(node) if c.tag == "option"]
            children = [next((c for c in options if "selected" in c.attributes), options[0])] if options and "multiple" not in node.attributes else children
            flow.space = flow.space or bool(flow.parts)
            stack += [("in", c, visible, kept) for o in reversed(children) if isinstance(o, Node) for c in reversed(o.children)]
            continue
        elif tag == "table":
            flow.block(2)
            yield _table(node, flow, style, visible, kept)
            flow.block(2)
            continue
        elif tag == "svg":
            stack += [("svg", c, visible, kept) for c in reversed(children)]
            continue
        shown = own.get("display", "")
        if shown in ("inline", "inline-block") and tag in BLOCK:
            if shown == "inline-block":
                flow.space = flow.space or bool(flow.parts)
        elif tag in BLOCK or shown in ("block", "flex", "grid", "list-item"):
            _enter(node, flow, counters)
            stack.append(("out", node, visible, kept))
        if tag in ("pre", "textarea", "xmp", "plaintext"):
            kept = True
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
        if "white-space" in own:
            kept = own["white-space"] in ("pre", "pre-wrap", "pre-line", "break-spaces")
        stack += [("in", c, visible, kept) for c in reversed(children)]


def _descend(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        top = stack.pop()
        yield top
        stack += [c for c in reversed(top.children) if isinstance(c, Node)]


def _enter(node: Node, flow: Flow, counters: list[list]) -> None:
    tag = node.tag
    nested = bool(counters) and tag in LISTS
    flow.block(2 if tag in SPACED and not nested else 1)
    if tag in LISTS:
        start = node.attributes.get("start", "1")
        counters.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, flow.indent])
    elif tag == "li":
        marker = "• "
        if counters and counters[-1][0] == "ol":
            value = node.attributes.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                counters[-1][1] = int(value)
            marker = f"{counters[-1][1]}. "
            counters[-1][1] += 1
        node.attributes["\0indent"] = flow.indent
        flow.indent += " " * len(marker)
        flow.marker = marker
    elif tag in ("blockquote", "dd"):
        node.attributes["\0indent"] = flow.indent
        flow.indent += "    "
    elif tag == "hr":
        flow.lines and flow.add("---")


def _leave(node: Node, flow: Flow, counters: list[list]) -> None:
    tag = node.tag
    flow.end()
    if tag in LISTS and counters:
        flow.indent = counters.pop()[2]
    elif "\0indent" in node.attributes:
        flow.indent = node.attributes["\0indent"]
        if tag == "li":
            flow.marker = ""
    flow.block(2 if tag in SPACED and not (counters and tag in LISTS) else 1)


def _number(node: Node, name: str, least: int, most: int) -> int:
    """A whole number as HTML reads it, within its bounds; 1 if there is none."""
    found = re.match(r"[ \t\n\r\f]*\+?(\d+)", node.attributes.get(name, "1"), re.ASCII)
    if not found:
        return 1
    value = most if len(found[1].lstrip("0")) > 8 else int(found[1])
    return 1 if value < least else min(value, most)


class _Taken:
    """Columns that cells of rows above take in the rows below them."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # (first column, column after the last, last row)

    def row(self, number: int, wides: list[tuple[int, int]]) -> list[int]:
        """Each cell's first column in this row, for cells of these (columns, rows)."""
        self.spans = sorted(s for s in self.spans if s[2] >= number)
        out, column, at, new = [], 0, 0, []
        for wide, tall in wides:
            while at < len(self.spans) and self.spans[at][0] <= column:
                column = max(column, self.spans[at][1])
                at += 1
            out.append(column)
            if tall > 1:
                new.append((column, column + wide, number + tall - 1))
            column += wide
        self.spans += new
        return out


#: Fixed values of HTML: the most columns and rows that a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


def _table(table: Node, flow: Flow, style: Style, visible: bool, kept: bool) -> Iterator[Iterator]:
    """Rows of cells in columns as wide as their widest one-column cell, two spaces apart; a cell ends with its group of rows."""
    rows: list[tuple[Node, list[tuple[Node, bool]]]] = []
    before: list[tuple[Node, bool]] = []
    stack: list[tuple[Node, bool, Node]] = [(table, visible, table)]
    while stack:
        node, seen, group = stack.pop()
        own = style.of(node)
        if own.get("display") == "none":
            continue
        if "visibility" in own:
            seen = own["visibility"] not in ("hidden", "collapse")
        if node.tag == "tr":
            rows.append((group, [(c, seen) for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")]))
            before += [(c, seen) for c in node.children if isinstance(c, str) and not c.isspace() or isinstance(c, Node) and c.tag not in ("td", "th")]
            continue
        if node.tag not in ("table", "tbody", "thead", "tfoot"):
            before.append((node, seen))
            continue
        inside = []
        for c in node.children:
            if isinstance(c, Node):
                inside.append((c, seen, node))
            elif not c.isspace():
                before.append((c, seen))
        stack += reversed(inside)
    for node, seen in before:  # captions, and what stands in a table outside its cells
        if isinstance(node, str):
            if seen:
                flow.add(node)
        else:
            yield _walk(node, flow, style, seen, kept)
    flow.end()
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken, last = _Taken(), None
    for number, (group, row) in enumerate(rows):
        if group is not last:
            taken, last = _Taken(), group
        wides = [(_number(c, "colspan", 1, MOST_COLUMNS), _number(c, "rowspan", 0, MOST_ROWS) or MOST_ROWS) for c, _ in row]
        line = []
        for (cell, seen), column, (wide, _) in zip(row, taken.row(number, wides), wides, strict=True):
            own = Flow()
            yield _walk(cell, own, style, seen, kept)
            text = own.text()
            line.append((column, wide, text.split("\n") if text else []))
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for column, wide, text in line:
            if wide == 1:
                widths[column] = max([widths.get(column, 0), *map(width, text)])
    columns = sorted(widths)
    begins = [0, *accumulate(widths[c] + 2 for c in columns)]
    for line in grid:
        for k in range(max((len(text) for _, _, text in line), default=0)):
            out, place = "", 0
            for column, _, text in line:
                if k < len(text) and text[k]:
                    begin = begins[bisect_left(columns, column)]
                    out += " " * max(begin - place, 2 if out else 0) if begin > place or out else ""
                    out += text[k]
                    place = max(begin, place + 2 if out != text[k] else 0) + width(text[k])
            if out.strip():
                flow.parts = [out]
                flow.end()
            else:
                flow.gap = max(flow.gap, 1) + 1


RESULT = "page_id long, url string, text string, n_words long"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(h) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t.split()) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_words"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text (all that the page shows, laid out) and n_words (white-space separated).

    Null and empty pages have an empty text; null ids and urls are carried.  A
    page that ends within a tag, comment or raw element loses that rest only.
    Very long and very deeply nested pages are rendered whole.  Style rules count
    as a screen of 1280 by 800 pixels shows them.  Cells span at most what HTML
    allows, 1,000 columns and 65,534 rows.  Repeated rows are rendered each.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.transform(tables.mapped, _apply, RESULT)


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(tables.load(spark, sf_dir, "pages"))
