"""HTML pages -> Markdown: a tokenizer, an element stack with implied end tags, and a renderer, all in one pass.

Time is linear in the page, whatever is left open in it: look-ups of open elements are counters, closers that don't
exist are looked for once, and nesting is shown ``DEEPEST`` levels deep.

* A tag starts with a letter or ``/`` after ``<``; quoted attributes may hold ``>``. Any other ``<`` is text. Comments,
  declarations, ``script``, ``style`` and ``title`` are dropped.
* Start tags end open elements as browsers do: blocks end ``p`` and headings, ``li`` ends ``li`` of its list, table parts end
  cells and rows, ``a`` ends ``a``. An end tag ends what is open inside its element, in the same cell.
* ``h1``-``h6`` -> ATX headings; ``br`` -> line break; ``hr`` -> ``---``; lists with their numbers (``start``, ``value``), nested by
  indentation; ``blockquote`` -> ``> ``; ``pre`` -> a fence longer than any in it; ``b``/``strong``, ``i``/``em``, ``del``/``s``, ``code``
  and ``a`` -> their marks where they are closed in the same block; ``img`` -> ``![alt](src)``.
* Tables -> pipe tables on a grid: cells stand under their columns, what ``rowspan`` and ``colspan`` cover is empty. The
  first row is the header; inner tables are text. Rows of tables above ``PADDED`` columns end at their last cell, which Markdown reads alike.
* Entities are decoded. Characters of text that Markdown would read as markup are escaped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5

#: Levels of quotes and lists that are shown; deeper ones are as this deep.
DEEPEST = 64
#: Columns up to which short rows of a table are filled up.
PADDED = 64
#: Largest colspan and rowspan (fixed values of the HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(\s*=\s*)?""")
_BARE = re.compile(r"[^\s>]*")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title", "textarea")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCKS = _HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html li main nav"
    " ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~", "code": "`", "a": ""}
_TABLE_PARTS = frozenset("caption tbody td tfoot th thead tr".split())
#: Elements that keep end tags inside from ending what is open outside.
_SCOPES = frozenset(("table", "td", "th"))
_ITEMS = frozenset(("li", "dt", "dd"))
_HOLDERS = frozenset(("ul", "ol", "dl", "td", "th"))
#: Elements whose text is put together when they end.
_OWN = _HEADINGS | frozenset(("blockquote", "li", "pre", "table", "td", "th"))

_KEPT = "\x00"  # stands in for a verbatim block, which the white-space rules must leave alone


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, text or name, attributes): kind is ``text``, ``raw`` (of a textarea), ``start`` or ``end``."""
    at, size = 0, len(page)
    last = {c: page.rfind(c) for c in ('"', "'", ">", "-->")}
    quotes_hold = True  # until a quoted attribute has run to the end of the page
    unended: set[str] = set()
    while at < size:
        open_at = page.find("<", at)
        if open_at < 0 or open_at >= last[">"]:
            yield "text", page[at:], {}
            return
        if open_at > at:
            yield "text", page[at:open_at], {}
        at = open_at + 1
        mark = page[at]
        if mark in "!?":
            if page.startswith("!--", at) and last["-->"] >= at + 1:
                end = page.find("-->", at + 1)
                at = end + 3
            else:
                at = page.find(">", at) + 1
            continue
        closing = mark == "/"
        named = _NAME.match(page, at + closing)
        if not named:
            if closing and page[at + 1 : at + 2] != ">" or not closing:
                yield "text", "<", {}
                continue
            at += 2  # </> is nothing
            continue
        name, at = named[0].lower(), named.end()
        if closing:
            at = page.find(">", at) + 1
            yield "end", name, {}
            continue
        found: dict[str, str] = {}
        begin, ended = at, False
        while at < size:
            pair = _ATTRIBUTE.match(page, at)
            if not pair:
                stop = page.find(">", at)
                ended, at = stop >= 0, (stop + 1 if stop >= 0 else size)
                break
            at, value = pair.end(), ""
            if pair[2]:
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote and quotes_hold and last[quote] > at:
                    stop = page.find(quote, at + 1)
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            found.setdefault(pair[1].lower(), value)
        if not ended:  # a quote took the rest of the page: the tag ends at its first >
            quotes_hold = False
            at = page.find(">", begin) + 1
        yield "start", name, found
        if name in _RAW and name not in unended:
            end = _RAW[name].search(page, at)
            if not end:
                unended.add(name)
                continue
            if name == "textarea":
                yield "raw", page[at : end.start()], {}
            at = page.find(">", end.end()) + 1 or size
            yield "end", name, {}


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_MARKUP = re.compile(r"\\(?=[!-/:-@\[-`{-~])|[`*\[\]]|(?<![^\W_])_|_(?![^\W_])|~(?=~)|<(?=[A-Za-z/!?])|&(?=#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)")
_LINE_START = re.compile(r"(?m)^([ \t]*)(?:(#{1,6})(?=[ \t]|$)|(>)|([-+])(?=[ \t]|$)|([0-9]{1,9})([.)])(?=[ \t]|$)|(=+|-{2,})(?=[ \t]*$))")


def decoded(text: str) -> str:
    if "&" not in text:
        return text
    return _ENTITY.sub(lambda m: " " if m[0] == "&nbsp;" else entities.unescape(m[0]), text)


def _escape(m: re.Match) -> str:
    if m[0] == "&" and m.string[m.end()] != "#":
        name = re.compile(r"[a-zA-Z0-9]+;").match(m.string, m.end())[0]
        return m[0] if name not in html5 else "\\&"
    return "\\" + m[0]


def escaped(text: str, fresh: bool) -> str:
    """Text with the characters escaped that Markdown would read as markup. fresh: it starts a line."""
    text = _MARKUP.sub(_escape, text)

    def mark(m: re.Match) -> str:
        if not fresh and m.start() == 0:
            return m[0]
        return f"{m[1]}{m[5]}\\{m[6]}" if m[5] else f"{m[1]}\\{m[0][len(m[1]):]}"

    return _LINE_START.sub(mark, text)


def _target(url: str) -> str:
    """A link target; one with blanks, parentheses or angle brackets in angle brackets."""
    url = decoded(url).strip()
    if not re.search(r"[\s()<>]", url):
        return url
    return "<" + re.sub(r"[\r\n\t]+", "", url).replace("<", "%3C").replace(">", "%3E") + ">"


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def _number(text: str | None, least: int, most: int, default: int) -> int:
    m = re.match(r"\s*(-?[0-9]{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else default


def table_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of cells (text, colspan, rowspan; a rowspan of 0 goes to the end) under their columns; covered places are empty."""
    grid: list[list[str]] = []
    covered: dict[int, int] = {}  # column -> rows that a cell above still covers
    for cells in rows:
        row: list[str] = []
        below: dict[int, int] = {}
        column = 0

        def skip(column: int, row: list[str] = row) -> int:
            while covered.get(column):
                row.append("")
                column += 1
            return column

        for text, wide, high in cells:
            column = skip(column)
            wide = min(wide, max(MOST_COLUMNS - column, 1))
            for i in range(wide):
                row.append(text if i == 0 else "")
                if high != 1:
                    below[column + i] = (high or MOST_ROWS) - 1
            column += wide
        column = skip(column)
        covered = {c: n - 1 for c, n in covered.items() if n > 1} | below
        grid.append(row)
    return grid


def _pipe_table(rows: list[list[tuple[str, int, int]]]) -> str:
    grid = [r for r in table_grid([r for r in rows if r]) if r]
    if not grid:
        return ""
    width = max(map(len, grid))
    fill = width if width <= PADDED else 0
    if not fill:
        for r in grid:
            while r and not r[-1]:
                r.pop()
    cells = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") if c else "" for c in r] for r in grid]
    cells[0] += [""] * (width - len(cells[0]))
    lines = ["| " + " | ".join(r + [""] * (fill - len(r))) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


class _Block:
    """An element whose text is put together when it ends: the page, a quote, list item, heading, cell, table or ``pre``."""

    def __init__(self, attributes: dict[str, str] | None = None):
        self.attributes = attributes or {}
        self.parts: list[str] = []
        self.kept: list[str] = []  # finished blocks inside; the white-space rules leave them alone
        self.fresh = True  # a line starts here
        self.inline: list[tuple[str, int, str]] = []  # open inline elements: name, place of the mark, href
        self.open: Counter[str] = Counter()
        self.rows: list[list[tuple[str, int, int]]] = []  # of a table
        self.after_item = False

    def add(self, text: str, fresh: bool = False) -> None:
        self.parts.append(text)
        self.fresh = fresh

    def gap(self) -> None:
        """A block starts or ends: inline elements open here stay without marks."""
        self.inline.clear()
        self.open.clear()
        self.after_item = False
        self.add("\n\n", True)

    def keep(self, text: str) -> None:
        self.add(f"{_KEPT}{len(self.kept)}{_KEPT}")
        self.kept.append(text)

    def text(self, text: str) -> None:
        text = decoded(text)
        if self.after_item:
            if not text.strip():
                return  # between two items
            self.gap()
        self.parts.append(text if self.open["code"] else escaped(text, self.fresh))
        tail = text.rstrip(" \t\r\f")
        if tail:
            self.fresh = tail.endswith("\n")

    def mark(self, name: str, href: str) -> None:
        if name == "a" and self.open["a"]:
            self.unmark("a")
        if not self.open["code"]:
            self.inline.append((name, len(self.parts), href))
            self.open[name] += 1
            self.parts.append("")

    def unmark(self, name: str) -> None:
        if not self.open[name]:
            return
        own, at, href = "", 0, ""
        while own != name:
            own, at, href = self.inline.pop()
            self.open[own] -= 1
        if len(self.parts) == at + 1:
            return  # nothing in it
        if name == "code":
            body = "".join(self.parts[at:])
            ticks = "`" * (max(map(len, re.findall("`+", body)), default=0) + 1)
            pad = " " if "`" in (body[:1], body[-1:]) else ""
            self.parts[at:] = [f"{ticks}{pad}{body}{pad}{ticks}"]
        elif name != "a":
            self.parts[at] = _MARKS[name]
            self.parts.append(_MARKS[name])
        elif href:
            self.parts[at] = "["
            self.parts.append(f"]({_target(href)})")

    def markdown(self) -> str:
        return re.sub(f"{_KEPT}([0-9]+){_KEPT}", lambda m: self.kept[int(m[1])], _tidy("".join(self.parts)))


class _Page:
    """Open elements and their blocks."""

    def __init__(self) -> None:
        self.blocks = [_Block()]
        self.stack: list[tuple[str, bool]] = []  # open elements: name, whether it has a block of its own
        self.names: list[Counter[str]] = [Counter()]  # open elements by name, since the last table or cell
        self.items: list[int | None] = [None]  # place in the stack of the open item, for each open list, cell and the page
        self.numbers: list[int | None] = []  # next number of each open list, None for bullets
        self.tables: list[int] = []  # places of open tables in the stack
        self.verbatim = False

    def push(self, name: str, attributes: dict[str, str], own: bool) -> None:
        own = own and len(self.blocks) < DEEPEST
        self.stack.append((name, own))
        self.names[-1][name] += 1
        if name in _SCOPES:
            self.names.append(Counter())
        if name in _HOLDERS:
            self.items.append(None)
        if own:
            self.blocks.append(_Block(attributes))

    def pop(self) -> None:
        name, own = self.stack.pop()
        if name in _SCOPES:
            self.names.pop()
        if name in _HOLDERS:
            self.items.pop()
        self.names[-1][name] -= 1
        if name in _ITEMS:
            self.items[-1] = None
        elif name in ("ul", "ol"):
            self.numbers.pop()
        elif name == "table":
            self.tables.pop()
        if own:
            done = self.blocks.pop()
            self.finish(name, done, self.blocks[-1])
        elif name != "tr":
            self.blocks[-1].gap()

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.pop()

    def finish(self, name: str, done: _Block, block: _Block) -> None:
        if name in ("td", "th"):
            spans = done.attributes
            cell = done.markdown(), _number(spans.get("colspan"), 1, MOST_COLUMNS, 1), _number(spans.get("rowspan"), 0, MOST_ROWS, 1)
            block.rows[-1].append(cell)
        elif name == "table":
            above = done.markdown()
            if any(n in ("td", "th") and own for n, own in self.stack[-2:]):  # in a cell: as text
                block.add(" ".join(x for x in (above, *(c for r in done.rows for c, _, _ in r)) if x))
                return
            for text in (above, _pipe_table(done.rows)):
                if text:
                    block.keep(text)
                    block.gap()
        elif name == "li":
            mark = done.attributes["mark"]
            lines = done.markdown().split("\n")
            block.add("\n")
            block.keep("\n".join([mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])]).rstrip(" "))
            block.after_item = True
        elif name == "blockquote":
            text = done.markdown()
            if text:
                block.keep("\n".join(f"> {x}" if x else ">" for x in text.split("\n")))
            block.gap()
        elif name == "pre":
            self.verbatim = False
            text = "".join(done.parts).strip("\n")
            ticks = "`" * max(3, max(map(len, re.findall("`+", text)), default=0) + 1)
            block.keep(f"{ticks}{done.attributes.get('fence', '')}\n{text}\n{ticks}")
            block.gap()
        else:  # a heading
            line = re.sub(r"\s*\n\s*", " ", done.markdown()).strip()
            if line:
                block.add("#" * int(name[1]) + " " + line)
            block.gap()

    def start(self, name: str, attributes: dict[str, str]) -> None:
        block = self.blocks[-1]
        if self.verbatim:
            found = re.search(r"(?:^|\s)lang(?:uage)?-([\w+#.-]+)", attributes.get("class", ""))
            if name == "br":
                block.parts.append("\n")
            elif name == "code" and found and not block.parts:
                block.attributes["fence"] = found[1]
        elif name in _MARKS:
            block.mark(name, attributes.get("href", ""))
        elif name == "img":
            if "src" in attributes:
                alt = re.sub(r"([\[\]\\])", r"\\\1", decoded(attributes.get("alt", "")))
                block.add(f"![{alt}]({_target(attributes['src'])})")
        elif name == "br":
            block.add("\n", True)
        elif name == "input" and attributes.get("type", "").lower() == "checkbox":
            block.add("[x] " if "checked" in attributes else "[ ] ")
        elif name == "hr":
            self.end_paragraph()
            block = self.blocks[-1]
            block.gap()
            block.keep("---")
            block.gap()
        elif name in _TABLE_PARTS:
            self.table_part(name, attributes)
        elif name in _BLOCKS:
            self.end_paragraph()
            if name in _ITEMS and self.items[-1] is not None:
                self.pop_to(self.items[-1])
            block = self.blocks[-1]
            if name == "li":
                number = self.numbers[-1] if self.numbers else None
                if number is not None:
                    number = _number(attributes.get("value"), 0, 10**9, number)
                    self.numbers[-1] = number + 1
                attributes = {"mark": "- " if number is None else f"{number}. "}
                block.inline.clear()
                block.open.clear()
            elif name in ("ul", "ol") and self.stack and self.stack[-1][0] == "li" and block.parts:
                block.gap()
                block.parts[-1] = ""  # a list follows its item's text without a blank line
            else:
                block.gap()
            if name in _ITEMS:
                self.items[-1] = len(self.stack)
            elif name in ("ul", "ol"):
                self.numbers.append(_number(attributes.get("start"), 0, 10**9, 1) if name == "ol" else None)
            elif name == "table":
                self.tables.append(len(self.stack))
            self.push(name, attributes, name in _OWN)
            if name == "pre":
                self.verbatim = self.stack[-1][1]

    def end_paragraph(self) -> None:
        while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in _HEADINGS):
            self.pop()

    def table_part(self, name: str, attributes: dict[str, str]) -> None:
        if not self.tables:
            return
        table = self.tables[-1]
        if not self.stack[table][1]:  # below the deepest level that is shown
            self.blocks[-1].gap()
            return
        in_row = len(self.stack) > table + 1 and self.stack[table + 1][0] == "tr"
        self.pop_to(table + 2 if name in ("td", "th") and in_row else table + 1)
        rows = self.blocks[-1].rows
        if name == "tr" or name in ("td", "th") and not in_row:
            self.push("tr", {}, False)
            rows.append([])
        if name in ("td", "th"):
            self.push(name, attributes, True)
            if not self.stack[-1][1]:
                self.blocks[-1].gap()
        elif name == "caption":
            self.blocks[-1].gap()

    def end(self, name: str) -> None:
        if self.verbatim:
            if name == "pre":
                self.pop()
        elif name in _MARKS:
            self.blocks[-1].unmark(name)
        elif name == "table":
            if self.tables:
                self.pop_to(self.tables[-1])
        elif name in _TABLE_PARTS:
            if self.tables and self.stack[self.tables[-1]][1]:
                table = self.tables[-1]
                in_row = len(self.stack) > table + 1 and self.stack[table + 1][0] == "tr"
                if name == "caption":
                    self.blocks[-1].gap()
                else:
                    self.pop_to(table + 2 if name in ("td", "th") and in_row else table + 1)
        elif name in _HEADINGS:
            self.end_paragraph()
        elif name in _BLOCKS and self.names[-1][name] > 0:
            while True:
                top = self.stack[-1][0]
                self.pop()
                if top == name:
                    break


def page_markdown(text: str) -> str:
    """Markdown of one page."""
    page = _Page()
    for kind, value, attributes in tokens(text.replace(_KEPT, "").replace("\x01", "")):
        if kind == "start":
            page.start(value, attributes)
        elif kind == "end":
            page.end(value)
        elif page.verbatim:
            page.blocks[-1].parts.append(decoded(value))
        else:
            page.blocks[-1].text(value)
    page.pop_to(0)
    return page.blocks[0].markdown()
