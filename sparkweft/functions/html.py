"""An HTML tree builder in plain Python, following the HTML standard where pages depend on it.

Covered: implied html, head, body, tbody and tr; elements that close others (p, li,
dt, dd, option, headings, table parts); void, raw-text and RCDATA elements; the list
of active formatting elements with reconstruction and the adoption agency; foster
parenting; first-wins attributes; character references; ends of input anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD_PARTS = frozenset("base basefont bgsound link meta noframes script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset(("applet", "marquee", "object"))
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
ROW_GROUPS = frozenset(("tbody", "thead", "tfoot"))
TABLE_PARTS = frozenset(("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"))
IN_TABLE = frozenset(("table", "tbody", "thead", "tfoot", "tr"))
SPECIAL = (
    BLOCKS
    | HEADINGS
    | TABLE_PARTS
    | MARKED
    | VOID
    | RAW
    | RCDATA
    | frozenset("body button dd dt form frame frameset head html li listing noscript plaintext pre select table template".split())
)
SCOPE = frozenset(("html", "table", "td", "th", "caption", "template")) | MARKED
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset(("html", "table", "template"))

_space = " \t\n\r\f"
_attr = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
_name = re.compile(r"[a-zA-Z][^\s/>\0]*")
_reference = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


class Node:
    """An element; children are elements, strings (text) and ``Comment``."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag = tag
        self.attrs = attrs if attrs is not None else {}
        self.children: list = []
        self.parent: Node | None = None

    def elements(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """All text below, as it stands; script and style included."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, Node):
                stack.extend(reversed(node.children))
        return "".join(out)

    def inner_html(self) -> str:
        out: list[str] = []
        for c in self.children:
            _serialise(c, out, self.tag in RAW)
        return "".join(out)

    def outer_html(self) -> str:
        out: list[str] = []
        _serialise(self, out, False)
        return "".join(out)


class Comment:
    __slots__ = ("data",)

    def __init__(self, data: str):
        self.data = data


def _serialise(root, out: list[str], raw: bool) -> None:
    stack = [(root, raw)]
    while stack:
        node, raw = stack.pop()
        if isinstance(node, tuple):
            out.append(node[0])
        elif isinstance(node, str):
            out.append(node if raw else node.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif isinstance(node, Comment):
            out.append(f"<!--{node.data}-->")
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")}"' for k, v in node.attrs.items())
            out.append(f"<{node.tag}{attrs}>")
            if node.tag not in VOID:
                stack.append(((f"</{node.tag}>",), False))
                inside = node.tag in RAW
                stack.extend((c, inside) for c in reversed(node.children))


def _decode_attr(value: str) -> str:
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        ref = m[0]
        if ref[1] == "#" or ref[-1] == ";":
            return unescape(ref)
        nxt = value[m.end() : m.end() + 1]
        return unescape(ref) if ref[1:] in html5 and nxt != "=" and not nxt.isalnum() else ref

    return _reference.sub(one, value)


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.stack: list[Node] = [self.root]
        self.head: Node | None = None
        self.body: Node | None = None
        self.active: list[Node | None] = []  # formatting elements; None is a marker
        self.form: Node | None = None
        self.mode = "before head"
        self.skip_newline = False
        self.tables = 0

    # -- places ---------------------------------------------------------------
    def _place(self, target: Node | None = None) -> tuple[Node, int]:
        """Where the next node goes: a parent, and an index into its children."""
        parent = target or self.stack[-1]
        if self.fostering and parent.tag in IN_TABLE:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is None:
                return self.stack[0], len(self.stack[0].children)
            if table.parent is not None:
                above = table.parent
                return above, next(i for i, c in enumerate(above.children) if c is table)
            above = self.stack[self.stack.index(table) - 1]
            return above, len(above.children)
        return parent, len(parent.children)

    fostering = False

    def _put(self, node: Node, target: Node | None = None) -> None:
        parent, at = self._place(target)
        node.parent = parent
        parent.children.insert(at, node)

    def insert(self, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs)
        self._put(node)
        self.stack.append(node)
        if tag == "table":
            self.tables += 1
        return node

    def insert_text(self, data: str) -> None:
        parent, at = self._place()
        before = parent.children[at - 1] if at else None
        if isinstance(before, str):
            parent.children[at - 1] = before + data
        else:
            parent.children.insert(at, data)

    # -- the stack ------------------------------------------------------------
    def in_scope(self, tag: str, stop: frozenset[str] = SCOPE) -> bool:
        for n in reversed(self.stack):
            if n.tag == tag:
                return True
            if n.tag in stop:
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().tag in tags:
                return

    def imply_ends(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_to("p")

    def clear_to(self, tags: frozenset[str]) -> None:
        while len(self.stack) > 1 and self.stack[-1].tag not in tags:
            self.stack.pop()

    # -- formatting -----------------------------------------------------------
    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def push_active(self, node: Node) -> None:
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            a = self.active[i]
            if a is None:
                break
            if a.tag == node.tag and a.attrs == node.attrs:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.insert(old.tag, dict(old.attrs))

    def adopt(self, tag: str) -> None:
        """The adoption agency: closes a formatting element that other elements were opened in."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for a in reversed(self.active):
                if a is None:
                    break
                if a.tag == tag:
                    fmt = a
                    break
            if fmt is None:
                self.end_other(tag)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            if not self.in_scope(tag):
                return
            at = self.stack.index(fmt)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            ancestor = self.stack[at - 1]
            mark = self.active.index(fmt)
            last, i = block, self.stack.index(block)
            rounds = 0
            while True:
                rounds += 1
                i -= 1
                node = self.stack[i]
                if node is fmt:
                    break
                if node in self.active and rounds > 3:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[i]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.stack[i] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                self._move(last, copy)
                last = copy
            if last.parent is not None:
                last.parent.children = [c for c in last.parent.children if c is not last]
            was, self.fostering = self.fostering, True
            self._put(last, ancestor)
            self.fostering = was
            copy = Node(fmt.tag, dict(fmt.attrs))
            copy.children, block.children = block.children, []
            for c in copy.children:
                if isinstance(c, Node):
                    c.parent = copy
            copy.parent = block
            block.children.append(copy)
            old = self.active.index(fmt)
            del self.active[old]
            self.active.insert(mark - 1 if old < mark else mark, copy)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, copy)

    @staticmethod
    def _move(node: Node, to: Node) -> None:
        if node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
        node.parent = to
        to.children.append(node)

    # -- tokens ---------------------------------------------------------------
    def text(self, data: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            data = data[1:] if data[:1] == "\n" else data
        if not data:
            return
        if self.mode != "body":
            rest = data.lstrip(_space)
            blank = data[: len(data) - len(rest)]
            if self.mode == "head" and blank:
                self.insert_text(blank)
            elif self.mode == "after head" and blank:
                self.insert_text(blank)
            if not rest:
                return
            self.open_body({})
            data = rest
        blank = not data.strip(_space)
        if self.tables and self.stack[-1].tag in IN_TABLE:
            if blank:
                self.insert_text(data)
                return
            self.fostering = True
            self.reconstruct()
            self.insert_text(data)
            self.fostering = False
            return
        self.reconstruct()
        self.insert_text(data)

    def comment(self, data: str) -> None:
        node = self.stack[-1] if self.mode != "before head" else self.root
        node.children.append(Comment(data))

    def open_head(self, attrs: dict[str, str]) -> None:
        self.head = self.insert("head", attrs)
        self.mode = "head"

    def open_body(self, attrs: dict[str, str]) -> None:
        if self.head is None:
            self.open_head({})
        while len(self.stack) > 1:
            self.stack.pop()
        self.body = self.insert("body", attrs)
        self.mode = "body"

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self.skip_newline = False
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.mode != "body":
            if tag == "head":
                if self.head is None:
                    self.open_head(attrs)
                return
            if tag in HEAD_PARTS or tag == "noscript" and self.mode != "after head":
                if self.head is None:
                    self.open_head({})
                back = self.mode == "after head"
                if back:
                    self.stack.append(self.head)
                self.insert(tag, attrs)
                if tag in VOID or tag in ("basefont", "bgsound"):
                    self.stack.pop()
                if back and tag in VOID:
                    self.stack.remove(self.head)
                return
            self.open_body(attrs if tag == "body" else {})
            if tag in ("body", "frameset"):
                return
        self.start_in_body(tag, attrs, closed)

    def start_in_body(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in TABLE_PARTS:
            self.start_in_table(tag, attrs)
            return
        here = self.stack[-1].tag
        if self.tables and here in IN_TABLE and tag not in ("script", "style", "template", "table"):
            if tag == "input" and attrs.get("type", "").lower() == "hidden":
                self.insert(tag, attrs)
                self.stack.pop()
                return
            self.fostering = True
            self.start_plain(tag, attrs, closed)
            self.fostering = False
            return
        self.start_plain(tag, attrs, closed)

    def start_plain(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("body", "head", "frame", "frameset"):
            if tag == "body" and self.body is not None:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
        elif tag in HEAD_PARTS:
            self.insert(tag, attrs)
            if tag in VOID or tag in ("basefont", "bgsound"):
                self.stack.pop()
        elif tag in BLOCKS:
            self.close_p()
            self.insert(tag, attrs)
        elif tag in HEADINGS:
            self.close_p()
            if self.stack[-1].tag in HEADINGS:
                self.stack.pop()
            self.insert(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_newline = True
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.insert(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            mates = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.tag in mates:
                    self.imply_ends(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "button":
            if self.in_scope("button"):
                self.imply_ends()
                self.pop_to("button")
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            if tag == "a":
                for a in reversed(self.active):
                    if a is None:
                        break
                    if a.tag == "a":
                        self.adopt("a")
                        if a in self.active:
                            self.active.remove(a)
                        if a in self.stack:
                            self.stack.remove(a)
                        break
            self.reconstruct()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.push_active(self.insert(tag, attrs))
        elif tag in MARKED:
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            if self.stack[-1].tag in IN_TABLE and self.in_scope("table", TABLE_SCOPE):
                self.end("table")
            self.close_p()
            self.insert(tag, attrs)
        elif tag in ("hr", "param", "source", "track"):
            if tag == "hr":
                self.close_p()
            self.insert(tag, attrs)
            self.stack.pop()
        elif tag in VOID or tag == "image":
            self.reconstruct()
            self.insert("img" if tag == "image" else tag, attrs)
            self.stack.pop()
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply_ends("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        else:
            if tag not in RAW and tag not in RCDATA:
                self.reconstruct()
            self.insert(tag, attrs)
            self.skip_newline = tag == "textarea"
            if closed and any(n.tag in ("svg", "math") for n in self.stack):
                self.stack.pop()

    def start_in_table(self, tag: str, attrs: dict[str, str]) -> None:
        if not self.in_scope("table", TABLE_SCOPE):
            return
        if self.in_scope("caption", TABLE_SCOPE):
            self.end("caption")
        if tag in ("td", "th"):
            for cell in ("td", "th"):
                if self.in_scope(cell, TABLE_SCOPE):
                    self.end(cell)
            self.clear_to(IN_TABLE)
            if self.stack[-1].tag == "table":
                self.insert("tbody")
            if self.stack[-1].tag != "tr":
                self.insert("tr")
            self.insert(tag, attrs)
            self.active.append(None)
            return
        for cell in ("td", "th"):
            if self.in_scope(cell, TABLE_SCOPE):
                self.end(cell)
        if tag == "tr":
            self.clear_to(ROW_GROUPS | {"table"})
            if self.stack[-1].tag == "table":
                self.insert("tbody")
            self.insert(tag, attrs)
            return
        self.clear_to(frozenset(("table", "colgroup")) if tag == "col" else frozenset(("table",)))
        if tag == "col":
            if self.stack[-1].tag == "table":
                self.insert("colgroup")
            self.insert(tag, attrs)
            self.stack.pop()
            return
        self.insert(tag, attrs)
        if tag == "caption":
            self.active.append(None)

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if self.mode != "body":
            if tag == "head" and self.mode == "head":
                self.clear_to(frozenset(("html",)))
                self.mode = "after head"
                return
            if self.stack[-1].tag == tag and tag not in ("html", "head"):
                self.stack.pop()
                if self.mode == "after head" and self.head in self.stack:
                    self.stack.remove(self.head)
                return
            if tag not in ("body", "html", "br"):
                return
            self.open_body({})
        if tag in ("body", "html"):
            return
        if tag in BLOCKS or tag in ("button", "listing", "pre") or tag in MARKED:
            if tag == "p":
                if not self.in_scope("p", BUTTON_SCOPE):
                    self.insert("p")
                self.close_p()
            elif self.in_scope(tag):
                self.imply_ends()
                self.pop_to(tag)
                if tag in MARKED:
                    self.clear_to_marker()
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack:
                self.imply_ends()
                self.stack.remove(node)
        elif tag in ("li", "dd", "dt"):
            if self.in_scope(tag, LIST_SCOPE if tag == "li" else SCOPE):
                self.imply_ends(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if any(self.in_scope(h) for h in HEADINGS):
                self.imply_ends()
                self.pop_to(*HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag == "br":
            self.start_in_body("br", {}, False)
        elif tag in ("td", "th", "caption"):
            if self.in_scope(tag, TABLE_SCOPE):
                self.imply_ends()
                self.pop_to(tag)
                self.clear_to_marker()
        elif tag in ROW_GROUPS or tag in ("tr", "table", "colgroup"):
            if self.in_scope(tag, TABLE_SCOPE):
                for cell in ("td", "th", "caption"):
                    if tag != "colgroup" and self.in_scope(cell, TABLE_SCOPE):
                        self.end(cell)
                self.pop_to(tag)
                if tag == "table":
                    self.tables -= 1
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            n = self.stack[i]
            if n.tag == tag:
                self.imply_ends(tag)
                del self.stack[i:]
                return
            if n.tag in SPECIAL:
                return


def parse_html(source: str | None) -> Node:
    """The ``html`` element of a page; null and empty sources give empty head and body."""
    s = (source or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    b = _Builder()
    at, size = 0, len(s)
    raw_ends: dict[str, re.Pattern] = {}
    while at < size:
        lt = s.find("<", at)
        if lt < 0 or lt == size - 1:
            _text(b, s[at:])
            break
        if lt > at:
            _text(b, s[at:lt])
            at = lt
        c = s[at + 1]
        if c == "!" or c == "?":
            if s.startswith("<!--", at):
                if s.startswith("<!-->", at) or s.startswith("<!--->", at):
                    b.comment("")
                    at = s.index(">", at) + 1
                    continue
                end = s.find("-->", at + 4)
                b.comment(s[at + 4 :] if end < 0 else s[at + 4 : end])
                at = size if end < 0 else end + 3
            else:
                end = s.find(">", at)
                if s[at + 2 : at + 9].lower() != "doctype":
                    b.comment(s[at + (2 if c == "!" else 1) : size if end < 0 else end])
                at = size if end < 0 else end + 1
            continue
        closing = c == "/"
        m = _name.match(s, at + 1 + closing)
        if not m:
            if closing:  # </ and no name: a comment up to >, or text at the end
                end = s.find(">", at)
                if end > at + 2:
                    b.comment(s[at + 2 : end])
                at = size if end < 0 else end + 1
            else:
                _text(b, "<")
                at += 1
            continue
        tag = m[0].lower()
        at = m.end()
        attrs: dict[str, str] = {}
        while True:
            a = _attr.match(s, at)
            if not a:
                at = size  # the input ends within the tag, which is dropped
                tag = ""
                break
            at = a.end()
            if a[1]:
                break
            value = a[3] if a[3] is not None else a[4] if a[4] is not None else a[5]
            attrs.setdefault(a[2].lower(), _decode_attr(value or ""))
        if not tag:
            break
        if closing:
            b.end(tag)
            continue
        b.start(tag, attrs, s[at - 2 : at] == "/>")
        if (tag in RAW or tag in RCDATA) and b.stack[-1].tag == tag:
            if tag not in raw_ends:
                raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE)
            end = raw_ends[tag].search(s, at)
            data = s[at : end.start() if end else size]
            if data:
                if tag in RCDATA:
                    data = unescape(data) if "&" in data else data
                if b.skip_newline and data[:1] == "\n":
                    data = data[1:]
                b.skip_newline = False
                if data:
                    b.insert_text(data)
            if end:
                gt = s.find(">", end.end())
                at = size if gt < 0 else gt + 1
            else:
                at = size
            if b.mode == "body":
                b.stack.pop()
            else:
                b.end(tag)
    if b.body is None:
        b.open_body({})
    return b.root


def _text(b: _Builder, data: str) -> None:
    b.text(unescape(data) if "&" in data else data)
