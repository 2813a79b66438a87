"""The tree of an HTML page as its text pieces, each with the elements that it stands in.

Follows the HTML standard's tree construction as far as it decides where text belongs: scopes of end tags, implied end tags, tables
with misplaced content, formatting elements that go on behind a block, forms, selects and foreign content. There is no tree in memory
but the open elements and, of each piece, a link to its element; elements link to their parents.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

#: fixed values: element classes of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
CLOSE_P = BLOCKS | HEADINGS | frozenset("dd dt form hr li listing plaintext pre table xmp".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SECTIONS = frozenset("tbody tfoot thead".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
IN_TABLE = SECTIONS | {"table", "tr"}
MARKERS = frozenset("applet caption marquee object td template th".split())
SCOPE = frozenset("applet caption html marquee object table td template th foreignobject desc".split())
SCOPES = {"li": SCOPE | {"ol", "ul"}, "p": SCOPE | {"button"}, "table": frozenset(("html", "table", "template"))}
SPECIAL = CLOSE_P | VOID | MARKERS | IN_TABLE | frozenset("body button colgroup frame frameset head html iframe noembed noframes noscript script select style textarea title".split()) - {"dialog"}
BOUNDING = TABLE_PARTS | {"select", "table", "template"}
FOREIGN = frozenset(("math", "svg"))
INTEGRATION = frozenset("desc foreignobject title annotation-xml mi mn mo ms mtext".split())
BREAKOUT = FORMATTING - {"a", "font"} | HEADINGS | frozenset("blockquote body br center dd div dl dt embed head hr img li listing menu meta ol p pre ruby span sub sup table ul var".split())

#: As in browsers: what is nested deeper stands beside the last element of this depth.
DEEPEST = 512
COMMENT_END = re.compile(r"--!?>")


class Node:
    """An element: its tag, attributes, parent, and what `mark` says of it."""

    __slots__ = ("tag", "attrs", "parent", "mark", "number", "at")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None, mark: object, number: int, at: int | None) -> None:
        self.tag, self.attrs, self.parent, self.mark, self.number, self.at = tag, attrs, parent, mark, number, at


class Tree(HTMLParser):
    """`pieces`: [element, text] in the order of the tree. Subclasses mark elements as they open, from their parent's mark."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.count = 0
        self.in_body = False
        self.met: set[str] = set()  # tags of all elements so far
        self.form: Node | None = None
        self.pieces: list[list] = []
        self.active: list[Node | None] = []
        self.open = [Node("html", {}, None, self.mark(None, "html", {}), 0, None)]

    def mark(self, parent: Node | None, tag: str, attrs: dict[str, str | None]) -> object:
        return None

    # the open elements

    @property
    def foreign(self) -> bool:
        """Whether content goes into SVG or MathML."""
        if self.met.isdisjoint(FOREIGN):
            return False
        for node in reversed(self.open):
            if node.tag in FOREIGN:
                return True
            if node.tag in INTEGRATION or node.tag in SCOPE or node.tag in BLOCKS:
                return False
        return False

    def mode(self) -> str:
        """What bounds the insertion: td, th, caption, a part of a table, select, or body."""
        if self.met.isdisjoint(BOUNDING):
            return "body"
        for node in reversed(self.open):
            if node.tag in BOUNDING:
                return node.tag
        return "body"

    def scoped(self, tag: str, *others: str, kind: str = "") -> bool:
        """Whether an element of the tags is open, within the scope."""
        bounds = SCOPES.get(kind, SCOPE)
        for node in reversed(self.open):
            if node.tag == tag or node.tag in others:
                return True
            if node.tag in bounds:
                return False
        return False

    def pop(self) -> Node:
        node = self.open.pop()
        if node.tag in MARKERS:
            while self.active and self.active.pop() is not None:
                pass
        return node

    def pop_until(self, *tags: str) -> None:
        while len(self.open) > 1 and self.pop().tag not in tags:
            pass

    def pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.open) > 1 and self.open[-1].tag not in tags:
            self.pop()

    def imply(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self.pop()

    def close_p(self) -> None:
        if self.scoped("p", kind="p"):
            self.pop_until("p")

    def place(self) -> Node:
        """The parent of what comes next: that of the table, where it can't stand in one."""
        if self.open[-1].tag in IN_TABLE:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    return self.open[i].parent or self.open[i - 1]
        return self.open[-1]

    def insert(self, tag: str, attrs: dict[str, str | None], inside: bool = False) -> Node:
        if len(self.open) > DEEPEST:
            self.pop()
        parent = self.open[-1] if inside else self.place()
        self.count += 1
        self.met.add(tag)
        at = len(self.pieces) if tag == "table" else None
        node = Node(tag, attrs, parent, self.mark(parent, tag, attrs), self.count, at)
        if tag not in VOID:
            self.open.append(node)
            if tag in MARKERS:
                self.active.append(None)
        return node

    # formatting elements

    def reopen(self) -> None:
        """Opens again the formatting elements that a block has closed."""
        todo = []
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None or self.active[i] in self.open:
                break
            todo.append(i)
        for i in reversed(todo):
            self.active[i] = self.insert(self.active[i].tag, self.active[i].attrs)

    def format(self, tag: str, attrs: dict[str, str | None]) -> None:
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            if (node := self.active[i]) is None:
                break
            if node.tag == tag and node.attrs == attrs:
                same.append(i)
        if len(same) > 2:
            del self.active[same[-1]]
        self.active.append(self.insert(tag, attrs))
        if len(self.active) > DEEPEST:
            del self.active[0]

    def end_format(self, tag: str) -> None:
        """Ends the innermost formatting element of the tag; blocks inside it stay open, beside it from now on."""
        found = None
        for node in reversed(self.active):
            if node is None:
                break
            if node.tag == tag:
                found = node
                break
        if found is None:
            return self.end_other(tag)
        if found not in self.open:
            self.active.remove(found)
            return None
        i = self.open.index(found)
        if any(n.tag in SCOPE for n in self.open[i + 1 :]):
            return None
        self.active.remove(found)
        block = next((k for k in range(i + 1, len(self.open)) if self.open[k].tag in SPECIAL), None)
        if block is None:
            del self.open[i:]
            return None
        parent, rest = self.open[i - 1], self.open[i + 1 :]
        del self.open[i:]
        for node in rest:  # what follows belongs to the block, which isn't below the formatting element any more
            moved = Node(node.tag, node.attrs, parent, self.mark(parent, node.tag, node.attrs), node.number, node.at)
            if node in self.active:
                self.active[self.active.index(node)] = moved
            if node is self.form:
                self.form = moved
            self.open.append(moved)
            parent = moved
        return None

    def end_other(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i].tag in SPECIAL:
                return

    # tokens

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment ends at --> or --!>, at once as <!--> or <!--->, or with the page."""
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.foreign and self.open[-1].tag == tag:
            self.pop()
        elif tag in self.CDATA_CONTENT_ELEMENTS and not self.foreign:
            self.set_cdata_mode(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(reversed(attrs))
        if self.foreign:
            if tag not in BREAKOUT:
                self.insert(tag, own)
                return
            while self.foreign:
                self.pop()
        if tag == "image":
            tag = "img"
        if not self.in_body:
            if tag not in HEAD:
                self.begin_body()
            elif tag not in ("html", "head") and self.open[-1].tag == "html":
                self.insert("head", {})
        if tag == "html":
            return
        if tag == "head":
            if not self.in_body and self.open[-1].tag == "html":
                self.insert(tag, own)
            return
        if tag == "body":
            body = self.open[1]
            for k, v in own.items():
                body.attrs.setdefault(k, v)
            body.mark = self.mark(body.parent, "body", body.attrs)
            return
        self.start(tag, own)
        if tag in RAW and self.open[-1].tag == tag and tag not in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def begin_body(self) -> None:
        self.in_body = True
        del self.open[1:]
        self.insert("body", {})

    def start(self, tag: str, attrs: dict[str, str | None]) -> None:
        mode = self.mode()
        if mode == "select":
            if tag in ("option", "optgroup", "hr"):
                self.pop_to({"select", "optgroup"} if tag == "option" else {"select"})
                self.insert(tag, attrs)
                return
            if tag in ("script", "template"):
                self.insert(tag, attrs)
                return
            if tag not in ("select", "input", "textarea") and tag not in TABLE_PARTS | {"table"}:
                return
            self.pop_until("select")
            if tag != "select":
                self.start(tag, attrs)
            return
        if tag in TABLE_PARTS:
            self.table_part(tag, attrs, mode)
            return
        if mode in IN_TABLE or mode == "colgroup":
            if mode == "colgroup":
                self.pop_to(IN_TABLE)
            if tag == "table":
                self.pop_until("table")
                self.start(tag, attrs)
                return
            if tag == "form":
                if self.form is None:
                    self.form = self.insert(tag, attrs, inside=True)
                    self.open.pop()
                return
            if tag in ("script", "style", "template") or tag == "input" and (attrs.get("type") or "").lower() == "hidden":
                self.insert(tag, attrs, inside=True)
                return
        self.body_start(tag, attrs)

    def table_part(self, tag: str, attrs: dict[str, str | None], mode: str) -> None:
        if mode in ("td", "th", "caption"):
            self.pop_until(mode)
            mode = self.mode()
        if mode not in IN_TABLE and mode != "colgroup":
            return
        if tag in ("td", "th"):
            self.pop_to(IN_TABLE)
            if self.open[-1].tag != "tr":
                self.table_part("tr", {}, self.mode())
        elif tag == "tr":
            self.pop_to(IN_TABLE - {"tr"})
            if self.open[-1].tag == "table":
                self.insert("tbody", {}, inside=True)
        elif tag == "col" and mode == "colgroup":
            return
        else:
            self.pop_to({"table"})
        if tag != "col":
            self.insert(tag, attrs, inside=True)

    def body_start(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag == "form":
            if self.form is not None:
                return
            self.close_p()
            self.form = self.insert(tag, attrs)
            return
        if tag == "li" or tag in ("dd", "dt"):
            ended = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.tag in ended:
                    self.imply(node.tag)
                    self.pop_until(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
        if tag in CLOSE_P:
            self.close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        elif tag == "button" and self.scoped("button"):
            self.pop_until("button")
        elif tag in ("option", "optgroup") and self.open[-1].tag == "option":
            self.pop()
        elif tag in ("rb", "rtc", "rp", "rt") and self.scoped("ruby"):
            self.imply("rtc" if tag in ("rp", "rt") else "")
        elif tag == "a" or tag == "nobr" and self.scoped("nobr"):
            if any(n is not None and n.tag == tag for n in self.active[self.last_marker() :]):
                self.end_format(tag)
        if tag in FORMATTING:
            self.reopen()
            self.format(tag, attrs)
            return
        if tag not in CLOSE_P and tag not in HEAD:
            self.reopen()
        self.insert(tag, attrs)

    def last_marker(self) -> int:
        return max((i + 1 for i, n in enumerate(self.active) if n is None), default=0)

    def handle_endtag(self, tag: str) -> None:
        if self.foreign:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return
                if self.open[i].tag in FOREIGN:
                    break
        if tag == "head" and not self.in_body:
            if len(self.open) > 1:
                self.begin_body()
            return
        if tag in ("head", "html", "body"):
            return
        if tag in VOID and tag != "br":
            return
        mode = self.mode()
        if mode == "select":
            self.end_in_select(tag)
        elif tag == "table" or tag in TABLE_PARTS:
            self.end_table(tag, mode)
        elif tag == "form":
            form, self.form = self.form, None
            if form is not None and form in self.open and self.scoped("form"):
                self.imply()
                self.open.remove(form)
        elif tag in FORMATTING:
            self.end_format(tag)
        elif tag in HEADINGS:
            if self.scoped(*HEADINGS):
                self.pop_until(*HEADINGS)
        elif tag in CLOSE_P - {"p", "hr"} or tag in ("button", "applet", "marquee", "object"):
            if self.scoped(tag, kind=tag):
                self.pop_until(tag)
        elif tag == "p":
            self.close_p()
        elif tag != "br":
            self.end_other(tag)

    def end_in_select(self, tag: str) -> None:
        if tag == "select" or tag in TABLE_PARTS | {"table"} and self.scoped(tag, kind="table"):
            self.pop_until("select")
            if tag != "select":
                self.handle_endtag(tag)
        elif tag in ("option", "optgroup") and any(n.tag == tag for n in self.open[-2:]):
            self.pop_until(tag)

    def end_table(self, tag: str, mode: str) -> None:
        bound = frozenset(("table", "html", "template"))
        if not any(n.tag == tag for n in self.innermost(bound)):
            return
        if tag != "caption" and mode in ("td", "th", "caption") and mode != tag:
            if tag in ("col", "colgroup", "td", "th"):
                return
            self.pop_until(mode)
        self.pop_until(tag)

    def innermost(self, bound: frozenset[str]) -> list[Node]:
        """The open elements of the innermost table, itself included."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in bound:
                return self.open[i:]
        return []

    def handle_data(self, data: str) -> None:
        if self.cdata_elem:
            node = self.open[-1]
            self.pieces.append([node, unescape(data) if node.tag in ("textarea", "title") else data])
            return
        blank = not data.strip(" \t\n\f\r")
        if not self.in_body:
            if blank:
                return
            self.begin_body()
        if not self.foreign:
            if blank and self.open[-1].tag in IN_TABLE:
                self.pieces.append([self.open[-1], data])
                return
            if self.mode() == "colgroup" and not blank:
                self.pop_to(IN_TABLE)
            self.reopen()
        self.put(data)

    def put(self, data: str) -> None:
        """Adds text where it belongs: before the table if it, or the element that it is in, can't stand there."""
        parent = self.place()
        tables = [n for n in self.open if n.tag == "table"] if "table" in self.met else []
        at = None
        if tables and self.open[-1].tag in IN_TABLE:
            at = tables[-1]
        elif tables:
            above, node = set(), parent
            while node is not None:
                above.add(node)
                node = node.parent
            at = next((t for t in tables if t not in above), None)
        if at is None:
            self.pieces.append([parent, data])
            return
        self.pieces.insert(at.at, [parent, data])
        for t in tables:
            if t.at >= at.at:
                t.at += 1
