"""HTML extraction by layout-aware rendering.

A tokenizer reads tags, comments, character data and entities; a tree builder
applies the implied end tags of paragraphs, list items, table parts and
headings; a renderer walks the tree and emits all visible text: blocks are
spaced, list items are marked and indented, preformatted text keeps its
lines, and table cells are aligned in columns, with cells that span columns
and rows. Both walk with a stack of their own, so a page may be nested to any
depth.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.llm.common import map_texts

#: Element names by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video datalist title meta link noembed noframes defs desc metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
LISTS = frozenset("ul ol menu dir".split())
#: Kinds of input fields that show their value.
FIELDS = frozenset("text search url tel email number date month week time datetime-local submit reset button".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
#: An opening tag of the first group ends an open element of the second, but not beyond one of the third.
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Opening any of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
PARAGRAPH_WALL = frozenset("table td th caption button body html".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template head html".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.DOTALL)
#: The same without regard to quotes, for tags with a quote that nothing closes.
LOOSE = re.compile(r"<(?P<cdata>\b\B)?(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*+)(?:>|\Z)")
OPENING = re.compile(r"<(?=[A-Za-z!?]|/[A-Za-z])")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
KEPT_SPACE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|break-spaces)", re.IGNORECASE)


class Node:
    """An element with its children, which are nodes and strings."""

    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTR.finditer(source)} if source.strip(" /\n\t") else {}


class Open:
    """The open elements, with the places of each name, so that looking for one does not walk over the others."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.name: [0]}

    def add(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost element of names; -1 without one. The root does not count."""
        return max((p[-1] for n in names if (p := self.places.get(n)) and p[-1]), default=-1)

    def end(self, names: frozenset[str], walls: frozenset[str]) -> None:
        """Ends the open elements down to the outermost one of names inside the nearest wall."""
        wall = max(self.last(walls), 0)
        inside = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, wall)) < len(p)]
        if inside:
            self.cut(min(inside))


WALLS = ("td", "th", "table")
THROUGH = frozenset("table tr tbody thead tfoot td th body html".split())


def parse(source: str) -> Node:
    """The tree of a page. Unknown or unmatched end tags are ignored; open elements end with the page."""
    root = Node("html")
    stack = Open(root)
    nodes = stack.nodes
    at = data_from = 0
    while True:
        opening = OPENING.search(source, at)
        m = None
        if opening:
            m = TAG.match(source, opening.start()) or LOOSE.match(source, opening.start())
            if not m:
                at = opening.end()
                continue
        data = source[data_from : m.start() if m else len(source)]
        if data:
            if nodes[-1].name == "head" and data.strip():
                stack.cut(len(nodes) - 1)
            nodes[-1].kids.append(html.unescape(data))
        if not m:
            return root
        at = data_from = m.end()
        if m["cdata"] is not None:
            nodes[-1].kids.append(m["cdata"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "p" and stack.last(("p",)) < 0:
                nodes[-1].kids.append(Node("p"))
            elif name == "br":
                nodes[-1].kids.append(Node("br"))
            elif (place := stack.last((name,))) > 0 and (name in THROUGH or place >= stack.last(WALLS)):
                stack.cut(place)
            continue
        if name == "html":
            root.attrs.update(_attributes(m["attrs"]))
            continue
        if nodes[-1].name == "head" and name not in HEAD_ONLY:
            stack.cut(len(nodes) - 1)
        if name in ENDS_PARAGRAPH:
            stack.end(frozenset(["p"]), PARAGRAPH_WALL)
        if name in CLOSES:
            stack.end(*CLOSES[name])
        node = Node(name, _attributes(m["attrs"]))
        nodes[-1].kids.append(node)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.IGNORECASE).search(source, at)
            raw = source[at : stop.start()]
            node.kids.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = data_from = stop.end()
            continue
        stack.add(node)


def visible(node: Node) -> bool:
    """Whether an element has a box: by its name, the hidden attribute and its own display. A dialog has one only when open."""
    a = node.attrs
    if node.name in HIDDEN or "hidden" in a or node.name == "dialog" and "open" not in a:
        return False
    return not ("style" in a and NONE.search(a["style"]))


def columns(s: str) -> int:
    """Columns that a line takes: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Collects lines: inline text runs on, blocks break lines, spaced blocks leave an empty line.

    leads: what stands before a line, outermost first: [columns, mark that is
    still to be shown or None].
    """

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.leads: list[list] = []

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if not self.now or self.now[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def kept(self, s: str) -> None:
        """Text that keeps its spaces and lines."""
        for i, part in enumerate(s.split("\n")):
            if i:
                self._put("".join(self.now))
                self.now = []
            if part:
                self.now.append(part)

    def flush(self) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = "".join(mark if mark else " " * n for n, mark in self.leads)
        for x in self.leads:
            x[1] = None
        self.lines.append((lead + line).rstrip())

    def put_all(self, lines: list[str]) -> None:
        for x in lines:
            self._put(x)

    def block(self, spaced: bool) -> None:
        self.flush()
        if spaced and not (self.leads and self.leads[-1][1]):
            self.gap = max(self.gap, 1)

    def line_break(self) -> None:
        if "".join(self.now).strip(" "):
            self.flush()
        else:
            self.now = []
            self.gap += 1

    def enter(self, mark: str | None, width: int) -> None:
        self.flush()
        self.leads.append([width, mark])

    def leave(self, item: bool = False) -> None:
        """Ends an indented part; the mark of an empty item is shown alone."""
        self.flush()
        if item:
            if self.leads[-1][1]:
                self._put("")
            self.gap = 0
        self.leads.pop()

    def whole(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _number(raw: str, default: int, most: int = 10**9) -> int:
    return min(int(raw), most) if re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", raw) else default


def _rows(table: Node) -> tuple[list[Node | str], list[list[Node]]]:
    """What stands beside the cells of a table, and its rows of cells, without those of nested tables."""
    beside, rows, open_row = [], [], False
    todo = list(reversed(table.kids))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip():
                beside.append(n)
        elif not visible(n):
            continue
        elif n.name == "tr":
            loose = Node("td")
            cells = []
            for c in n.kids:
                if isinstance(c, str) and not c.strip():
                    continue
                if isinstance(c, Node) and not visible(c):
                    continue
                if isinstance(c, Node) and c.name in ("td", "th"):
                    cells.append(c)
                else:
                    loose.kids.append(c)
            rows.append([*cells, loose] if loose.kids else cells)
            open_row = False
        elif n.name in ("thead", "tbody", "tfoot", "colgroup", "form"):
            todo += reversed(n.kids)
            open_row = False
        elif n.name in ("td", "th"):
            if not open_row:
                rows.append([])
            open_row = True
            rows[-1].append(n)
        else:
            beside.append(n)
    return beside, rows


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """(first column, column after, cell) of each row. Only columns in which some cell begins count; cells that reach down keep their columns."""
    out, down = [], []
    for cells in rows:
        line, at = [], 0
        for c in cells:
            while hit := next((d for d in down if d[0] <= at < d[1]), None):
                at = hit[1]
            end = at + max(_number(c.attrs.get("colspan", "1"), 1), 1)
            line.append((at, end, c))
            at = end
        down = [[a, b, n - 1] for a, b, n in down if n > 1]
        for a, b, c in line:
            n = _number(c.attrs.get("rowspan", "1"), 1)
            if n > 1 or n == 0:
                # 0: to the end of the table
                down.append([a, b, n - 1 if n else len(rows)])
        out.append(line)
    starts = sorted({a for line in out for a, _, _ in line})
    index = {a: i for i, a in enumerate(starts)}
    return [[(index[a], bisect_right(starts, b - 1), c) for a, b, c in line] for line in out]


def _aligned(grid: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Lines of cells in aligned columns, two spaces apart; a cell of several lines takes several lines."""
    width = [0] * max((b for line in grid for _, b, _ in line), default=0)
    cells = sorted(((b - a, a, b, max(map(columns, text))) for line in grid for a, b, text in line), key=lambda c: c[:3])
    for n, a, b, need in cells:
        width[b - 1] += max(0, need - sum(width[a:b]) - 2 * (n - 1))
    begin = [0]
    for w in width:
        begin.append(begin[-1] + w + 2)
    out = []
    for line in grid:
        for k in range(max((len(text) for _, _, text in line), default=0)):
            row, at = [], 0
            for a, _, text in line:
                if k < len(text) and text[k]:
                    row += [" " * (begin[a] - at), text[k]]
                    at = begin[a] + columns(text[k])
            if row:
                out.append("".join(row))
    return out


def render(source: bytes | str | None) -> str:
    """The visible text of a page; null, empty and invisible pages give an empty text. Pages may be nested to any depth."""
    if source is None:
        return ""
    source = source.decode("utf-8", "replace") if isinstance(source, bytes) else source
    root = parse(source.replace("\r\n", "\n").replace("\x00", ""))
    page = Page()
    # steps still to be taken, the next one last: a function, or (page, node, whether spaces are kept, whether text shows)
    todo: list = []

    def kids(page: Page, nodes: list, pre: bool, shown: bool) -> None:
        todo.extend((page, k, pre, shown) for k in reversed(nodes))

    if visible(root):
        kids(page, root.kids, False, True)
    while todo:
        step = todo.pop()
        if callable(step):
            step()
            continue
        page_, node, pre, shown = step
        if isinstance(node, str):
            if shown:
                (page_.kept if pre else page_.text)(node)
            continue
        if visible(node):
            _element(page_, node, pre, shown, todo, kids)
    return page.whole()


def _element(page: Page, node: Node, pre: bool, shown: bool, todo: list, kids) -> None:
    """Shows what an element shows by itself, and plans its children and what follows them."""
    name, attrs = node.name, node.attrs
    if "style" in attrs:
        if m := VISIBILITY.search(attrs["style"]):
            shown = m[1].lower() == "visible"
        pre = pre or KEPT_SPACE.search(attrs["style"]) is not None
    if name == "br":
        page.line_break()
        return
    if name in ("img", "input"):
        said = attrs.get("alt", "") if name == "img" else attrs.get("value", "") if attrs.get("type", "text").lower() in FIELDS else ""
        if shown:
            page.text(said)
        return
    if name == "wbr":
        return
    if name == "hr":
        page.block(True)
        return
    block = name in BLOCK
    spaced = name in SPACED and not (name in LISTS and page.leads)
    if block:
        page.block(spaced)
        todo.append(lambda: page.block(spaced))
    if name == "table":
        beside, rows = _rows(node)
        grid = [[(a, b, Page(), c) for a, b, c in line] for line in _placed(rows)]
        todo.append(lambda: page.put_all(_aligned([[(a, b, inner.whole().split("\n")) for a, b, inner, _ in line] for line in grid])))
        for line in reversed(grid):
            for _, _, inner, cell in reversed(line):
                style = cell.attrs.get("style", "")
                m = VISIBILITY.search(style)
                kids(inner, cell.kids, pre or KEPT_SPACE.search(style) is not None, shown if not m else m[1].lower() == "visible")
        todo.append(page.flush)
        kids(page, beside, pre, shown)
    elif name in LISTS:
        number, planned = _number(attrs.get("start", "1"), 1), []
        for k in node.kids:
            if isinstance(k, Node) and k.name == "li":
                if not visible(k):
                    continue
                if name == "ol":
                    number = _number(k.attrs.get("value", ""), number)
                mark = f"{number}. " if name == "ol" else "- "
                number += 1
                planned += [lambda mark=mark: page.enter(mark, len(mark)), (page, k, pre, shown), lambda: page.leave(True)]
            elif isinstance(k, Node):
                planned += [lambda: page.enter(None, 2), (page, k, pre, shown), page.leave]
            elif k.strip():
                planned.append((page, k, pre, shown))
        todo.extend(reversed(planned))
    elif name in ("dd", "blockquote"):
        page.enter(None, 2)
        todo.append(page.leave)
        kids(page, node.kids, pre, shown)
    else:
        inside = node.kids
        if name in ("pre", "listing", "textarea") and inside and isinstance(inside[0], str) and inside[0].startswith("\n"):
            inside = [inside[0][1:], *inside[1:]]
        if name == "details" and "open" not in attrs:
            inside = [k for k in inside if isinstance(k, Node) and k.name == "summary"][:1]
        if name == "q" and shown:
            page.text('"')
            todo.append(lambda: page.text('"'))
        kids(page, inside, pre or name in ("pre", "listing", "plaintext", "textarea"), shown)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, columns in keep, text) for every row.

    Null ids and repeated rows stay; a null page has an empty text; an empty
    table stays empty. A column named text in keep is replaced. Very long and
    deeply nested pages are rendered whole; only lists within lists and
    tables within tables cost more than their length, by their indents.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("__html"))
    return map_texts(rows, lambda texts: {"text": [render(t) for t in texts]}, [T.StructField("text", T.StringType())], "__html", piece=200)


def op2_html(spark, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    from inkfold.llm.common import documents

    return extract_pages(documents(spark, sf_dir, "pages"), keep=("url",)).withColumn("n_lines", F.size(F.split("text", "\n")))
