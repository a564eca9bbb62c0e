"""Layout-aware text of web pages.

A page is cut into tags and text, built into a tree (with the tags that HTML lets authors leave out) and rendered: text of
hidden elements is dropped (what says it is visible within an element of hidden visibility stays), blocks begin on new
lines and paragraphs are set apart by a blank one, as are lines by two breaks, list items carry their mark or number and
indent, table cells are padded to columns, over as many rows and columns as they span, and preformatted text keeps its
blanks. Everything else that is visible is emitted in order: formulas, the text of drawings and text areas, the chosen
option of a menu and all of a list box; values of other inputs are no text. One map over the pages, nothing is shuffled; memory follows the largest page.

Null, empty and text-free pages give an empty text; broken markup is read as browsers do (an unclosed comment, tag or
script runs to the end of the page); elements nested deeper than ``DEEPEST`` become siblings and keep their text, and
those of them that are hidden, or of hidden visibility, are left out with all they hold.
Repeated rows each get their row; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from placebeat.llm.support import narrow, ship, table

DEEPEST = 150
#: Groups of elements as the HTML standard names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("script style head title template noscript noembed noframes iframe object audio video canvas datalist meter progress map area param rp annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure hr fieldset xmp listing form".split())
BLOCKS = SPACED | frozenset("html body div section article aside main nav header footer address center details summary dialog li dt dd figcaption caption legend thead tbody tfoot tr td th optgroup option hgroup search".split())
ENDS_P = SPACED | frozenset("div section article aside main nav header footer address center details summary dialog figcaption hgroup search li dt dd".split())
#: What an opening tag closes, up to the elements that hold such tags.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "td": ({"td", "th"}, {"table", "tr", "template"}),
    "th": ({"td", "th"}, {"table", "tr", "template"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Parts of a drawing that aren't drawn where they stand.
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
BARRIERS = frozenset("td th caption table template button object html".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"""=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in (*RAW, "title", "textarea")}
BLANKS = re.compile(r"[ \t\n\r\f]+")
NUMBER = re.compile(r"[ \t\n\r\f]*(-?[0-9]{1,9})")
VISIBILITY = re.compile(r"(?:^|;)visibility:(hidden|collapse|visible)")


class Node:
    __slots__ = ("attributes", "children", "hidden", "name", "shown")

    def __init__(self, name: str, found: dict[str, str] | None = None) -> None:
        self.name, self.attributes, self.children = name, found or {}, []
        style = BLANKS.sub("", self.attributes.get("style", "")).lower()
        self.hidden = name in HIDDEN or "hidden" in self.attributes or "display:none" in style or name == "dialog" and "open" not in self.attributes
        said = VISIBILITY.findall(style)
        self.shown = said[-1] == "visible" if said else None  # None: as the element around

    def number(self, name: str, otherwise: int) -> int:
        found = NUMBER.match(self.attributes.get(name, ""))
        return int(found[1]) if found else otherwise


def tag_end(page: str, at: int) -> int:
    """Position behind the > that ends the tag whose attributes begin at ``at``; 0 if there is none."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return 0
        quote = QUOTE.search(page, at, close)
        if not quote:
            return close + 1
        at = page.find(quote[1], quote.end()) + 1
        if not at:
            return 0


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    open_: list[Node] = [root]
    beyond: Counter[str] = Counter()  # open elements that the full tree doesn't hold
    left_out: list[str] = []  # open elements from a hidden one on, where the tree is full
    at, n = 0, len(page)

    def close(names, barriers) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].name in names:
                del open_[k:]
                beyond.clear()
                return
            if open_[k].name in barriers:
                return

    def close_all(names, barriers) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].name in barriers:
                return
            if open_[k].name in names:
                del open_[k:]
                beyond.clear()

    def add_text(text: str) -> None:
        if text and not left_out:
            if open_[-1].name == "head" and text.strip(" \t\n\r\f"):
                open_.pop()
            open_[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            add_text(page[at:])
            break
        add_text(page[at:mark])
        follows = page[mark + 1 : mark + 2]
        if follows in ("!", "?"):
            ends, skip = (page.find("-->", mark + 2), 3) if page.startswith("<!--", mark) else (page.find(">", mark), 1)
            if ends < 0:
                break
            at = ends + skip
            continue
        closing = follows == "/"
        named = NAME.match(page, mark + 1 + closing)
        if not named:
            if closing:  # a bogus comment
                ends = page.find(">", mark)
                if ends < 0:
                    break
                at = ends + 1
            else:
                add_text("<")
                at = mark + 1
            continue
        behind = tag_end(page, named.end())
        if not behind:
            break
        name, at = named[0].lower(), behind
        if left_out:
            if closing and name in left_out:
                while left_out.pop() != name:
                    pass
                continue
            if closing:
                if not beyond[name] and not any(x.name == name for x in open_):
                    continue
                left_out.clear()
            elif len(left_out) == 1 and (left_out[0] == "p" and name in ENDS_P or left_out[0] in CLOSES.get(name, ((), ()))[0]):
                left_out.clear()
        if closing and beyond[name]:
            beyond[name] -= 1
            open_[-1].children.append(Node(name))  # ends its line
            continue
        if closing:
            if name == "br":
                open_[-1].children.append(Node("br"))
            elif name == "p" and not any(x.name == "p" for x in open_):
                open_[-1].children.append(Node("p"))
            elif name not in ("html", "body"):
                close({name}, BARRIERS - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot") else {"template"} | ({"table"} - {name}))
            continue
        text = page[named.end() : behind - 1]
        found = attributes(text) if text and text != "/" else {}
        if name in ("html",):
            continue
        if left_out:
            if name in RAW_ENDS:
                ended = RAW_ENDS[name].search(page, at)
                if not ended:
                    break
                at = tag_end(page, ended.end()) or n
            elif name not in VOID and not text.endswith("/"):
                left_out.append(name)
            continue
        if name in ENDS_P:
            close({"p"}, BARRIERS)
        if len(name) == 2 and name[0] == "h" and name[1] in "123456" and open_[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            open_.pop()
        if rule := CLOSES.get(name):
            close_all(*rule)
        if open_[-1].name == "head" and name not in ("base", "link", "meta", "title", "style", "script", "template", "noscript"):
            open_.pop()
        node = Node(name, found)
        open_[-1].children.append(node)
        if name in RAW or name in ("title", "textarea"):
            ended = RAW_ENDS[name].search(page, at)
            ends = ended.start() if ended else -1
            inner = page[at:] if ends < 0 else page[at:ends]
            if name == "textarea":
                inner = re.sub(r"^\r?\n", "", inner)
            node.children.append(inner if name in RAW else html.unescape(inner))
            if ends < 0:
                break
            at = tag_end(page, ends + 2 + len(name)) or n
        elif name not in VOID and not (text.endswith("/") and any(x.name in ("svg", "math") for x in open_)):
            if len(open_) < DEEPEST:
                open_.append(node)
            elif node.hidden or node.shown is False:
                left_out.append(name)
            else:
                beyond[name] = 1 if name in CLOSES or name == "p" else beyond[name] + 1
    return root


def width(text: str) -> int:
    """Columns of a terminal that a text takes."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(x) else 2 if unicodedata.east_asian_width(x) in "WF" else 1 for x in text)


class Page:
    """Lines of rendered blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.blank = False  # a collapsed blank waits for the next word
        self.gap = False  # a blank line waits for the next line
        self.indents: list[str] = []
        self.mark = ""

    def words(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text[:1] == " ":
            self.blank = True
        body = text.strip(" ")
        if body:
            self.line += (" " if self.blank and self.line else "") + body
            self.blank = text[-1:] == " "

    def end_line(self) -> None:
        if self.line:
            if self.gap and self.lines:
                self.lines.append("")
            first = "".join(self.indents) + self.mark
            self.lines.append(first + self.line)
            if self.mark:
                self.indents.append(" " * width(self.mark))
                self.mark = ""
            self.line, self.gap = "", False
        self.blank = False

    def whole(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        for k, text in enumerate(lines):
            if text.strip() or k and k < len(lines) - 1:
                self.line = text or " "
                self.end_line()


def items_depth(page: Page) -> int:
    return len(page.indents)


def options(menu: Node) -> Iterator[Node]:
    for child in menu.children:
        if not isinstance(child, str) and not child.hidden:
            if child.name == "option":
                yield child
            else:
                yield from options(child)


def drawn(drawing: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
    """Texts of a drawing, and whether they are visible."""
    for child in drawing.children:
        if not isinstance(child, str) and not child.hidden and child.name not in UNDRAWN:
            visible = shown if child.shown is None else child.shown
            if child.name in ("text", "foreignobject"):
                yield child, visible
            else:
                yield from drawn(child, visible)


def render_apart(child: Node, page: Page, shown: bool) -> bool:
    """Renders an element that is a box of its own in a line; False for other elements."""
    if child.name == "select":
        if "multiple" in child.attributes or child.number("size", 1) > 1:
            return False
        every = list(options(child))
        parts = [x for x in every if "selected" in x.attributes][-1:] or [x for x in every if "disabled" not in x.attributes][:1]
        inner = [(x, shown if x.shown is None else x.shown) for x in parts]
    elif child.name == "svg":
        inner = list(drawn(child, shown))
    elif child.name == "textarea":
        inner = [(child, shown)]
    else:
        return False
    for part, visible in inner:
        if page.line and not page.line.endswith(" "):
            page.blank = True
        if child.name == "textarea" and visible and "".join(part.children):
            page.line += " " if page.blank and page.line else ""
            page.blank = False
            render(part, page, True, visible)
        else:
            render(part, page, False, visible)
        page.blank = True
    return True


def render(node: Node, page: Page, preformatted: bool = False, shown: bool = True) -> None:
    backwards = node.name == "ol" and "reversed" in node.attributes
    number = node.number("start", sum(not isinstance(x, str) and x.name == "li" and not x.hidden for x in node.children) if backwards else 1)
    for child in node.children:
        if isinstance(child, str):
            if not shown:
                continue
            if preformatted:
                first, *others = child.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
                page.line += first
                for text in others:
                    page.line = page.line or " "
                    page.end_line()
                    page.line = text
            elif node.name not in ("table", "thead", "tbody", "tfoot", "tr") or child.strip(" \t\n\r\f"):
                page.words(child)
            continue
        name = child.name
        if child.hidden:
            continue
        visible = shown if child.shown is None else child.shown
        if name == "br":
            if page.line:
                page.end_line()
            elif visible:
                page.gap = True
            continue
        if name == "hr":
            page.end_line()
            page.gap = True
            continue
        if name == "table":
            page.end_line()
            page.gap = True
            page.whole(table_lines(child, visible))
            page.gap = True
            continue
        if render_apart(child, page, visible):
            continue
        if name not in BLOCKS:
            render(child, page, preformatted, visible)
            continue
        page.end_line()
        depth = items_depth(page)
        nested = name in ("ul", "ol", "menu", "dir") and depth
        page.gap = page.gap or name in SPACED and not nested and not page.mark
        if name == "li":
            ordered = node.name == "ol"
            number = child.number("value", number) if ordered else number
            page.mark = "" if not visible else f"{number}. " if ordered else "- "
            number += ordered * (-1 if backwards else 1)
        elif name in ("dd", "blockquote"):
            page.indents.append("    ")
        render(child, page, preformatted or name in ("pre", "xmp", "listing"), visible)
        page.end_line()
        del page.indents[depth:]
        if name == "li":
            page.mark = ""
        page.gap = page.gap or name in SPACED and not nested


Cell = tuple[int, int, list[str]]


def placed(groups: list[list[list[tuple[int, int, list[str]]]]]) -> list[list[Cell]]:
    """Rows of (first column, column behind the last, lines) from groups of rows of (rows, columns, lines).

    A cell takes the next columns that no cell from above reaches; none reaches beyond its group of rows.
    """
    out = []
    for rows in groups:
        above: list[list[int]] = []  # first column, column behind, rows still to come; ascending
        for k, row in enumerate(rows):
            cells, now, at, j = [], [], 0, 0
            for down, across, lines in row:
                while j < len(above) and above[j][0] <= at:
                    at = max(at, above[j][1])
                    j += 1
                behind = min(at + across, above[j][0]) if j < len(above) else at + across
                cells.append((at, behind, lines))
                now.append([at, behind, (down or len(rows) - k) - 1])
                at = behind
            out.append(cells)
            above = sorted(x for x in [*([a, b, n - 1] for a, b, n in above), *now] if x[2] > 0)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a grid; only columns in which a cell begins count."""
    begins = sorted({a for row in rows for a, _, _ in row})
    if len(begins) == 1:  # a table for layout
        return [text for row in rows for _, _, lines in row for text in lines]
    of = {a: k for k, a in enumerate(begins)}
    sizes = [0] * len(begins)
    wide = []
    for row in rows:
        for a, b, lines in row:
            first, behind, size = of[a], bisect_left(begins, b), max(map(width, lines), default=0)
            if behind - first == 1:
                sizes[first] = max(sizes[first], size)
            elif size:
                wide.append((behind - first, first, size))
    for n, first, size in sorted(wide):
        lacking = size - sum(sizes[first : first + n]) - 2 * (n - 1)
        for k in range(n if lacking > 0 else 0):
            sizes[first + k] += lacking * (k + 1) // n - lacking * k // n
    starts = [2 * k + x for k, x in enumerate(accumulate([0, *sizes]))]
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line, at = "", 0
            for a, _, lines in row:
                if k < len(lines) and lines[k].strip():
                    line += " " * (starts[of[a]] - at) + lines[k]
                    at = max(at, starts[of[a]]) + width(lines[k])
            out.append(line.rstrip())
    return out


def table_lines(table_: Node, shown: bool = True) -> list[str]:
    """Rows of a table with its cells padded to columns; what is in no cell comes first."""
    outside = Page()
    loose = Node("div")
    groups: list[list[list[tuple[int, int, list[str]]]]] = [[]]
    stack = [(table_, iter(table_.children), shown)]
    while stack:
        parent, children, seen = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if parent.name in ("thead", "tbody", "tfoot"):
                groups.append([])
            continue
        if isinstance(child, str):
            if seen:
                loose.children.append(child)
            continue
        if child.hidden or child.name in ("col", "colgroup"):
            continue
        visible = seen if child.shown is None else child.shown
        if child.name in ("thead", "tbody", "tfoot"):
            groups.append([])
            stack.append((child, iter(child.children), visible))
        elif child.name == "tr":
            groups[-1].append([])
            stack.append((child, iter(child.children), visible))
        elif child.name in ("td", "th"):
            if not groups[-1]:
                groups[-1].append([])
            cell = Page()
            render(child, cell, shown=visible)
            cell.end_line()
            across = min(max(child.number("colspan", 1), 1), 1000)
            groups[-1][-1].append((max(child.number("rowspan", 1), 0), across, cell.lines))
        else:
            child.shown = visible
            loose.children.append(child)
    render(loose, outside)
    outside.end_line()
    return outside.lines + aligned(placed(groups))


def page_text(source: str | None) -> str:
    """The visible text of a page."""
    if not source:
        return ""
    page = Page()
    render(build(source), page)
    page.end_line()
    return "\n".join(x.rstrip() for x in page.lines).strip("\n")


def html_extraction(frame: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """id, text and n_lines of every page."""
    ship(frame.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column(1)]
            lines = [x.count("\n") + 1 if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["id", "text", "n_lines"])

    pages = narrow(frame, id=id_column, html=html_column)
    return pages.mapInArrow(extract, f"id {pages.schema['id'].dataType.simpleString()}, text string, n_lines long").withColumnRenamed("id", id_column)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))
