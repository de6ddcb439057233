"""Tolerant HTML trees: unclosed and crossed tags are closed as browsers close them."""

from __future__ import annotations

import html
import re

# Tags that don't interrupt a text, tags without content or end.
INLINE = {"a", "b", "i", "em", "strong", "span", "font", "br"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noframes"}
UNSEEN_TAGS = {"script", "style", "noscript", "template", "head", "iframe", "object", "select", "svg", "textarea", "title", "button"}
# A start tag closes open ones of these kinds, up to the nearest of the walls.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = {
    "p", "div", "ul", "ol", "dl", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "section", "article", "main", "nav", "aside", "header", "footer",
    "form", "pre", "address", "figure", "fieldset", "center", "details",
}
PARTS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "dl", "dt", "dd", "ul", "ol", "li", "blockquote", "pre", "figure", "center"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; kids are elements and texts in order."""

    __slots__ = ("attr", "c", "d", "kids", "lc", "lt", "sum", "t", "tag", "up")

    def __init__(self, tag: str, attr: str, up: Node | None):
        self.tag, self.attr, self.up, self.kids = tag, attr, up, []
        self.c = self.t = self.lc = self.lt = 0
        self.d = self.sum = 0.0

    def attrs(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attr)} if self.attr.strip() else {}


def decode(body: bytes) -> str:
    """By the encoding that the page declares, UTF-8 where it declares none and is, else Windows-1252."""
    if body[:3] == b"\xef\xbb\xbf":
        return body[3:].decode("utf-8", "replace")
    m = _CHARSET.search(body[:4096])
    name = m[1].decode("ascii").lower() if m else ""
    if name in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "iso8859-1", "windows-1252"):
        name = "cp1252"
    try:
        return body.decode(name, "replace") if name else body.decode("utf-8")
    except (LookupError, UnicodeDecodeError):
        return body.decode("cp1252", "replace")


def parse(text: str) -> tuple[Node, str]:
    """(tree, text of the title tag). Open and crossed tags are closed as browsers close them."""
    root = Node("#root", "", None)
    now, title, at, n = root, "", 0, len(text)
    match = _TOKEN.match
    while at < n:
        m = match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                now.kids.append(piece)
            continue
        tag = tag.lower()
        if m[1]:
            x = now
            same = {"ul", "ol"} if tag in ("ul", "ol") else {tag}
            wall = {"td", "th", "table"} if tag not in ("table", "tr", "td", "th", "tbody", "body", "html") else {"table"} if tag in ("tr", "td", "th") else set()
            if re.fullmatch("h[1-6]", tag):
                same = {"h1", "h2", "h3", "h4", "h5", "h6"}
            while x is not root and x.tag not in same:
                if x.tag in wall:
                    x = root
                    break
                x = x.up
            if x is not root and tag not in ("body", "html"):
                now = x.up
            continue
        if tag in ENDS_P:
            x = now
            while x is not root and (x.tag in INLINE or x.tag == "p"):
                if x.tag == "p":
                    now = x.up
                    break
                x = x.up
        if tag in CLOSES:
            kinds, walls = CLOSES[tag]
            x, last = now, None
            while x is not root and x.tag not in walls:
                if x.tag in kinds:
                    last = x
                    if tag == "li":
                        break
                x = x.up
            if last is not None:
                now = last.up
        if tag in ("html", "body", "head"):
            continue_with = Node(tag, m[3], now)
            now.kids.append(continue_with)
            if tag == "body":
                # The head ends here even where its end tag is missing.
                while now is not root and now.tag != "html":
                    now = now.up
                continue_with.up = now
                if now.kids and now.kids[-1] is not continue_with:
                    now.kids.append(continue_with)
            now = continue_with
            continue
        node = Node(tag, m[3], now)
        now.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            if tag == "title" and not title:
                title = text[at : end.start() if end else n]
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            now = node
    return root, " ".join(html.unescape(title).split())


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN_TAGS:
        return True
    if not node.attr or not ("hid" in (low := node.attr.lower()) or "none" in low):
        return False
    a = node.attrs()
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))


def clean(pieces: list[str]) -> str:
    text = "".join(pieces)
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


def blocks(root: Node) -> list[tuple[str, Node]]:
    """(text, the element it is in) in order; iterative, as trees may be deep."""
    out: list[tuple[str, Node]] = []
    run: list[str] = []
    where = root

    def flush() -> None:
        if run and (text := clean(run)):
            out.append((text, where))
        run.clear()

    stack: list[tuple[object, Node]] = [(root, root)]
    while stack:
        x, holder = stack.pop()
        if isinstance(x, str):
            if not run:
                where = holder
            run.append(x)
        elif x is None:
            flush()
        elif x.tag == "br":
            run.append(" ")
        elif not hidden(x):
            if x.tag not in INLINE:
                flush()
                stack.append((None, holder))
            stack += [(k, x) for k in reversed(x.kids)]
        elif x.tag not in INLINE:
            flush()
    flush()
    return out
