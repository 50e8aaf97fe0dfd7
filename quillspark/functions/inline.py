"""Inline parsing: text of a block to inline nodes. Offsets are bytes: text is UTF-8 read as Latin-1."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Node:
    type: str
    children: list[Node] = field(default_factory=list)
    literal: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    start: int = -1
    end: int = -1

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def text(self) -> str:
        return "".join(n.literal for n in self.walk() if n.type in ("Text", "CodeSpan"))


def text_node(s: str, at: int) -> Node:
    return Node("Text", literal=s, start=at, end=at + len(s) if at >= 0 else -1)


_PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_TOKEN = re.compile(
    rf"(?P<esc>\\[{_PUNCTUATION}])|(?P<hard>\\\n| {{2,}}\n)|(?P<nl>\n)|(?P<code>`+)"
    r"|(?P<auto><(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^<>\x00-\x20]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>)"
    r"|(?P<html></?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->|<\?.*?\?>|<![A-Z][^>]*>)"
    r"|(?P<run>\*+|_+|~+)|(?P<img>!\[)|(?P<open>\[)|(?P<close>\])",
    re.DOTALL | re.ASCII,
)
_TARGET = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.ASCII)
_LABEL = re.compile(r"\[([^\[\]]*)\]")
_UNESCAPE = re.compile(rf"\\([{_PUNCTUATION}])")
_WORD = re.compile(r"[A-Za-z0-9\x80-\xff]")


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def normal_label(s: str) -> str:
    """Lower case, white space collapsed, with or without brackets."""
    s = s.encode("latin-1").decode("utf-8", "replace").lower().encode().decode("latin-1")
    return " ".join(s.strip("[]").split())


#: Bytes of a chunk, where texts are parsed in chunks.
CHUNK = 320


def _balanced(text: str) -> bool:
    own = re.sub(r"\\.", "", text, flags=re.DOTALL)
    return own.count("`") % 2 == 0 and own.count("[") == own.count("]") and own.count("(") == own.count(")")


def chunks(text: str, most: int = CHUNK) -> list[str]:
    """The text cut at blanks into pieces of at most `most` bytes that leave no code, bracket or parenthesis open: in the back
    half of each, after punctuation if there is such a blank. Uncut where a piece has no such place."""
    out, start = [], 0
    while len(text) - start > most:
        blanks = [i for i in range(start + most, start + most // 2, -1) if text[i - 1] == " " and _balanced(text[start:i])]
        cut = next((i for i in blanks if text[start:i].rstrip(" \t")[-1:] in (".", "!", "?", ";", ":", ",")), blanks[0] if blanks else None)
        if cut is None:
            return [text]
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]] if start < len(text) else out or [text]


def parse_in_chunks(text: str, at: int) -> list[Node]:
    """parse_inline of each chunk by itself: what opens in one chunk and closes in another stays text."""
    out: list[Node] = []
    for piece in chunks(text):
        out += parse_inline(piece, at)
        at += len(piece) if at >= 0 else 0
    return merged(out)


def parse_inline(text: str, at: int) -> list[Node]:
    """Inline nodes of `text`, which stands at byte `at` of the source (-1: nowhere)."""
    out: list[Node] = []
    runs: list[int] = []  # indexes in out of delimiter runs
    opens: list[tuple[int, bool, int]] = []  # index in out, image, end in text
    place = lambda i: at + i if at >= 0 else -1
    i = last = 0

    def flush(to: int) -> None:
        if to > last:
            out.append(text_node(text[last:to], place(last)))

    while m := _TOKEN.search(text, i):
        kind, a, b = m.lastgroup, m.start(), m.end()
        i = b
        if kind == "code":
            stop = re.compile(rf"(?<!`)`{{{b - a}}}(?!`)").search(text, b)
            if not stop:
                continue
            flush(a)
            out.append(Node("CodeSpan", literal=text[b : stop.start()], start=place(a), end=place(stop.end())))
            i = last = stop.end()
        elif kind == "close":
            flush(a)
            last = a
            i = last = _close(text, out, runs, opens, a, place)
        elif kind in ("img", "open"):
            flush(a)
            opens.append((len(out), kind == "img", b))
            out.append(text_node(m[0], place(a)))
            last = b
        elif kind == "run":
            flush(a)
            runs.append(len(out))
            node = text_node(m[0], place(a))
            before, after = text[a - 1 : a], text[b : b + 1]
            wide = lambda c: not c or c in " \t\n"
            punct = lambda c: bool(c) and not wide(c) and not _WORD.match(c)
            left = not wide(after) and (not punct(after) or wide(before) or punct(before))
            right = not wide(before) and (not punct(before) or wide(after) or punct(after))
            if m[0][0] == "_":
                left, right = left and (not right or punct(before)), right and (not left or punct(after))
            node.attrs = {"opens": "y" * left, "closes": "y" * right}
            node.type = "Run"
            out.append(node)
            last = b
        else:
            flush(a)
            last = b
            if kind == "esc":
                out.append(Node("Text", literal=m[0][1], start=place(a), end=place(b)))
            elif kind == "hard":
                out.append(Node("HardBreak", start=place(a), end=place(b)))
            elif kind == "nl":
                out.append(Node("SoftBreak", start=place(a), end=place(b)))
            elif kind == "auto":
                href = m[0][1:-1]
                out.append(Node("Link", [text_node(href, place(a + 1))], attrs={"href": href if ":" in href.split("@")[0] else f"mailto:{href}"}, start=place(a), end=place(b)))
            else:
                out.append(Node("HTMLInline", literal=m[0], start=place(a), end=place(b)))
    flush(len(text))
    return merged(emphasis(out))


def _close(text: str, out: list[Node], runs: list[int], opens: list[tuple[int, bool, int]], a: int, place) -> int:
    """A closing bracket at a: builds a link or image from the last open one, or leaves text. Returns where to go on."""
    if not opens:
        out.append(text_node("]", place(a)))
        return a + 1
    k, image, inner = opens.pop()
    label, end, attrs = text[inner:a], a + 1, None
    target = _TARGET.match(text, a + 1) if text[a + 1 : a + 2] == "(" else None
    if target:
        title = (target[3] or "")[1:-1]
        attrs = {"href": unescape(target[1] if target[1] is not None else target[2] or "")} | ({"title": unescape(title)} if title else {})
        end = target.end()
    elif (ref := _LABEL.match(text, a + 1)) and (ref[1] or label):
        attrs, end = {"ref": ref[1] or label}, ref.end()
    elif label and not image:
        attrs = {"ref": label, "raw": text[inner - 1 : a + 1]}
    if attrs is None or (not image and any(n.type == "Link" and not n.attrs.get("raw") for n in out[k + 1 :])):
        out.append(text_node("]", place(a)))
        return a + 1
    inside = emphasis(out[k + 1 :])
    start = place(inner - 1 - image)
    del out[k:]
    runs[:] = [r for r in runs if r < k]
    if image:
        node = Node("Image", attrs={"alt": Node("x", inside).text(), "src": attrs.get("href", "")} | ({"title": attrs["title"]} if "title" in attrs else {}) | ({"ref": attrs["ref"]} if "ref" in attrs else {}), start=start, end=place(end))
    else:
        node = Node("Link", merged(inside), attrs=attrs, start=start, end=place(end))
    out.append(node)
    return end


def emphasis(nodes: list[Node]) -> list[Node]:
    """Pairs delimiter runs; what stays unpaired is text."""
    out: list[Node] = []
    for n in nodes:
        if n.type != "Run":
            out.append(n)
            continue
        mark, left = n.literal[0], len(n.literal)
        while n.attrs.get("closes") and left:
            k = next((i for i in range(len(out) - 1, -1, -1) if out[i].type == "Run" and out[i].literal[0] == mark and out[i].attrs.get("opens") and (mark != "~" or len(out[i].literal) == left)), None)
            if k is None:
                break
            use = left if mark == "~" else 2 if min(left, len(out[k].literal)) >= 2 else 1
            if mark == "~" and use > 2:
                break
            kind = {("~", 1): "Subscript", ("~", 2): "Strikethrough"}.get((mark, use), "Strong" if use == 2 else "Emphasis")
            opener = out[k]
            inside = merged([_plain(x) for x in out[k + 1 :]])
            end = n.start + (len(n.literal) - left) + use if n.start >= 0 else -1
            start = opener.end - use if opener.start >= 0 else -1
            made = Node(kind, inside, start=start, end=end)
            if kind == "Subscript":
                made = Node(kind, literal=made.text(), start=start, end=end)
            del out[k + 1 :]
            opener.literal = opener.literal[:-use]
            opener.end = opener.end - use if opener.start >= 0 else -1
            if not opener.literal:
                out.pop()
            out.append(made)
            left -= use
        if left:
            rest = n.literal[-left:]
            out.append(Node("Run", literal=rest, attrs=n.attrs, start=n.end - left if n.start >= 0 else -1, end=n.end))
    return [_plain(n) for n in out]


def _plain(n: Node) -> Node:
    return text_node(n.literal, n.start) if n.type == "Run" else n


def merged(nodes: list[Node]) -> list[Node]:
    """Neighbouring texts become one."""
    out: list[Node] = []
    for n in nodes:
        if n.type == "Text" and out and out[-1].type == "Text":
            last = out[-1]
            out[-1] = Node("Text", literal=last.literal + n.literal, start=last.start, end=n.end if last.start >= 0 else -1)
        elif n.type != "Text" or n.literal:
            out.append(n)
    return out
