"""Semantic tokens of a document: what an editor colours, as (line, start, length, type, modifiers), in UTF-16 units."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

from quillspark.functions.blocks import Parsed
from quillspark.functions.inline import Node
from quillspark.functions.render import utf8

# Token types and modifiers; their places in the lists are the numbers that are sent.
TYPES = (
    "comment", "string", "keyword", "operator", "number", "heading", "link", "footnote", "math", "containerType", "admonitionType", "emojiShortcode",
    "frontmatterKey", "frontmatterValue", "strikethrough", "emphasis", "taskMarker", "definitionTerm", "tableHeader", "tableSeparator", "imageAlt", "imageUrl",
    "directive", "directiveArgument",
)
MODIFIERS = (
    "level1", "level2", "level3", "level4", "level5", "level6", "inline", "reference", "autolink", "resolved", "broken", "definition", "display", "italic", "bold",
    "bolditalic", "checked", "unchecked", "toc", "embed",
)
# Node type to token type and modifiers, of nodes that are one token.
WHOLE = {
    "TableOfContents": ("directive", ("toc",)),
    "CodeSpan": ("string", ("inline",)),
    "CodeBlock": ("string", ("display",)),
    "FootnoteRef": ("footnote", ("reference",)),
    "Image": ("imageAlt", ()),
    "MathInline": ("math", ("inline",)),
    "MathBlock": ("math", ("display",)),
    "Emoji": ("emojiShortcode", ()),
    "Strikethrough": ("strikethrough", ()),
    "Emphasis": ("emphasis", ("italic",)),
    "Strong": ("emphasis", ("bold",)),
    "DefinitionTerm": ("definitionTerm", ()),
}
_HEADING = re.compile(r"[ \t]*#*[ \t]*(.*?)[ \t#]*$")
_CONTAINER = re.compile(r"[ \t]*:{3,}[ \t]*([A-Za-z][A-Za-z0-9_-]*)")
_ADMONITION = re.compile(r"\[!([A-Za-z][A-Za-z0-9_-]*)\]")
_TASK = re.compile(r"\[[ xX]\]")
_FRONT = re.compile(r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:", re.MULTILINE)
_FRONT_VALUE = re.compile(r"^[ \t]*[A-Za-z_][A-Za-z0-9_-]*\s*:\s*([^\n#]+)", re.MULTILINE)
_QUOTE = re.compile(r"^([ \t]*>+[ \t]*)", re.MULTILINE)
_MARKER = re.compile(r"([ \t]*(?:[-+*]|\d+[.)]|[A-Za-z][.)]|[ivxlcdmIVXLCDM]+[.)])[ \t]+)")
_SEPARATOR = re.compile(r"^([ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*)$", re.MULTILINE)

Add = Callable[[int, int, str, tuple[str, ...]], None]


def _link(n: Node) -> tuple[str, ...]:
    """How a link is written and whether it leads anywhere."""
    named, leads = bool(n.attrs.get("ref")), bool(n.attrs.get("href"))
    return ("reference" if named else "inline", *(("resolved",) if leads else ("broken",) if named else ()))


def _marks(n: Node, source: str, add: Add) -> bool:
    """Adds what n itself is coloured with; whether its children are looked at too."""
    a, b = n.start, n.end
    text = source[a:b]
    first = text.split("\n", 1)[0]

    def found(m: re.Match | None, kind: str, *modifiers: str) -> None:
        if m:
            add(a + m.start(1), a + m.end(1), kind, modifiers)

    if n.type in WHOLE:
        kind, modifiers = WHOLE[n.type]
        add(a, b, kind, modifiers)
    elif n.type == "Heading":
        found(_HEADING.match(first), "heading", f"level{n.attrs['level']}")
    elif n.type == "Link":
        add(a, b, "link", _link(n))
    elif n.type == "AutoEmbed":
        head = text.lower().find("[[embed:")
        if head >= 0:
            close = text.rfind("]]")
            add(a + head, a + head + 8, "directive", ("embed",))
            add(a + head + 8, a + close if close >= 0 else b, "directiveArgument", ("embed",))
    elif n.type == "Frontmatter":
        for pattern, kind in ((_FRONT, "frontmatterKey"), (_FRONT_VALUE, "frontmatterValue")):
            for m in pattern.finditer(text):
                found(m, kind)
    elif n.type == "Table":
        for i, row in enumerate(n.children):
            for c in row.children:
                add(c.start, c.end, "string" if i else "tableHeader", ())
        found(_SEPARATOR.search(text), "tableSeparator")
    else:
        if n.type == "ContainerDirective":
            found(_CONTAINER.match(first), "containerType")
        elif n.type == "Admonition":
            found(_ADMONITION.search(text), "admonitionType")
        elif n.type == "Blockquote":
            for m in _QUOTE.finditer(text):
                found(m, "comment")
        elif n.type == "ListItem":
            found(_MARKER.match(first), "operator")
        elif n.type == "TaskListItem":
            # an open task is looked for before a done one
            at = next((k for mark in ("[ ]", "[x]", "[X]") if (k := first.find(mark)) >= 0), -1)
            if at >= 0:
                add(a + at, a + at + 3, "taskMarker", ("unchecked" if first[at + 1] == " " else "checked",))
        elif n.type == "FootnoteDef":
            add(a, min(a + len(n.attrs["id"]) + 3, b), "footnote", ("definition",))
        return True
    return False


def tokens(p: Parsed, first: int = 0, last: int | None = None) -> list[tuple[int, int, int, str, int]]:
    """(line, start, length, type, modifier bits) of bytes first..last, in order and without overlaps: of two that do the
    one that starts first holds, of those that start together the shorter. Nothing goes over a line end."""
    source = p.source
    last = len(source) if last is None else min(last, len(source))
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    out: list[tuple[int, int, str, int]] = []

    def add(a: int, b: int, kind: str, modifiers: tuple[str, ...]) -> None:
        a, b = max(a, first), min(b, last)
        bits = sum(1 << MODIFIERS.index(m) for m in modifiers)
        while a < b:
            stop = source.find("\n", a)
            stop = len(source) if stop < 0 else stop
            if min(b, stop) > a:
                out.append((a, min(b, stop), kind, bits))
            a = stop + 1

    stack = [p.root]
    while stack:
        n = stack.pop()
        # a node without a place is no token, but its children may be
        if n.start < 0 or _marks(n, source, add):
            stack += reversed(n.children)
    found, reached = [], -1
    for a, b, kind, bits in sorted(out, key=lambda t: t[:2]):
        if a >= reached:
            line = bisect_right(starts, a) - 1
            before, own = utf8(source[starts[line] : a]), utf8(source[a:b])
            units = lambda s: len(s.encode("utf-16-le")) // 2
            if units(own):
                found.append((line, units(before), units(own), kind, bits))
            reached = max(reached, b)
    return found


def encoded(found: list[tuple[int, int, int, str, int]]) -> list[int]:
    """Five numbers a token: lines and characters since the one before, length, type, modifiers."""
    out, line, start = [], 0, 0
    for at, character, length, kind, bits in found:
        out += [at - line, character - start if at == line else character, length, TYPES.index(kind), bits]
        line, start = at, character
    return out
