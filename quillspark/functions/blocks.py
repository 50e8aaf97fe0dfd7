"""Block parsing: source text to a tree of nodes. Text is UTF-8 read as Latin-1, so offsets are bytes.

Own design: lines carry the byte at which their text begins; containers of lines (quotes, items) strip
their marker and pass the rest down.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from quillspark.functions import frontmatter
from quillspark.functions.inline import Node, merged, normal_label, parse_in_chunks, parse_inline, text_node
from quillspark.functions.vocabulary import ADMONITIONS, DIAGRAMS, EMOJI, PROVIDERS


class Line(NamedTuple):
    at: int
    text: str  # without the line feed
    end: int  # after the line feed


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})(.*)$")
_BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}>[ ]?")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)]|[A-Za-z][.)])([ \t]+|$)")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|base|blockquote|body|center|details|dialog|div|dl|dt|dd|fieldset|figure|figcaption|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/>]|$))", re.IGNORECASE | re.ASCII)
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"""^ {0,3}\[([^\[\]\^][^\[\]]*)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+("[^"\n]*"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$""")
_FOOTNOTE = re.compile(r"^ {0,3}\[\^([A-Za-z0-9_-]+)\]:[ \t]?(.*)$")
_OPEN = re.compile(r"^(:{3,})([A-Za-z][A-Za-z0-9_-]*)(?=$|[ \t{\"])(.*)$")
_CLOSE = re.compile(r"^(:{3,})[ \t]*$")
_ATTRS = re.compile(r"\{([^{}]*)\}[ \t]*$")
_PAIR = re.compile(r"""#([\w-]+)|\.([\w-]+)|([\w-]+)=("[^"]*"|'[^']*'|\S+)""", re.ASCII)
_MARK = re.compile(r"^> ?\[!(?:NOTE|WARNING|TIP|IMPORTANT|CAUTION)\]")
_ADMONITION = re.compile(r"^\[!(NOTE|WARNING|TIP|IMPORTANT|CAUTION)\][ \t]*(.*)$")
_EMBED = re.compile(r"^\[\[embed:\s*(\S+?)\s*\]\]$")
_TOC = re.compile(r"^\[\[toc\]\]$", re.IGNORECASE)
_BRACKETS = re.compile(r"!?\[([^\]\n]+)\](?![:(\[])")
_PAIRED = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_DEEP = re.compile(r"^((?:  )*)[-*+] ")
_PATTERNS = (
    ("MathInline", "$", re.compile(r"\$([^$\n]+?)\$")),
    ("Superscript", "^", re.compile(r"\^([^^\s]+?)\^", re.ASCII)),
    ("Emoji", ":", re.compile(r":([a-z0-9_+-]+):")),
)


def lowered(src: str) -> str:
    """Line ends become LF, lazy lines after an admonition marker are quoted, the text ends in LF."""
    src = src.replace("\r\n", "\n").replace("\r", "\n")
    if "[!" in src:
        out, inside, fence = [], False, False
        for line in src.split("\n"):
            if line.lstrip().startswith(("```", "~~~")):
                fence = not fence
            if not fence and _MARK.match(line):
                inside = True
            elif not line.strip() or fence:
                inside = False
            elif inside and not line.startswith(">"):
                line = f"> {line}"
            out.append(line)
        src = "\n".join(out)
    return src if not src or src.endswith("\n") else src + "\n"


def lines_of(src: str, at: int = 0) -> list[Line]:
    out = []
    for text in src.split("\n")[:-1] if src.endswith("\n") else src.split("\n") if src else []:
        out.append(Line(at, text, at + len(text) + 1))
        at += len(text) + 1
    return out


class Parser:
    def __init__(self, source: str, emoji: dict[str, str] | None = None, chunked: bool = False) -> None:
        self.source = source
        self.inline = parse_in_chunks if chunked else parse_inline
        self.emoji = EMOJI if emoji is None else emoji
        self.links: dict[str, dict[str, str]] = {}
        #: Where the definition of each label stands that holds.
        self.defined: dict[str, tuple[int, int]] = {}
        self.diagnostics: list[tuple[str, str, str, int, int]] = []
        #: What the frontmatter says; None without one.
        self.front: dict | None = None

    def document(self) -> Node:
        lines = lines_of(self.source)
        root = Node("Document", start=0, end=len(self.source))
        if quoted := self._all_quoted(lines):
            root.children = [quoted]
            return root
        if _jumps(lines):
            raise ValueError("a list's level jumps")
        front, first = self._frontmatter(lines)
        root.children = front + self.containers(lines[first:])
        self.finish(root)
        return root

    def _frontmatter(self, lines: list[Line]) -> tuple[list[Node], int]:
        """The frontmatter's node, and the line after it; nothing where it isn't well formed."""
        if lines and lines[0].text == "---":
            for i, line in enumerate(lines[1:], 1):
                if line.text == "---":
                    literal = "\n".join(x.text for x in lines[1:i])
                    try:
                        self.front = frontmatter.load(literal.encode("latin-1").decode("utf-8", "replace")) or {}
                    except frontmatter.Malformed:
                        break
                    return [Node("Frontmatter", literal=literal, start=0, end=line.end)], i + 1
        return [], 0

    def _all_quoted(self, lines: list[Line]) -> Node | None:
        """A document that is one quote: what it quotes is a document of its own, whose nodes have no places here.
        Quotes that open with a bracket are left to the ordinary way."""
        inner = []
        for line in lines:
            own = line.text.lstrip(" \t")
            if own and not own.startswith(">"):
                return None
            inner.append(own[2:] if own[1:2] in (" ", "\t") else own[1:])
            if inner[-1].lstrip().startswith("["):
                return None
        if not any(x.text.strip() for x in lines):
            return None
        within = Parser(lowered("\n".join(inner) + "\n"), self.emoji, self.inline is parse_in_chunks)
        quote = Node("Blockquote", within.document().children, start=0, end=len(self.source))
        self.diagnostics += within.diagnostics
        for n in quote.walk():
            if n is not quote:
                n.start = n.end = -1
        return quote

    # ------------------------------------------------------------ containers

    def containers(self, lines: list[Line]) -> list[Node]:
        out: list[Node] = []
        plain: list[Line] = []
        i, fence = 0, ""
        while i < len(lines):
            text = lines[i].text
            if m := _FENCE.match(text):
                fence = "" if fence and m[2].startswith(fence) else fence or m[2]
            m = _OPEN.match(text) if not fence else None
            if not m:
                plain.append(lines[i])
                i += 1
                continue
            out += self.blocks(plain)
            plain = []
            depth, j, inner = 1, i + 1, ""
            while j < len(lines):
                t = lines[j].text
                if f := _FENCE.match(t):
                    inner = "" if inner and f[2].startswith(inner) else inner or f[2]
                elif not inner:
                    if (o := _OPEN.match(t)) and len(o[1]) == len(m[1]):
                        depth += 1
                    elif (c := _CLOSE.match(t)) and len(c[1]) == len(m[1]):
                        depth -= 1
                        if not depth:
                            break
                j += 1
            end = lines[j].end if j < len(lines) else lines[-1].end
            if j >= len(lines):
                self.diagnostics.append(("MDPP-PARSE-002", "warning", "unclosed container", lines[i].at, lines[i].end))
            out.append(Node("ContainerDirective", self.containers(lines[i + 1 : j]), attrs=container_info(m[2], m[3]), start=lines[i].at, end=end))
            i = j + 1
        return out + self.blocks(plain)

    # ------------------------------------------------------------ blocks

    def blocks(self, lines: list[Line]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            text = lines[i].text
            if not text.strip():
                i += 1
                continue
            i = next(j for f in (self._code, self._indented, self._heading, self._break, self._quote, self._list, self._html, self._footnote, self._definition, self._table, self._paragraph) if (j := f(lines, i, out)))
        return out

    def _code(self, lines: list[Line], i: int, out: list[Node]) -> int:
        m = _FENCE.match(lines[i].text)
        if not m or (m[2][0] == "`" and "`" in m[3]):
            return 0
        j = i + 1
        while j < len(lines) and not ((c := _FENCE.match(lines[j].text)) and c[2][0] == m[2][0] and len(c[2]) >= len(m[2]) and not c[3].strip()):
            j += 1
        indent = len(m[1])
        body = "".join(x.text[min(indent, len(x.text) - len(x.text.lstrip(" "))) :] + "\n" for x in lines[i + 1 : j])
        info = m[3].strip().split()
        last = lines[min(j, len(lines) - 1)]
        node = Node("CodeBlock", literal=body, attrs={"language": info[0]} if info else {}, start=lines[i].at, end=last.end)
        out.append(diagram(node))
        return j + 1

    def _indented(self, lines: list[Line], i: int, out: list[Node]) -> int:
        if not lines[i].text.startswith(("    ", "\t")):
            return 0
        j = i
        while j < len(lines) and (lines[j].text.startswith(("    ", "\t")) or not lines[j].text.strip()):
            j += 1
        body = "\n".join(re.sub(r"^(?: {4}|\t)", "", x.text) for x in lines[i:j]).rstrip("\n ")
        while not lines[j - 1].text.strip():
            j -= 1
        out.append(Node("CodeBlock", literal=body + "\n", start=lines[i].at, end=lines[j - 1].end))
        return j

    def _heading(self, lines: list[Line], i: int, out: list[Node]) -> int:
        line = lines[i]
        m = _ATX.match(line.text)
        if not m:
            return 0
        text = m[2] or ""
        out.append(Node("Heading", parse_inline(text, line.at + m.start(2) if text else -1), attrs={"level": str(len(m[1]))}, start=line.at, end=line.end))
        return i + 1

    def _break(self, lines: list[Line], i: int, out: list[Node]) -> int:
        if not _BREAK.match(lines[i].text):
            return 0
        out.append(Node("ThematicBreak", start=lines[i].at, end=lines[i].end))
        return i + 1

    def _quote(self, lines: list[Line], i: int, out: list[Node]) -> int:
        if not _QUOTE.match(lines[i].text):
            return 0
        inner, j = [], i
        while j < len(lines):
            if m := _QUOTE.match(lines[j].text):
                inner.append(Line(lines[j].at + m.end(), lines[j].text[m.end() :], lines[j].end))
            elif lines[j].text.strip() and inner[-1].text.strip() and not self._starts(lines[j].text):
                inner.append(lines[j])
            else:
                break
            j += 1
        out.append(self._quoted(inner, lines[i].at, lines[j - 1].end))
        return j

    def _quoted(self, inner: list[Line], start: int, end: int) -> Node:
        if inner and (m := _ADMONITION.match(inner[0].text)):
            attrs = {"type": m[1].lower()} | ({"title": m[2].strip()} if m[2].strip() else {})
            node = Node("Admonition", self.blocks(inner[1:]), attrs=attrs, start=start, end=end)
            for p in node.children:
                if p.type == "Paragraph":
                    p.children = [c if c.type != "Text" else text_node(c.literal.strip(), -1) for c in p.children]
            return node
        return Node("Blockquote", self.blocks(inner), start=start, end=end)

    def _starts(self, text: str) -> bool:
        """Whether the line begins a block that ends a paragraph."""
        return bool(_ATX.match(text) or _BREAK.match(text) or _QUOTE.match(text) or _FENCE.match(text) or _HTML.match(text) or ((m := _ITEM.match(text)) and m[3] and (m[2] in "-*+" or m[2][:-1] == "1")))

    def _list(self, lines: list[Line], i: int, out: list[Node]) -> int:
        m = _ITEM.match(lines[i].text)
        if not m:
            return 0
        bullet = m[2] in "-*+"
        node = Node("List", attrs={} if bullet else {"ordered": "true"}, start=lines[i].at)
        if not bullet and m[2][:-1].isdigit() and int(m[2][:-1]) not in (0, 1):
            node.attrs["start"] = str(int(m[2][:-1]))
        same = lambda x: (x[2] in "-*+" and x[2] == m[2]) if bullet else (x[2] not in "-*+" and x[2][-1] == m[2][-1])
        j = i
        while j < len(lines) and (x := _ITEM.match(lines[j].text)) and same(x) and not _BREAK.match(lines[j].text):
            width = x.end() if x[3] and len(x[3]) <= 4 else len(x[1]) + len(x[2]) + 1
            inner = [Line(lines[j].at + min(width, len(lines[j].text)), lines[j].text[width:], lines[j].end)]
            k = j + 1
            while k < len(lines):
                text = lines[k].text
                indent = len(text) - len(text.lstrip(" "))
                if not text.strip():
                    inner.append(Line(lines[k].at, "", lines[k].end))
                elif indent >= width or (indent >= 2 and indent > len(x[1])):
                    cut = min(indent, width)
                    inner.append(Line(lines[k].at + cut, text[cut:], lines[k].end))
                elif inner[-1].text.strip() and not self._starts(text) and not _ITEM.match(text):
                    inner.append(lines[k])
                else:
                    break
                k += 1
            while len(inner) > 1 and not inner[-1].text.strip():
                inner.pop()
            item = Node("ListItem", start=lines[j].at, end=inner[-1].end)
            if t := _TASK.match(inner[0].text):
                item.type, item.attrs = "TaskListItem", {"checked": "true" if t[1] in "xX" else "false"}
                inner[0] = Line(inner[0].at + t.end(), inner[0].text[t.end() :], inner[0].end)
            item.children = self.blocks(inner)
            # the line feed before a nested list belongs to the paragraph
            for a, b in zip(item.children, item.children[1:], strict=False):
                if a.type == "Paragraph" and b.type == "List" and a.end == b.start - (len(self.source[a.end : b.start])):
                    a.children.append(Node("SoftBreak"))
            node.children.append(item)
            node.end = item.end
            j = k
        out.append(node)
        return j

    def _html(self, lines: list[Line], i: int, out: list[Node]) -> int:
        if not _HTML.match(lines[i].text):
            return 0
        j = i + 1
        if lines[i].text.lstrip().startswith("<!--"):
            j = i
            while j < len(lines) and "-->" not in lines[j].text:
                j += 1
            j = min(j + 1, len(lines))
        else:
            while j < len(lines) and lines[j].text.strip():
                j += 1
        out.append(Node("HTMLBlock", literal="".join(x.text + "\n" for x in lines[i:j]), start=lines[i].at, end=lines[j - 1].end))
        return j

    def _footnote(self, lines: list[Line], i: int, out: list[Node]) -> int:
        m = _FOOTNOTE.match(lines[i].text)
        if not m:
            return 0
        j = i + 1
        text = m[2]
        while j < len(lines) and lines[j].text.strip() and not _FOOTNOTE.match(lines[j].text) and not self._starts(lines[j].text):
            text += "\n" + lines[j].text.strip()
            j += 1
        out.append(Node("FootnoteDef", parse_inline(text, -1), attrs={"id": m[1]}, start=lines[i].at, end=lines[j - 1].end))
        return j

    def _definition(self, lines: list[Line], i: int, out: list[Node]) -> int:
        m = _DEFINITION.match(lines[i].text)
        if not m:
            return 0
        j = i
        while j < len(lines) and (m := _DEFINITION.match(lines[j].text)):
            self.defined[normal_label(m[1])] = (lines[j].at, lines[j].end)
            self.links[normal_label(m[1])] = {"href": m[2] if m[2] is not None else m[3]} | ({"title": m[4][1:-1]} if m[4] and m[4][1:-1] else {})
            j += 1
        text = self.source[lines[i].at : lines[j - 1].end].rstrip("\n")
        nodes = parse_inline(text, lines[i].at)
        # a definition is read as text again: it joins the paragraph before it unless two line feeds stand between
        if out and out[-1].type == "Paragraph" and "\n\n" not in self.source[out[-1].end : lines[i].at]:
            out[-1].children += nodes
        else:
            out.append(Node("Paragraph", nodes, start=lines[i].at, end=lines[j - 1].end))
        return j

    def _table(self, lines: list[Line], i: int, out: list[Node]) -> int:
        if "|" not in lines[i].text or i + 1 >= len(lines) or "-" not in lines[i + 1].text or not _DELIMITER.match(lines[i + 1].text) or ("|" not in lines[i + 1].text and ":" not in lines[i + 1].text):
            return 0
        marks = [c.strip() for _, c in cells(lines[i + 1].text)]
        if len(cells(lines[i].text)) != len(marks):
            return 0
        align = [("center" if c.endswith(":") else "left") if c.startswith(":") else "right" if c.endswith(":") else "" for c in marks]
        j = i + 2
        while j < len(lines) and "|" in lines[j].text and lines[j].text.strip():
            j += 1
        node = Node("Table", attrs={"align": ",".join(align)} if any(align) else {}, start=lines[i].at, end=lines[j - 1].end)
        for line in [lines[i], *lines[i + 2 : j]]:
            row = Node("TableRow", start=line.at, end=line.end)
            for at, c in cells(line.text)[: len(marks)]:
                lead = len(c) - len(c.lstrip(" \t"))
                c = c.strip(" \t")
                row.children.append(Node("TableCell", parse_inline(c, line.at + at + lead), start=line.at + at + lead, end=line.at + at + lead + len(c)))
            node.children.append(row)
        out.append(node)
        return j

    def _paragraph(self, lines: list[Line], i: int, out: list[Node]) -> int:
        j = i + 1
        while j < len(lines):
            text = lines[j].text
            if not text.strip() or self._starts(text) and not _SETEXT.match(text) or _FOOTNOTE.match(text):
                break
            if m := _SETEXT.match(text):
                body, at = self._joined(lines[i:j])
                out.append(Node("Heading", parse_inline(body, at), attrs={"level": "1" if m[1][0] == "=" else "2"}, start=lines[i].at, end=lines[j].end))
                return j + 1
            j += 1
        nodes: list[Node] = []
        for k, line in enumerate(lines[i:j]):
            lead = len(line.text) - len(line.text.lstrip(" \t"))
            nodes.append((line.at + lead, line.text[lead:] + ("\n" if k < j - i - 1 else "")))
        text = "".join(t for _, t in nodes).rstrip(" \t") if nodes else ""
        inline = self.inline(text, nodes[0][0])
        shift(inline, nodes)
        out.append(Node("Paragraph", inline, start=lines[i].at, end=lines[j - 1].end))
        return j

    @staticmethod
    def _joined(lines: list[Line]) -> tuple[str, int]:
        return "\n".join(x.text.strip() for x in lines), lines[0].at + len(lines[0].text) - len(lines[0].text.lstrip())

    # ------------------------------------------------------------ whole-tree steps, in this order

    def finish(self, root: Node) -> None:
        quote_headings(root)
        self._footnotes(root)
        self._math_blocks(root)
        for kind, mark, pattern in _PATTERNS:
            for n in list(root.walk()) if mark in self.source else ():
                if n.children and n.type != "Link" or kind == "Emoji":
                    n.children = [x for c in n.children for x in (self._split(c, kind, pattern) if c.type == "Text" else [c])]
        self._resolve(root)
        stitch(root)
        definition_lists(root)
        self._embeds(root)
        self._contents(root)

    def _footnotes(self, root: Node) -> None:
        defs: dict[str, Node] = {}
        for d in [c for c in root.children if c.type == "FootnoteDef"]:
            defs[d.attrs["id"]] = d
        order: list[str] = []
        for n in root.walk():
            for k, c in enumerate(n.children):
                if c.type == "Link" and (m := re.fullmatch(r"\[\^([A-Za-z0-9_-]+)\]", c.attrs.get("raw", ""))):
                    n.children[k] = Node("FootnoteRef", attrs={"id": m[1]}, start=c.start, end=c.end)
                    if m[1] not in order:
                        order.append(m[1])
        used = [defs[i] for i in order if i in defs]
        root.children = [c for c in root.children if c.type != "FootnoteDef"] + (used or [d for d in defs.values() if d.children])

    def _math_blocks(self, root: Node) -> None:
        for k, c in enumerate(root.children):
            if c.type == "Paragraph" and (m := re.fullmatch(r"\$\$([\s\S]+?)\$\$", self.source[c.start : c.end].strip())):
                root.children[k] = Node("MathBlock", literal=m[1], start=c.start, end=c.end)

    def _split(self, n: Node, kind: str, pattern: re.Pattern) -> list[Node]:
        out, last = [], 0
        place = lambda i: n.start + i if n.start >= 0 else -1
        for m in pattern.finditer(n.literal):
            literal = self.emoji.get(m[1]) if kind == "Emoji" else m[1]
            if literal is None:
                continue
            if m.start() > last:
                out.append(text_node(n.literal[last : m.start()], place(last)))
            attrs = {"code": m[1]} if kind == "Emoji" else {}
            literal = literal.encode().decode("latin-1") if kind == "Emoji" else literal
            out.append(Node(kind, literal=literal, attrs=attrs, start=place(m.start()), end=place(m.end())))
            last = m.end()
        if not out:
            return [n]
        return out + ([text_node(n.literal[last:], place(last))] if last < len(n.literal) else [])

    def _resolve(self, root: Node) -> None:
        for n in root.walk():
            if n.type in ("Link", "Image") and "ref" in n.attrs and not n.attrs["ref"].startswith(("!", "^")):
                found = self.links.get(normal_label(n.attrs["ref"]))
                if found:
                    n.attrs.pop("ref")
                    n.attrs.pop("raw", None)
                    n.attrs["src" if n.type == "Image" else "href"] = found["href"]
                    if "title" in found:
                        n.attrs["title"] = found["title"]

    def _embeds(self, root: Node) -> None:
        for k, c in enumerate(root.children):
            if c.type == "Paragraph" and (m := _EMBED.match(self.source[c.start : c.end].strip())):
                provider = next((p for p, parts in PROVIDERS if any(x in m[1].lower() for x in parts)), "generic")
                root.children[k] = Node("AutoEmbed", attrs={"src": m[1], "provider": provider}, start=c.start, end=c.end)

    def _contents(self, root: Node) -> None:
        headings = [n for n in root.walk() if n.type == "Heading"]
        for k, c in enumerate(root.children):
            if c.type == "Paragraph" and _TOC.match(self.source[c.start : c.end].strip()):
                root.children[k] = Node("TableOfContents", toc(headings), start=c.start, end=c.end)


def shift(nodes: list[Node], parts: list[tuple[int, str]]) -> None:
    """Move byte places of a joined text back to where its lines stand."""
    bounds, total = [], 0
    for at, t in parts:
        bounds.append((parts[0][0] + total, at))
        total += len(t)

    joins = [joined for joined, _ in bounds]

    def moved(x: int, closing: bool) -> int:
        joined, at = bounds[max((bisect_left if closing else bisect_right)(joins, x) - 1, 0)]
        return at + x - joined

    if len(parts) > 1:
        for top in nodes:
            for n in top.walk():
                if n.start >= 0:
                    n.start, n.end = moved(n.start, False), moved(n.end, True)


def quote_headings(root: Node) -> None:
    """A quote that opens with a bracketed text has it as a strong heading."""
    for n in root.walk():
        if n.type == "Blockquote" and n.children and n.children[0].type == "Paragraph" and n.children[0].children:
            inline = n.children[0].children
            if re.fullmatch(r"\[[^\^!][\s\S]*\]", inline[0].attrs.get("raw", "")):
                inline[0] = Node("Strong", inline[0].children)


def cells(line: str) -> list[tuple[int, str]]:
    """(offset, text) of the cells of a pipe row; escaped pipes and those in code stay."""
    stripped = line.rstrip()
    at = len(line) - len(line.lstrip())
    if stripped[at : at + 1] == "|":
        at += 1
    out, start, code, i = [], at, False, at
    while i < len(stripped):
        c = stripped[i]
        if c == "\\":
            i += 1
        elif c == "`":
            code = not code
        elif c == "|" and not code:
            out.append((start, stripped[start:i]))
            start = i + 1
        i += 1
    if start < len(stripped):
        out.append((start, stripped[start:]))
    return out


def container_info(name: str, tail: str) -> dict[str, str]:
    attrs, tail = {"name": name.lower()}, tail.strip()
    if tail:
        attrs["raw"] = tail
    if m := _ATTRS.search(tail):
        tail = tail[: m.start()].strip()
        classes, extra = [], {}
        for i, c, k, v in _PAIR.findall(m[1]):
            if i:
                attrs["id"] = i
            elif c:
                classes.append(c)
            else:
                v = v[1:-1] if v[:1] in "\"'" else v
                if k == "id":
                    attrs["id"] = v
                elif k == "class":
                    classes += v.split()
                else:
                    extra[k] = v
        if classes:
            attrs["class"] = " ".join(classes)
        if extra:
            attrs["attrs"] = json.dumps(extra, sort_keys=True, separators=(",", ":"))
    if tail:
        attrs["title"] = tail[1:-1] if len(tail) > 1 and tail[0] == tail[-1] == '"' else tail
    return attrs


def diagram(code: Node) -> Node:
    """A code block whose language names a diagram becomes one."""
    language = code.attrs.get("language", "")
    name = language.lower().removeprefix("{").removeprefix(".").removesuffix("}").replace("_", "-")
    if name in ("mermaid", "mmd"):
        first = next((x.strip() for x in code.literal.split("\n") if x.strip() and not x.strip().startswith("%%")), "")
        token = (first.split() or [""])[0].rstrip(":{").lower()
        kind = DIAGRAMS.get(token, "mermaid")
    elif name in DIAGRAMS:
        kind = DIAGRAMS[name]
    else:
        return code
    return Node("Diagram", literal=code.literal, attrs={"language": language, "syntax": "mermaid", "kind": kind}, start=code.start, end=code.end)


def stitch(root: Node) -> None:
    """List, paragraphs, list of the same kind at the root: one list, the paragraphs in its last item."""
    out: list[Node] = []
    for n in root.children:
        k = len(out) - 1
        while k >= 0 and out[k].type == "Paragraph":
            k -= 1
        if n.type == "List" and 0 <= k < len(out) - 1 and out[k].type == "List" and out[k].attrs.get("ordered") == n.attrs.get("ordered"):
            out[k].children[-1].children += out[k + 1 :]
            out[k].children += n.children
            out[k].end = n.end
            del out[k + 1 :]
        else:
            out.append(n)
    root.children = out


def definition_lists(root: Node) -> None:
    """Paragraphs `Term`, `: description` at the root; neighbours share one list."""
    out: list[Node] = []
    for n in root.children:
        parts = _described(n) if n.type == "Paragraph" else None
        if parts is None:
            out.append(n)
        elif out and out[-1].type == "DefinitionList":
            out[-1].children += parts
        else:
            out.append(Node("DefinitionList", parts))
    root.children = out


def _described(p: Node) -> list[Node] | None:
    rows: list[list[Node]] = [[]]
    for c in p.children:
        if c.type == "SoftBreak":
            rows.append([])
        else:
            rows[-1].append(c)
    if len(rows) < 2 or not rows[0] or not all(r and r[0].type == "Text" and r[0].literal.startswith(": ") for r in rows[1:]):
        return None
    out = [Node("DefinitionTerm", rows[0])]
    for r in rows[1:]:
        out.append(Node("DefinitionDesc", merged([text_node(r[0].literal[2:].lstrip(), -1), *r[1:]])))
    return out


def slug(text: str) -> str:
    """Lower case; letters and digits stay, blanks, dashes and underscores are one dash, all else goes."""
    own = text.encode("latin-1").decode("utf-8", "replace").lower()
    kept = "".join(c if c.isalpha() or c.isdecimal() else "-" if c in " -_" else "" for c in own)
    return re.sub("-+", "-", kept).strip("-").encode().decode("latin-1")


def toc(headings: list[Node]) -> list[Node]:
    """Nested lists of links; a skipped level hangs on the nearest shallower item."""
    if not headings:
        return []
    root = Node("List")
    path: list[tuple[int, Node]] = [(0, root)]
    for h in headings:
        level = int(h.attrs["level"])
        while len(path) > 1 and path[-1][0] >= level:
            path.pop()
        holder = path[-1][1]
        if holder.type == "ListItem":
            if holder.children[-1].type != "List":
                holder.children.append(Node("List"))
            holder = holder.children[-1]
        text = h.text()
        item = Node("ListItem", [Node("Link", [text_node(text, -1)], attrs={"href": f"#{slug(text)}"})])
        holder.children.append(item)
        path.append((level, item))
    return [root]


def _jumps(lines: list[Line]) -> bool:
    """Whether a document of bullets alone that is at least six levels deep skips a level."""
    levels = []
    for line in lines:
        if line.text.strip():
            m = _DEEP.match(line.text)
            if not m:
                return False
            levels.append(len(m[1]) // 2)
    return bool(levels) and max(levels) >= 5 and any(b > a + 1 for a, b in zip([-1, *levels], levels, strict=False))


class Parsed(NamedTuple):
    root: Node
    source: str
    diagnostics: list[tuple[str, str, str, int, int]]
    front: dict | None
    links: list[tuple[str, str, str, int, int]]  # label, href, title, and where the definition stands
    uses: list[tuple[str, int, int]]  # label, and where it is used in brackets
    pairs: list[tuple[str, str, int, int]]  # label and text of each resolved [text][label], and where it stands


def read(source: str, emoji: dict[str, str] | None = None, chunked: bool = False) -> Parsed:
    """Tree, lowered source, diagnostics, frontmatter, link definitions and their uses of a document;
    `chunked`: the text of long paragraphs is parsed in chunks. Never raises: a failure is one Text node
    and MDPP-PARSE-000."""
    text = source.encode("utf-8", "surrogatepass").decode("latin-1")
    try:
        low = lowered(text)
        p = Parser(low, emoji, chunked)
        root = p.document()
        links = [(label, link["href"], link.get("title", ""), *p.defined[label]) for label, link in p.links.items()]
        uses = [(label, m.start(), m.end()) for m in _BRACKETS.finditer(low) if (label := normal_label(m[1])) in p.links] if p.links else []
        found = ((n, m) for n in root.walk() if p.links and n.type == "Link" and n.start >= 0 and (m := _PAIRED.fullmatch(low, n.start, n.end)))
        pairs = [(label, m[1], n.start, n.end) for n, m in found if (label := normal_label(m[2] or m[1])) in p.links]
        return Parsed(root, low, p.diagnostics, p.front, links, uses, pairs)
    except Exception as e:  # noqa: BLE001  one odd document must not end a job
        return Parsed(Node("Document", [text_node(text, 0)], start=0, end=len(text)), text, [("MDPP-PARSE-000", "error", f"parser failed: {type(e).__name__}", 0, len(text))], None, [], [], [])


def parse(source: str, emoji: dict[str, str] | None = None) -> tuple[Node, str, list[tuple[str, str, str, int, int]]]:
    """The first three of `read`."""
    return read(source, emoji)[:3]
