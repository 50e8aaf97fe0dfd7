"""HTML of a tree: a fold with one small function a node type."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from quillspark.functions.blocks import Parser, slug
from quillspark.functions.inline import Node, parse_inline
from quillspark.functions.latex import escape, latex
from quillspark.functions.vocabulary import ADMONITIONS


@dataclass(frozen=True)
class Options:
    """heading_ids, source_positions, hard_wraps, unsafe_html and wrap_emoji switch on what they name; math is
    server, raw or omit; the three callables replace image sources, container HTML and code HTML. sanitize changes
    nothing, since what is unsafe is escaped unless unsafe_html asks for it."""

    heading_ids: bool = False
    source_positions: bool = False
    hard_wraps: bool = False
    unsafe_html: bool = False
    wrap_emoji: bool = False
    sanitize: bool = False
    math: str = "server"
    image_resolver: Callable[[str], str] | None = None
    container_html: Callable[[Node, str], str] | None = None
    highlight: Callable[[str, str], str | None] | None = None


def utf8(s: str) -> str:
    return s.encode("latin-1").decode("utf-8", "replace")


def class_token(s: str) -> str:
    return re.sub(r"[\W_]+", "-", utf8(s).lower()).strip("-")


class Renderer:
    def __init__(self, options: Options, source: str) -> None:
        self.o = options
        self.source = source
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))] if options.source_positions else []

    def render(self, n: Node) -> str:
        return getattr(self, f"_{n.type}", self.inside)(n)

    def inside(self, n: Node) -> str:
        return "".join(map(self.render, n.children))

    def where(self, n: Node) -> str:
        if not self.o.source_positions or n.start < 0:
            return ""
        (sl, sc), (el, ec) = map(self._place, (n.start, n.end))
        values = {"start-byte": n.start, "end-byte": n.end, "start-line": sl, "start-col": sc, "end-line": el, "end-col": ec}
        return "".join(f' data-mdpp-source-{k}="{v}"' for k, v in values.items())

    def _place(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def _block(tag: str, gap: str = "", tail: str = "\n"):  # noqa: N805
        return lambda self, n: f"<{tag}{self.where(n)}>{gap}{self.inside(n)}</{tag}>{tail}"

    def _inline(tag: str):  # noqa: N805
        return lambda self, n: f"<{tag}>{self.inside(n)}</{tag}>"

    def _leaf(tag: str):  # noqa: N805
        return lambda self, n: f"<{tag}>{escape(utf8(n.literal))}</{tag}>"

    _Paragraph = _block("p")
    _Blockquote = _block("blockquote", "\n")
    _DefinitionList = _block("dl", "\n")
    _DefinitionTerm, _DefinitionDesc = _block("dt"), _block("dd")
    _Emphasis, _Strong, _Strikethrough = _inline("em"), _inline("strong"), _inline("del")
    _CodeSpan, _Superscript, _Subscript = _leaf("code"), _leaf("sup"), _leaf("sub")

    def _Heading(self, n: Node) -> str:
        tag = f"h{n.attrs.get('level', '1')}"
        own = f' id="{utf8(slug(n.text()))}"' if self.o.heading_ids else ""
        return f"<{tag}{own}{self.where(n)}>{self.inside(n)}</{tag}>\n"

    def _CodeBlock(self, n: Node) -> str:
        language = utf8(n.attrs.get("language", ""))
        body = self.o.highlight(language, utf8(n.literal)) if self.o.highlight and language else None
        named = f' class="language-{escape(language)}"' if language else ""
        return f"<pre{self.where(n)}><code{named}>{escape(utf8(n.literal)) if body is None else body}</code></pre>\n"

    def _Diagram(self, n: Node) -> str:
        syntax, kind = n.attrs.get("syntax", "diagram"), n.attrs.get("kind", "diagram")
        language = n.attrs.get("language", syntax).lower().removeprefix("{").removeprefix(".").removesuffix("}").replace("_", "-") or syntax
        return f'<figure class="mdpp-diagram mdpp-diagram-{class_token(syntax)} mdpp-diagram-{class_token(kind)}" data-diagram-syntax="{escape(syntax)}" data-diagram-kind="{escape(kind)}"><pre><code class="language-{escape(language)}">{escape(utf8(n.literal))}</code></pre></figure>\n'

    def _Frontmatter(self, n: Node) -> str:
        return ""

    def _List(self, n: Node) -> str:
        tag = "ol" if n.attrs.get("ordered") == "true" else "ul"
        start = f' start="{n.attrs["start"]}"' if tag == "ol" and "start" in n.attrs else ""
        return f"<{tag}{start}{self.where(n)}>\n{self.inside(n)}</{tag}>\n"

    def _ListItem(self, n: Node) -> str:
        return f"<li{self.where(n)}>{self.inside(n).rstrip(chr(10))}</li>\n"

    def _TaskListItem(self, n: Node) -> str:
        checked = " checked" * (n.attrs.get("checked") == "true")
        body = self.inside(n.children[0]) if len(n.children) == 1 and n.children[0].type == "Paragraph" else self.inside(n).rstrip("\n")
        return f'<li class="task-list-item"{self.where(n)}><input type="checkbox" disabled{checked} />{body}</li>\n'

    def _Table(self, n: Node) -> str:
        styles = [f' style="text-align:{a}"' if a else "" for a in n.attrs.get("align", "").split(",")]
        columns = "<colgroup>\n" + "".join(f"<col{s} />\n" for s in styles) + "</colgroup>\n" if any(styles) else ""
        row = lambda r, tag, extra: "<tr>" + "".join(f"<{tag}{extra}{styles[i] if i < len(styles) else ''}>{self.inside(c)}</{tag}>" for i, c in enumerate(r.children)) + "</tr>\n"
        head = f"<thead>\n{row(n.children[0], 'th', ' scope=\"col\"')}</thead>\n" if n.children else ""
        body = f"<tbody>\n{''.join(row(r, 'td', '') for r in n.children[1:])}</tbody>\n" if len(n.children) > 1 else ""
        return f'<div class="mdpp-table"{self.where(n)}>\n<table>\n{columns}{head}{body}</table>\n</div>\n'

    def _ThematicBreak(self, n: Node) -> str:
        return f"<hr{self.where(n)} />\n"

    def _Link(self, n: Node) -> str:
        if not n.attrs.get("href"):
            return escape(utf8(n.attrs["raw"])) if n.attrs.get("raw") else self.inside(n)
        title = f' title="{escape(utf8(n.attrs["title"]))}"' if n.attrs.get("title") else ""
        return f'<a href="{escape(utf8(n.attrs["href"]))}"{title}>{self.inside(n)}</a>'

    def _Image(self, n: Node) -> str:
        src = utf8(n.attrs.get("src", ""))
        src = escape(self.o.image_resolver(src) if self.o.image_resolver else src)
        pair = f'src="{src}" alt="{escape(utf8(n.attrs.get("alt", "")))}"'
        if n.attrs.get("title"):
            return f"<figure{self.where(n)}><img {pair} /><figcaption>{escape(utf8(n.attrs['title']))}</figcaption></figure>"
        return f"<img{self.where(n)} {pair} />"

    def _Text(self, n: Node) -> str:
        return escape(utf8(n.literal))

    def _HTMLBlock(self, n: Node) -> str:
        return utf8(n.literal) if self.o.unsafe_html else escape(utf8(n.literal))

    _HTMLInline = _HTMLBlock

    def _SoftBreak(self, n: Node) -> str:
        return "<br />\n" if self.o.hard_wraps else "\n"

    def _HardBreak(self, n: Node) -> str:
        return "<br />\n"

    def titled(self, text: str) -> str:
        """A title's inline text: HTML is escaped and lines don't break hard."""
        root = Node("Document", parse_inline(text, -1))
        Parser(text).finish(root)
        return Renderer(replace(self.o, unsafe_html=False, hard_wraps=False, source_positions=False), "").inside(root)

    def _Admonition(self, n: Node) -> str:
        kind = n.attrs["type"]
        return f'<div class="admonition admonition-{kind}"{self.where(n)}><p class="admonition-title">{self.titled(n.attrs.get("title") or kind.upper())}</p>{self.inside(n)}</div>\n'

    def _ContainerDirective(self, n: Node) -> str:
        body = self.inside(n)
        if self.o.container_html:
            return self.o.container_html(n, body)
        name, title = n.attrs["name"], n.attrs.get("title", "")
        own = f' id="{escape(utf8(n.attrs["id"]))}"' if n.attrs.get("id") else ""
        more = f" {escape(utf8(n.attrs['class']))}" if n.attrs.get("class") else ""
        if name in ADMONITIONS:
            return f'<div class="admonition admonition-{name}{more}"{own}{self.where(n)}><p class="admonition-title">{self.titled(title or name.upper())}</p>{body}</div>\n'
        if name == "details":
            summary = f"<summary>{self.titled(title)}</summary>" if title else ""
            return f'<details class="mdpp-container mdpp-container-details" data-mdpp-container="details"{own}{self.where(n)}>{summary}{body}</details>\n'
        kind = "mdpp-col" if name in ("column", "col") else f"mdpp-container-{class_token(name)}"
        head = f'<p class="mdpp-container-title">{self.titled(title)}</p>' if title else ""
        return f'<div class="mdpp-container {kind}{more}" data-mdpp-container="{escape(name)}"{own}{self.where(n)}>{head}{body}</div>\n'

    def _FootnoteRef(self, n: Node) -> str:
        i = n.attrs["id"]
        return f'<sup><a class="footnote-ref" href="#fn-{i}" id="fnref-{i}">[{i}]</a></sup>'

    def _FootnoteDef(self, n: Node) -> str:
        i = n.attrs["id"]
        # the arrow is written as an escape sequence, as it always was
        return f'<section class="footnotes"><ol><li id="fn-{i}">{self.inside(n)} <a href="#fnref-{i}">\\u21a9</a></li></ol></section>\n'

    def _math(self, n: Node, opening: str, closing: str, wrap: str) -> str:
        if self.o.math == "omit":
            return ""
        body = utf8(n.literal)
        return f"{opening}{escape(body)}{closing}" if self.o.math == "raw" else wrap.format(latex(body))

    def _MathInline(self, n: Node) -> str:
        return self._math(n, r"\(", r"\)", '<span class="math-inline">{}</span>')

    def _MathBlock(self, n: Node) -> str:
        return self._math(n, r"\[", r"\]", '<div class="math-block">{}</div>\n')

    def _Emoji(self, n: Node) -> str:
        own = utf8(n.literal)
        return f'<span class="emoji" role="img" aria-label="{escape(n.attrs["code"])}">{own}</span>' if self.o.wrap_emoji else own

    def _TableOfContents(self, n: Node) -> str:
        return f'<nav class="mdpp-toc" aria-label="Table of contents"{self.where(n)}>\n{self.inside(n)}</nav>\n'

    def _AutoEmbed(self, n: Node) -> str:
        src, provider = escape(utf8(n.attrs["src"])), escape(n.attrs["provider"])
        return f'<div class="mdpp-embed mdpp-embed-{provider}" data-src="{src}" data-provider="{provider}"{self.where(n)}><a href="{src}">{src}</a></div>\n'


def render(root: Node, source: str, options: Options = Options()) -> str:
    return Renderer(options, source).render(root)
