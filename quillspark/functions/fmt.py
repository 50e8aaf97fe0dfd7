"""Canonical source of a document.

Pass one rewrites lines one by one, with the state that protects frontmatter, code, display math and HTML
lines; pass two parses the result and rewrites what needs the tree: tables, lists, containers and
paragraphs. Definitions go to the end, blank lines collapse.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from dataclasses import dataclass

from quillspark.functions.blocks import _DEFINITION, _FOOTNOTE, Parsed, Parser, cells, lines_of, lowered, slug
from quillspark.functions.inline import Node, normal_label
from quillspark.functions.render import utf8


@dataclass
class Row:
    text: str
    protected: bool = False
    gone: bool = False


_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_BULLET = re.compile(r"^(\s*(?:> ?)*)[*+]([ \t]+)")
_NUMBER = re.compile(r"^(\s*(?:> ?)*)(\d+)[.)]([ \t]+)")
_TASK = re.compile(r"^(\s*(?:> ?)*(?:[-*+]|\d+[.)])[ \t]+)\[(?:X|\xe2\x9c\x93|\xe2\x9c\x94)\]")
_STRONG = re.compile(r"(?<![A-Za-z0-9\x80-\xff_])__(?=\S)(.+?)(?<=\S)__(?![A-Za-z0-9\x80-\xff_])")
_EM = re.compile(r"(?<![A-Za-z0-9\x80-\xff_])_(?=[^\s_])([^_]*?)(?<=[^\s_])_(?![A-Za-z0-9\x80-\xff_])")
_ADMONITION = re.compile(r"^\s*>\s*\[!(note|warning|tip|important|caution)\][ \t]*(.*)$", re.IGNORECASE)
_TOC = re.compile(r"^\s*\[\[\s*toc\s*\]\]\s*$", re.IGNORECASE)
_EMBED = re.compile(r"^\s*\[\[\s*embed\s*:\s*(\S+?)\s*\]\]\s*$", re.IGNORECASE)
_CODE_SPAN = re.compile(r"(`+)(?:(?!\1).)*\1")


def fence_info(info: str) -> str:
    """First token and attribute names in lower case."""
    info = info.strip()
    if not info:
        return ""
    head, _, tail = info.partition(" ")
    tail = re.sub(r"([A-Za-z][\w-]*)=", lambda m: m[0].lower(), tail.strip())
    return head.lower() + (f" {tail}" if tail else "")


def emphasis(line: str) -> str:
    """Underscored emphasis as asterisks, outside code spans."""
    out, last = [], 0
    for m in [*_CODE_SPAN.finditer(line), None]:
        plain = line[last : m.start() if m else len(line)]
        out.append(_EM.sub(r"*\1*", _STRONG.sub(r"**\1**", plain)))
        if m:
            out.append(m[0])
            last = m.end()
    return "".join(out)


def scan(src: str) -> list[Row]:
    """Lines rewritten one by one."""
    raw = src.split("\n")
    out: list[Row] = []
    i = 0
    if raw and raw[0] == "---" and "---" in raw[1:]:
        stop = raw.index("---", 1)
        out += [Row(x, True) for x in raw[: stop + 1]]
        i = stop + 1
    math = admonition = False
    while i < len(raw):
        line = raw[i]
        if m := _FENCE.match(line):
            close = next((j for j in range(i + 1, len(raw)) if (c := _FENCE.match(raw[j])) and c[2][0] == m[2][0] and len(c[2]) >= len(m[2]) and not c[3]), len(raw) - 1)
            body = raw[i + 1 : close]
            mark = "`" * len(m[2]) if m[2][0] == "~" and not any("```" in x for x in body) else m[2]
            info = fence_info(m[3])
            out.append(Row(f"{m[1]}{mark}{' ' + info if info else ''}", True))
            out += [Row(x, True) for x in body]
            out.append(Row(f"{m[1]}{mark}" if _FENCE.match(raw[close]) else raw[close], True))
            i = close + 1
            continue
        if line.strip() == "$$":
            math = not math
            out.append(Row("$$", True))
            i += 1
            continue
        if math or re.match(r"^\s*<.*>\s*$", line):
            out.append(Row(line, True))
            i += 1
            continue
        following = raw[i + 1] if i + 1 < len(raw) else ""
        plain = line.rstrip(" \t")
        if plain and re.match(r"^ {0,3}(=+|-{2,})[ \t]*$", following) and not re.match(r"^\s*([>#|]|[-*+] |\d+[.)] )", plain) and not (out and out[-1].text and not out[-1].protected and not out[-1].text.startswith("#")):
            out.append(Row(("# " if following.strip()[0] == "=" else "## ") + emphasis(plain.strip())))
            i += 2
            admonition = False
            continue
        if m := _ADMONITION.match(line):
            out.append(Row(f"> [!{m[1].upper()}]{' ' + m[2].strip() if m[2].strip() else ''}"))
            admonition = True
        elif admonition and plain.strip():
            body = re.sub(r"^\s*>\s?", "", plain).strip() if plain.lstrip().startswith(">") else plain.strip()
            out.append(Row(f"> {emphasis(body)}" if body else ">"))
        elif _TOC.match(line):
            out.append(Row("[[toc]]"))
        elif m := _EMBED.match(line):
            out.append(Row(f"[[embed:{m[1]}]]"))
        elif m := _HEADING.match(line):
            out.append(Row(f"{m[1]} {emphasis(m[2].strip())}".rstrip()))
        else:
            hard = len(line) - len(line.rstrip(" ")) >= 2 and bool(plain) and bool(following.strip())
            text = _TASK.sub(r"\1[x]", plain)
            text = _NUMBER.sub(r"\1\2.\3", _BULLET.sub(r"\1-\2", text)) if not re.match(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}$", text) else text
            out.append(Row(emphasis(text) + ("\\" if hard else "")))
        if not plain.strip():
            admonition = False
        i += 1
    return out


def collected(rows: list[Row]) -> tuple[list[Row], list[str]]:
    """Rows without definitions, and the definitions: references, then footnotes, each by label."""
    rest, refs, notes = [], [], []
    i = 0
    while i < len(rows):
        t = rows[i].text
        if not rows[i].protected and (m := _DEFINITION.match(t)):
            refs.append((normal_label(m[1]), t.strip()))
        elif not rows[i].protected and (m := _FOOTNOTE.match(t)):
            body = [t.strip()]
            while i + 1 < len(rows) and not rows[i + 1].protected and re.match(r"^(?: {2,}|\t)\S", rows[i + 1].text):
                i += 1
                body.append(rows[i].text.rstrip())
            notes.append((m[1], "\n".join(body)))
        else:
            rest.append(rows[i])
        i += 1
    groups = ["\n".join(t for _, t in sorted(g, key=lambda x: x[0])) for g in (refs, notes) if g]
    return rest, groups


def guided(rows: list[Row]) -> list[Row]:
    """Rewrites that need the tree of the rewritten lines."""
    src = "\n".join(r.text for r in rows)
    src = src if src.endswith("\n") else src + "\n"
    if lowered(src) != src:
        return rows
    root = Parser(src).document()
    starts = [x.at for x in lines_of(src)]
    line_of = {a: i for i, a in enumerate(starts)}

    def span(n: Node) -> tuple[int, int]:
        return bisect_right(starts, n.start) - 1, bisect_right(starts, max(n.start, n.end - 1)) - 1

    for n in root.walk():
        if n.type == "Table" and n.start in line_of:
            a, b = span(n)
            if b - a == len(n.children) and not any(r.protected for r in rows[a : b + 1]):
                marks = n.attrs.get("align", "").split(",")
                marks += [""] * (len(n.children[0].children) - len(marks))
                for k, i in enumerate(range(a, b + 1)):
                    if k == 1:
                        rows[i].text = "| " + " | ".join({"left": ":---", "right": "---:", "center": ":---:"}.get(m, "---") for m in marks[: len(n.children[0].children)]) + " |"
                    else:
                        rows[i].text = "| " + " | ".join(c.strip() for _, c in cells(rows[i].text)) + " |"
        elif n.type == "ContainerDirective":
            a, b = span(n)
            colons = re.match(r":*", rows[a].text)[0]
            if colons and "attrs" not in n.attrs:
                braces = ([f"#{n.attrs['id']}"] if "id" in n.attrs else []) + [f".{c}" for c in n.attrs.get("class", "").split()]
                rows[a].text = colons + n.attrs["name"] + (f' "{n.attrs["title"]}"' if n.attrs.get("title") else "") + (f" {{{' '.join(braces)}}}" if braces else "")
            if re.match(r"^:{3,}\s*$", rows[b].text):
                rows[b].text = rows[b].text.rstrip()
    _lists(root, rows, span, 0)
    for n in root.children:
        if n.type == "Paragraph" and n.start in line_of and len(n.children) > 1 and all(c.type in ("Text", "SoftBreak") for c in n.children):
            a, b = span(n)
            own = rows[a : b + 1]
            if not any(r.protected or r.text.endswith("\\") or re.match(r"^\s*(: |\$\$|\[)", r.text) for r in own):
                own[0].text = " ".join(" ".join(r.text for r in own).split(" ")).strip()
                own[0].text = re.sub(r"[ \t]+", " ", own[0].text)
                for r in own[1:]:
                    r.gone = True
    return [r for r in rows if not r.gone]


def _lists(n: Node, rows: list[Row], span, depth: int) -> None:
    """Numbers in sequence and two blanks an outer list, children first so that their lines move once."""
    for c in n.children:
        _lists(c, rows, span, depth + (n.type == "List"))
    if n.type != "List":
        return
    number = int(n.attrs.get("start", "1"))
    for item in n.children:
        a, _ = span(item)
        row = rows[a]
        if not row.protected and (m := re.match(r"^(\s*)(-|\d+\.)([ \t]+)(.*)$", row.text)):
            mark = f"{number}." if n.attrs.get("ordered") == "true" else "-"
            row.text = f"{'  ' * depth}{mark} {m[4]}" if depth == 0 or not m[1].strip() else row.text
        number += 1


def blanks(rows: list[Row]) -> list[str]:
    out: list[str] = []
    for r in rows:
        if r.protected or r.text.strip():
            out.append(r.text)
        elif out and (out[-1].strip()):
            out.append("")
    while out and not out[-1].strip():
        out.pop()
    return out


def format_source(source: str) -> str:
    """The canonical source; it ends in LF, and formatting it again changes nothing."""
    text = source.removeprefix("﻿").encode("utf-8", "surrogatepass").decode("latin-1")
    src = text.replace("\r\n", "\n").replace("\r", "\n")
    for _ in range(4):
        rows, groups = collected(scan(src))
        body = "\n".join(blanks(guided(rows)))
        new = "\n\n".join([*([body] if body else []), *groups]) + "\n"
        if new == src:
            break
        src = new
    return utf8(src)


def simple_diff(name: str, before: str, after: str) -> str:
    """All old lines, then all new ones."""
    old, new = before.split("\n"), after.split("\n")
    return "\n".join([f"--- {name}", f"+++ {name} (formatted)", "@@", *(f"-{x}" for x in old), *(f"+{x}" for x in new)]) + "\n"


def contents(root: Node) -> list[dict]:
    """Level, id and text of the headings."""
    return [{"level": int(n.attrs["level"]), "id": utf8(slug(n.text())), "text": utf8(n.text())} for n in root.walk() if n.type == "Heading"]


def as_json(p: Parsed, name: str = "", pretty: bool = False) -> str:
    """A document as JSON: file, frontmatter, diagnostics, headings, contents and the nested tree; empty fields left out."""
    starts = [x.at for x in lines_of(p.source)] or [0]

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at) if at < len(p.source) or not p.source else len(starts) + 1
        return line, at - (starts[line - 1] if line <= len(starts) else len(p.source)) + 1

    def span(start: int, end: int) -> dict:
        (a, b), (c, d) = (place(start), place(end)) if start >= 0 else ((0, 0), (0, 0))
        return {"start_byte": max(start, 0), "end_byte": max(end, 0), "start_line": a, "start_col": b, "end_line": c, "end_col": d}

    def one(n: Node) -> dict:
        out: dict = {"type": n.type}
        if n.literal:
            out["literal"] = utf8(n.literal)
        if n.attrs:
            out["attrs"] = {k: utf8(v) for k, v in sorted(n.attrs.items())}
        out["range"] = span(n.start, n.end)
        if n.children:
            out["children"] = [one(c) for c in n.children]
        return out

    headings = contents(p.root)
    whole: dict = {"file": name, "root": one(p.root)}
    if p.front:
        whole["frontmatter"] = dict(sorted(p.front.items()))
    if p.diagnostics:
        whole["diagnostics"] = [{"range": span(a, b), "severity": s, "code": c, "message": m} for c, s, m, a, b in p.diagnostics]
    if headings:
        whole["headings"] = [{"Level": h["level"], "Text": h["text"], "ID": h["id"]} for h in headings]
        whole["toc"] = [{"Level": h["level"], "ID": h["id"], "Text": h["text"]} for h in headings]
    text = json.dumps(whole, ensure_ascii=False, indent=2) if pretty else json.dumps(whole, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&\u2028\u2029":  # as they may stand in a script
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text
