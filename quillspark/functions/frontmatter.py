"""Frontmatter: the part of YAML that heads of documents are written in.

Block and flow maps and sequences, plain and quoted scalars, literal and folded blocks, comments. What isn't well
formed, or not a map, is refused. Anchors, tags and several documents are refused too.
"""

from __future__ import annotations

import json
import re
from typing import Any

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#,\[\]{}&*!|>'"%@`:?-](?:[^:#]|:(?=\S)|(?<=\S)#)*?|[?:-](?=\S)(?:[^:#]|:(?=\S)|(?<=\S)#)*?)[ \t]*:(?=\s|$)""")
_INT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)$")
_BASED = re.compile(r"[-+]?0(?:x[0-9A-Fa-f_]+|o?[0-7_]+|b[01_]+)$")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", " ": " ", "e": "\x1b", "b": "\b", "f": "\f"}


class Malformed(ValueError):
    pass


def scalar(text: str) -> Any:
    """A plain scalar by YAML's core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if _INT.match(text):
        return int(text.replace("_", ""))
    if m := _BASED.match(text):
        digits = m[0].replace("_", "").lower().lstrip("+-")
        base = {"x": 16, "b": 2}.get(digits[1:2], 8)
        value = int(digits[2:] if digits[1:2] in "xbo" else digits[1:], base)
        return -value if m[0][0] == "-" else value
    if _FLOAT.match(text) and any(c.isdigit() for c in text):
        return float(text.replace("_", ""))
    return text


def quoted(text: str) -> tuple[str, int]:
    """The quoted scalar at the text's start, and where it ends."""
    mark, out, i = text[0], [], 1
    while i < len(text):
        c = text[i]
        if mark == "'" and c == "'" and text[i + 1 : i + 2] == "'":
            out.append("'")
            i += 2
        elif c == mark:
            return "".join(out), i + 1
        elif mark == '"' and c == "\\":
            e = text[i + 1 : i + 2]
            if e in "xuU" and e:
                n = {"x": 2, "u": 4, "U": 8}[e]
                try:
                    out.append(chr(int(text[i + 2 : i + 2 + n], 16)))
                except ValueError:
                    raise Malformed("escape") from None
                i += 2 + n
            elif e in _ESCAPES:
                out.append(_ESCAPES[e])
                i += 2
            else:
                raise Malformed("escape")
        else:
            out.append(c)
            i += 1
    raise Malformed("quote is not closed")


def flow(text: str, i: int = 0) -> tuple[Any, int]:
    """The flow value at i, and where it ends."""
    i = _blank(text, i)
    if text[i : i + 1] == "[":
        out: list = []
        i = _blank(text, i + 1)
        while text[i : i + 1] != "]":
            value, i = flow(text, i)
            out.append(value)
            i = _blank(text, i)
            if text[i : i + 1] == ",":
                i = _blank(text, i + 1)
            elif text[i : i + 1] != "]":
                raise Malformed("sequence is not closed")
        return out, i + 1
    if text[i : i + 1] == "{":
        found: dict = {}
        i = _blank(text, i + 1)
        while text[i : i + 1] != "}":
            key, i = flow(text, i)
            i = _blank(text, i)
            value = None
            if text[i : i + 1] == ":":
                value, i = flow(text, i + 1)
                i = _blank(text, i)
            found[str(key)] = value
            if text[i : i + 1] == ",":
                i = _blank(text, i + 1)
            elif text[i : i + 1] != "}":
                raise Malformed("map is not closed")
        return found, i + 1
    if text[i : i + 1] in ('"', "'") and text[i : i + 1]:
        value, n = quoted(text[i:])
        return value, i + n
    m = re.compile(r"(?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)+").match(text, i)
    if not m:
        if text[i : i + 1] in (",", "]", "}", ":"):
            return None, i
        raise Malformed("value")
    return scalar(m[0].strip()), m.end()


def _blank(text: str, i: int) -> int:
    while i < len(text) and text[i] in " \t\n":
        i += 1
    return i


def _uncommented(text: str) -> str:
    """Without a comment at the end."""
    m = re.search(r"(?:^|\s)#", text)
    return (text[: m.start()] if m else text).strip()


class _Reader:
    def __init__(self, text: str) -> None:
        self.raw = text.split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that says something."""
        while self.at < len(self.raw):
            line = self.raw[self.at]
            own = line.lstrip(" ")
            if own.strip() and not own.startswith("#"):
                if own.startswith("\t"):
                    raise Malformed("tab as indent")
                return len(line) - len(own), own.rstrip()
            self.at += 1
        return None

    def block(self, indent: int) -> Any:
        head = self.peek()
        if head is None:
            return None
        if head[1] == "-" or head[1].startswith("- "):
            return self.sequence(head[0])
        if _KEY.match(head[1]):
            return self.mapping(head[0])
        del indent
        return self.value(head[1], head[0], True)

    def sequence(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            rest = head[1][1:].lstrip(" ")
            if not _uncommented(rest):
                self.at += 1
                following = self.peek()
                out.append(self.block(following[0]) if following and following[0] > indent else None)
            elif rest.startswith("- ") or _KEY.match(rest):
                # the item's own block starts on this line
                inner = indent + len(head[1]) - len(rest)
                self.raw[self.at] = " " * inner + rest
                out.append(self.block(inner))
            else:
                out.append(self.value(rest, indent, False))
        if head and head[0] > indent:
            raise Malformed("indent")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (head := self.peek()) and head[0] == indent:
            m = _KEY.match(head[1])
            if not m:
                raise Malformed("a line that is no key")
            key = quoted(m[1])[0] if m[1][0] in "\"'" else m[1]
            if key in out:
                raise Malformed("key stands twice")
            rest = head[1][m.end() :].strip()
            if not _uncommented(rest):
                self.at += 1
                following = self.peek()
                deeper = following and (following[0] > indent or (following[0] == indent and (following[1] == "-" or following[1].startswith("- "))))
                out[key] = self.block(following[0]) if deeper else None
            else:
                out[key] = self.value(rest, indent, False)
        if head and head[0] > indent:
            raise Malformed("indent")
        return out

    def value(self, text: str, indent: int, own_line: bool) -> Any:
        """A value that starts on the current line; lines that go on with it are deeper."""
        self.at += 1
        if text[0] in "|>" and re.match(r"[|>][-+0-9]*(?:\s+#.*)?$", text):
            return self.folded(text, indent)
        if text[0] in "&*!%@`":
            raise Malformed("not supported")
        if text[0] in "[{":
            parts = [text]
            while True:
                joined = "\n".join(parts)
                try:
                    value, end = flow(joined)
                except Malformed:
                    if self.at >= len(self.raw):
                        raise
                    parts.append(self.raw[self.at])
                    self.at += 1
                    continue
                if _uncommented(joined[end:]):
                    raise Malformed("text after a value")
                return value
        if text[0] in "\"'":
            while True:
                try:
                    value, end = quoted(text)
                    break
                except Malformed:
                    if self.at >= len(self.raw):
                        raise
                    text += " " + self.raw[self.at].strip()
                    self.at += 1
            if _uncommented(text[end:]):
                raise Malformed("text after a value")
            return value
        parts = [_uncommented(text)]
        while (head := self.peek()) and head[0] > indent - own_line and not (own_line and head[0] < indent):
            if _KEY.match(head[1]) or own_line:
                raise Malformed("a key inside a value")
            parts.append(_uncommented(head[1]))
            self.at += 1
        if re.search(r":(?:\s|$)", parts[0]):
            raise Malformed("a key inside a value")
        return scalar(" ".join(parts))

    def folded(self, text: str, indent: int) -> str:
        body = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > indent):
            body.append(self.raw[self.at])
            self.at += 1
        depth = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
        lines = [x[depth:] for x in body]
        while lines and not lines[-1].strip():
            lines.pop()
        out = "\n".join(lines) if text[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines))
        return out if "-" in text or not out else out + "\n"


def load(text: str) -> dict[str, Any] | None:
    """The map that the text says, None where it says nothing. Raises Malformed."""
    reader = _Reader(text)
    value = reader.block(0)
    if reader.peek() is not None:
        raise Malformed("text after the map")
    if value is not None and not isinstance(value, dict):
        raise Malformed("not a map")
    return value


def version_of(data: dict[str, Any] | None) -> str:
    """The dialect's version as it is compared: numbers in their shortest form."""
    v = (data or {}).get("mdpp")
    if isinstance(v, bool) or not isinstance(v, (str, int, float)):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


def as_json(data: dict[str, Any] | None) -> str:
    return json.dumps(data or {}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
