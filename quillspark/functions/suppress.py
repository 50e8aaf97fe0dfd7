"""What comments and frontmatter switch off in the linter."""

from __future__ import annotations

import re
from typing import Any

_COMMENT = re.compile(r"<!--\s*(mdpp-disable-next-line|mdpp-disable|mdpp-enable)\s*([^>]*)-->")


def _codes(text: str) -> list[str]:
    return [c for c in re.split(r"[,\s]+", text.strip()) if c] or ["*"]


def suppressions(source: str, front: dict[str, Any] | None) -> list[tuple[str, int, int | None]]:
    """(code or *, after which line, until which line or None). A block holds from the line after disable to that of the
    next enable of the same code; next-line means the next line that isn't blank; frontmatter the whole file."""
    out: list[tuple[str, int, int | None]] = []
    listed = (front or {}).get("mdpp-disable")
    for code in listed if isinstance(listed, list) else _codes(listed) if isinstance(listed, str) and listed else []:
        out.append((str(code), -1, None))
    if "mdpp-" not in source:
        return out
    lines = source.split("\n")
    opened: dict[str, int] = {}
    for i, text in enumerate(lines, 1):
        m = _COMMENT.search(text)
        if not m:
            continue
        for code in _codes(m[2]):
            if m[1] == "mdpp-disable":
                opened.setdefault(code, i)
            elif m[1] == "mdpp-enable":
                if code in opened:
                    out.append((code, opened.pop(code), i))
            else:
                target = next((k for k in range(i + 1, len(lines) + 1) if lines[k - 1].strip()), None)
                if target:
                    out.append((code, target - 1, target))
    return out + [(code, at, None) for code, at in opened.items()]
