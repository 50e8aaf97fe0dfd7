"""Code as HTML with classes, by tokens that most languages share: no grammar, so what a token means in a language's
own syntax isn't known. An unknown language stays plain."""

from __future__ import annotations

import re

from quillspark.functions.latex import escape

# Words that are keywords in every language that is coloured, operators and punctuation.
KEYWORDS = frozenset(
    ("and", "async", "await", "break", "case", "chan", "class", "const", "continue", "def", "default", "defer", "del", "elif", "else", "except", "export", "extends",
     "fallthrough", "finally", "for", "from", "func", "function", "go", "goto", "if", "import", "in", "interface", "is", "lambda", "let", "map", "new", "not", "or", "package",
     "pass", "raise", "range", "return", "select", "struct", "switch", "try", "type", "var", "while", "with", "yield")
)
OPERATORS = ("...", ":=", "==", "!=", "<=", ">=", "&&", "||", "**", "//", "+=", "-=", "*=", "/=", "<<", ">>", "+", "-", "*", "/", "%", "=", "<", ">", "!", "&", "|", "^", "~")
# How a line comment opens, by language name.
HASH = ("python", "py", "ruby", "rb", "sh", "bash", "shell", "yaml", "yml", "toml", "r", "perl", "makefile", "elixir")
SLASH = ("go", "golang", "javascript", "js", "typescript", "ts", "jsx", "tsx", "java", "c", "cpp", "c++", "csharp", "cs", "rust", "rs", "swift", "kotlin", "scala", "php", "dart", "zig", "json")
DASH = ("sql", "lua", "haskell", "hs", "ada")


def _pattern(comment: str, block: bool) -> re.Pattern:
    parts = [
        rf"(?P<comment>{comment}[^\n]*{'|/[*](?:.|\n)*?[*]/' if block else ''})",
        r"(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)",
        r"(?P<number>(?<![\w.])\d[\w.]*)",
        r"(?P<word>[^\W\d]\w*)(?P<call>(?=\s*\())?",
        "(?P<operator>" + "|".join(map(re.escape, OPERATORS)) + ")",
        r"(?P<punctuation>[(){}\[\],.:;])",
    ]
    return re.compile("|".join(parts))


_PATTERNS = {name: _pattern(mark, block) for names, mark, block in ((HASH, "#", False), (SLASH, "//", True), (DASH, "--", True)) for name in names}


def highlight(language: str, source: str) -> str | None:
    """HTML of the code, or None where nothing is known of its language."""
    pattern = _PATTERNS.get(language.lower())
    if pattern is None or not source:
        return None
    out, at = [], 0
    for m in pattern.finditer(source):
        kind = m.lastgroup
        if m["word"]:
            kind = "keyword" if m["word"] in KEYWORDS else "function" if m["call"] is not None else "type" if m["word"][0].isupper() else None
        if kind:
            out += [escape(source[at : m.start()]), f'<span class="hl-{kind}">{escape(m[0])}</span>']
            at = m.end()
    return "".join(out) + escape(source[at:]) if out else None
