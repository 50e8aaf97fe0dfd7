"""Parser, renderer and formatter on single documents."""

import random

import pytest

from quillspark.functions import frontmatter
from quillspark.functions.blocks import parse, read
from quillspark.functions.fmt import format_source
from quillspark.functions.latex import latex
from quillspark.functions.render import Options, render, utf8
from quillspark.functions.tokens import encoded, tokens
from quillspark.plans.nodes import Places, flat


def html(src, **options):
    root, low, _ = parse(src)
    return render(root, low, Options(**options))


HTML = [
    ("# Plan\n\nText *em* **strong** ~~gone~~ `code`.\n", "<h1>Plan</h1>\n<p>Text <em>em</em> <strong>strong</strong> <del>gone</del> <code>code</code>.</p>\n"),
    ("Plan\n====\n", "<h1>Plan</h1>\n"),
    ("a H~2~O x^2^\n", "<p>a H<sub>2</sub>O x<sup>2</sup></p>\n"),
    ("[t](http://a.b \"T\") ![alt](i.png) <http://c.d>\n", '<p><a href="http://a.b" title="T">t</a> <img src="i.png" alt="alt" /> <a href="http://c.d">http://c.d</a></p>\n'),
    ("![a](b.png \"cap\")\n", '<p><figure><img src="b.png" alt="a" /><figcaption>cap</figcaption></figure></p>\n'),
    ("3. x\n4. y\n", '<ol start="3">\n<li><p>x</p></li>\n<li><p>y</p></li>\n</ol>\n'),
    ("- [x] done\n- [ ] open\n", '<ul>\n<li class="task-list-item"><input type="checkbox" disabled checked />done</li>\n<li class="task-list-item"><input type="checkbox" disabled />open</li>\n</ul>\n'),
    ("> quoted\n> more\n", "<blockquote>\n<p>quoted\nmore</p>\n</blockquote>\n"),
    ("> [Title] rest\n", "<blockquote>\n<p><strong>Title</strong> rest</p>\n</blockquote>\n"),
    ("> [!TIP]\n> body\n", '<div class="admonition admonition-tip"><p class="admonition-title">TIP</p><p>body</p>\n</div>\n'),
    ("```py\na < b\n```\n", '<pre><code class="language-py">a &lt; b\n</code></pre>\n'),
    ("    code\n", "<pre><code>code\n</code></pre>\n"),
    ("***\n", "<hr />\n"),
    ("a\\\nb  \nc\n", "<p>a<br />\nb<br />\nc</p>\n"),
    ("note[^a]\n\n[^a]: text\n", '<p>note<sup><a class="footnote-ref" href="#fn-a" id="fnref-a">[a]</a></sup></p>\n<section class="footnotes"><ol><li id="fn-a">text <a href="#fnref-a">\\u21a9</a></li></ol></section>\n'),
    ("Term\n: one\n: two\n", "<dl>\n<dt>Term</dt>\n<dd>one</dd>\n<dd>two</dd>\n</dl>\n"),
    (":rocket: :nope:\n", "<p>🚀 :nope:</p>\n"),
    ("<b>x</b>\n", "<p>&lt;b&gt;x&lt;/b&gt;</p>\n"),
    ("---\ntitle: x\n---\nbody\n", "<p>body</p>\n"),
    ("snake_case_word and 2*3*4\n", "<p>snake_case_word and 2<em>3</em>4</p>\n"),
    ("Ünï *ç*\n", "<p>Ünï <em>ç</em></p>\n"),
]


@pytest.mark.parametrize(("src", "want"), HTML)
def test_html(src, want):
    assert html(src) == want


def test_options():
    assert html("# A b\n", heading_ids=True) == '<h1 id="a-b">A b</h1>\n'
    assert html("a\nb\n", hard_wraps=True) == "<p>a<br />\nb</p>\n"
    assert html("<b>x</b>\n", unsafe_html=True) == "<p><b>x</b></p>\n"
    assert html("$x$\n", math="raw") == "<p>\\(x\\)</p>\n"
    assert html("$x$\n", math="omit") == "<p></p>\n"
    assert 'data-mdpp-source-start-line="3"' in html("a\n\nb\n", source_positions=True)
    assert html("![a](b)\n", image_resolver=lambda s: f"/cdn/{s}") == '<p><img src="/cdn/b" alt="a" /></p>\n'


def test_math():
    assert latex(r"\frac{a}{b} + \sqrt{x_{1}} \alpha \mathbb{R}") == '<span class="math-frac"><span class="math-frac-num">a</span><span class="math-frac-den">b</span></span>+<span class="math-sqrt">√<span class="math-sqrt-inner">x<sub>1</sub></span></span>αℝ'
    assert latex(r"\unknown{x}") == r"\unknown(x)"


@pytest.mark.parametrize("src", ["<script>alert(1)</script>\n", "[x](javascript:alert(1))\n\n<script>\n", ":::note \"<script>\"\nx\n:::\n", "| <script> |\n|---|\n| <script> |\n", "> [!NOTE] <script>\n", "```<script>\n<script>\n```\n", "$<script>$\n", "[^<script>]: x\n", "[[embed:https://a.b/<script>]]\n"])
def test_scripts_are_escaped(src):
    assert "<script" not in html(src)


def test_containers():
    root, _, found = parse(":::outer\n:::note \"T\" {#i .a .b k=\"v\"}\ntext\n:::\n:::\n")
    outer = root.children[0]
    assert outer.attrs["name"] == "outer" and not found
    assert outer.children[0].attrs == {"name": "note", "raw": '"T" {#i .a .b k="v"}', "id": "i", "class": "a b", "attrs": '{"k":"v"}', "title": "T"}
    assert parse(":::note\nnever closed\n")[2][0][0] == "MDPP-PARSE-002"
    assert parse("```\n:::note\n```\n")[0].children[0].type == "CodeBlock"


@pytest.mark.parametrize(("text", "want"), [
    ("title: x\nmdpp: 0.10", {"title": "x", "mdpp": 0.1}), ("tags:\n  - go\n  - b: 1\n    c: 2", {"tags": ["go", {"b": 1, "c": 2}]}), ("a:\n  b: c", {"a": {"b": "c"}}), ("t: [a, 'b c', {d: e}] # no", {"t": ["a", "b c", {"d": "e"}]}),
    ("a: |\n  x\n  y\nb: >-\n  p\n  q", {"a": "x\ny\n", "b": "p q"}), ("u: http://x.y/z", {"u": "http://x.y/z"}), ("n: -3\nf: 1e3\nt: true\nz: ~\ns: '1'\nh: 0x1F", {"n": -3, "f": 1000.0, "t": True, "z": None, "s": "1", "h": 31}), ("# only", None), ("", None),
])
def test_frontmatter(text, want):
    assert frontmatter.load(text) == want


@pytest.mark.parametrize("text", [": garbage :: invalid", "title: [a", "just text", "a: 1\na: 2", "a:\n\tb: c", "a: b: c", 'a: "b', "a: *x", "- a\n- b", "a: 1\n  b: 2"])
def test_refused_frontmatter(text):
    with pytest.raises(frontmatter.Malformed):
        frontmatter.load(text)
    assert not any(n.type == "Frontmatter" for n in parse(f"---\n{text}\n---\nbody\n")[0].walk())


def test_emoji_names_and_aliases():
    assert html(":joy: :heart_eyes: :sob: :thumbs_up: :flag-de: :squirrel:\n") == "<p>😂 😍 😭 👍 🇩🇪 🐿️</p>\n"
    assert render(*parse(":own:\n", {"own": "O"})[:2]) == "<p>O</p>\n"


def test_whole_document_forms():
    quoted = parse("> a\n> > b\n")[0]
    assert quoted.children[0].type == "Blockquote" and all(n.start < 0 for n in quoted.children[0].walk() if n is not quoted.children[0])
    assert parse("- a\n      - b\n          - c\n            - d\n")[2][0][0] == "MDPP-PARSE-000"
    deep = parse("".join("  " * i + f"- l{i}\n" for i in range(8)))[0]
    assert sum(n.type == "List" for n in deep.walk()) == 8


def test_long_paragraphs_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        src = "\n".join(f"line {i} of *some* text" for i in range(n))
        began = time.process_time()
        root = parse(src)[0]
        took.append(time.process_time() - began)
        assert root.children[0].end == len(src) + 1
    assert took[1] < 8 * took[0] + 0.5


def test_tokens_encode_as_five_numbers():
    found = tokens(read("# é😀\n\n*a* `b`\n"))
    assert encoded(found) == [0, 2, 3, 5, 1, 2, 0, 3, 15, 8192, 0, 4, 3, 1, 64]
    assert tokens(read("# A\n\n# B\n"), 4) == [(2, 2, 1, "heading", 1)]


def test_toc_nests_by_level():
    assert html("[[TOC]]\n\n## A\n\n#### B\n\n## C\n").split("</nav>")[0].count("<ul>") == 2


ODD = ["", " ", "\n\n", "no feed", "a\r\nb\rc", "﻿# bom", "中文 العربية é 𝔸\n", "x" * 50_000, "# " * 500, "> " * 60 + "deep\n", "- a\n" * 300, "```\nunclosed", ":::x\n" * 20, "$$$$ $$$\n", "&&& &amp;\n", "[" * 300 + "\n", "*" * 300 + "a\n", "| a |\n|---|\n" * 40, "a b\x0bc d\n", "[a]: b\n[a]: c\n\n[a]\n", "".join(f"x[^{i}] " for i in range(200)) + "\n\n" + "".join(f"[^{i}]: n\n" for i in range(150))]


@pytest.mark.parametrize("src", ODD)
def test_odd_documents_parse(src):
    root, low, found = parse(src)
    assert not [f for f in found if f[0] == "MDPP-PARSE-000"]
    rows = flat(root, Places(low))
    assert rows[0]["last_desc"] == len(rows) - 1
    for r in rows[1:]:
        p = rows[r["parent_id"]]
        assert p["node_id"] < r["node_id"] <= p["last_desc"] and r["depth"] == p["depth"] + 1
    render(root, low)


def test_ranges_hold_their_text():
    src = "# Hello é\n\nSome *em* and [link](http://x.y) `c`.\n\n- item **b**\n"
    root, low, _ = parse(src)
    found = {(n.type, utf8(low[n.start : n.end])) for n in root.walk() if n.start >= 0}
    assert {("Heading", "# Hello é\n"), ("Emphasis", "*em*"), ("Link", "[link](http://x.y)"), ("CodeSpan", "`c`"), ("Strong", "**b**"), ("Paragraph", "Some *em* and [link](http://x.y) `c`.\n")} <= found


FORMAT = [
    ("Title\n=====\ntext\n", "# Title\ntext\n"),
    ("## End ##\n\n\n\nx\n", "## End\n\nx\n"),
    ("* a\n+ b\n", "- a\n- b\n"),
    ("1) a\n7) b\n", "1. a\n2. b\n"),
    ("__b__ and _e_ and a_b_c\n", "**b** and *e* and a_b_c\n"),
    ("a  \nb\n", "a\\\nb\n"),
    ("- [X] t\n", "- [x] t\n"),
    ("~~~JS Key=1\nx\n~~~\n", "``` js key=1\nx\n```\n"),
    ("|a|b|\n|:-|-:|\n|1|2|\n", "| a | b |\n| :--- | ---: |\n| 1 | 2 |\n"),
    ("x\n\n[b]: 2\n[a]: 1\n\ny\n", "x\n\ny\n\n[a]: 1\n[b]: 2\n"),
    ("> [!note]   T\nlazy\n", "> [!NOTE] T\n> lazy\n"),
    ("[[ TOC ]]\n", "[[toc]]\n"),
    ("one\ntwo  words\n", "one two words\n"),
    ("```\n keep  \n\n\n```\n", "```\n keep  \n\n\n```\n"),
    ("", "\n"),
]


@pytest.mark.parametrize(("src", "want"), FORMAT)
def test_format(src, want):
    assert format_source(src) == want


def test_formatting_twice_changes_nothing():
    r = random.Random(8)
    parts = ["# h\n", "text _x_\n", "\n", "\n\n\n", "* a\n", "  * b\n", "1) n\n", "> q\n", "```Go\nx\n```\n", "| a|b |\n|---|:-:|\n| 1|2|\n", "[r]: u\n", "[^f]: n\n", "$$\nx\n$$\n", "line  \nnext\n", ":::note\nin\n:::\n", "<div>\n"]
    for _ in range(300):
        once = format_source("".join(r.choice(parts) for _ in range(r.randint(1, 9))))
        assert format_source(once) == once
