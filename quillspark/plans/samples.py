"""Documents with their expected HTML and canonical source; @ stands for a nation's name.

Fixed values of the dialect: what each construct must become.
"""

# name, source, HTML with default options
HTML = (
    ("setext_heading", "@ plan\n=======\n", "<h1>@ plan</h1>\n"),
    ("closed_heading", "### @ ###\n", "<h3>@</h3>\n"),
    ("emphasis", "*a @* and **b @** and ***c @***\n", "<p><em>a @</em> and <strong>b @</strong> and <em><strong>c @</strong></em></p>\n"),
    ("strike", "~~@~~ kept\n", "<p><del>@</del> kept</p>\n"),
    ("sub_and_super", "H~2~O and x^2^ in @\n", "<p>H<sub>2</sub>O and x<sup>2</sup> in @</p>\n"),
    ("code_span", "`a < @`\n", "<p><code>a &lt; @</code></p>\n"),
    ("double_code_span", "``a ` @``\n", "<p><code>a ` @</code></p>\n"),
    ("inline_link", "[@](http://a.b/c \"T & U\")\n", "<p><a href=\"http://a.b/c\" title=\"T &amp; U\">@</a></p>\n"),
    ("reference_link", "[@][r] and [r]\n\n\n[r]: http://r.s \"Title\"\n", "<p><a href=\"http://r.s\" title=\"Title\">@</a> and <a href=\"http://r.s\" title=\"Title\">r</a></p>\n<p><a href=\"http://r.s\" title=\"Title\">r</a>: http://r.s &#34;Title&#34;</p>\n"),
    ("undefined_reference", "[@][nope]\n", "<p>@</p>\n"),
    ("image", "![@](i.png)\n", "<p><img src=\"i.png\" alt=\"@\" /></p>\n"),
    ("captioned_image", "![@](i.png \"A caption\")\n", "<p><figure><img src=\"i.png\" alt=\"@\" /><figcaption>A caption</figcaption></figure></p>\n"),
    ("autolink", "<https://a.b/@>\n", "<p><a href=\"https://a.b/@\">https://a.b/@</a></p>\n"),
    ("hard_breaks", "@\\\nb  \nc\n", "<p>@<br />\nb<br />\nc</p>\n"),
    ("escapes", "\\*@\\* \\[x\\] \\# \\`y\\`\n", "<p>*@* [x] # `y`</p>\n"),
    ("html_inline", "a <b>@</b> c\n", "<p>a &lt;b&gt;@&lt;/b&gt; c</p>\n"),
    ("html_block", "<div>\n@\n</div>\n", "&lt;div&gt;\n@\n&lt;/div&gt;\n"),
    ("entities", "@ & < > \" '\n", "<p>@ &amp; &lt; &gt; &#34; &#39;</p>\n"),
    ("indented_code", "    if @:\n        x\n", "<pre><code>if @:\n    x\n</code></pre>\n"),
    ("fenced_code", "```py\nprint(\"@\")\n```\n", "<pre><code class=\"language-py\">print(&#34;@&#34;)\n</code></pre>\n"),
    ("tilde_fence", "~~~\n``` @\n~~~\n", "<pre><code>``` @\n</code></pre>\n"),
    ("unclosed_fence", "```\n@\n", "<pre><code>@\n</code></pre>\n"),
    ("quote", "> @ one\n> two\n>\n> three\n", "<blockquote>\n<p>@ one\ntwo</p>\n<p>three</p>\n</blockquote>\n"),
    ("nested_quote", "> @\n> > inner\n", "<blockquote>\n<p>@</p>\n<blockquote>\n<p>inner</p>\n</blockquote>\n</blockquote>\n"),
    ("lazy_quote", "> @\nlazy\n", "<blockquote>\n<p>@\nlazy</p>\n</blockquote>\n"),
    ("bracketed_quote", "> [Title @] rest\n", "<blockquote>\n<p><strong>Title @</strong> rest</p>\n</blockquote>\n"),
    ("bullets", "- @\n- b\n  - c\n  - d\n", "<ul>\n<li><p>@</p></li>\n<li><p>b\n</p>\n<ul>\n<li><p>c</p></li>\n<li><p>d</p></li>\n</ul></li>\n</ul>\n"),
    ("ordered", "1. @\n2. b\n", "<ol>\n<li><p>@</p></li>\n<li><p>b</p></li>\n</ol>\n"),
    ("ordered_start", "3. @\n4. b\n", "<ol start=\"3\">\n<li><p>@</p></li>\n<li><p>b</p></li>\n</ol>\n"),
    ("ordered_parens", "1) @\n2) b\n", "<ol>\n<li><p>@</p></li>\n<li><p>b</p></li>\n</ol>\n"),
    ("tasks", "- [x] @\n- [ ] open\n", "<ul>\n<li class=\"task-list-item\"><input type=\"checkbox\" disabled checked />@</li>\n<li class=\"task-list-item\"><input type=\"checkbox\" disabled />open</li>\n</ul>\n"),
    ("rule", "@\n\n***\n\n---\n", "<p>@</p>\n<hr />\n<hr />\n"),
    ("table", "| A | @ |\n|:--|--:|\n| 1 | `x|y` |\n| *e* | |\n", "<div class=\"mdpp-table\">\n<table>\n<colgroup>\n<col style=\"text-align:left\" />\n<col style=\"text-align:right\" />\n</colgroup>\n<thead>\n<tr><th scope=\"col\" style=\"text-align:left\">A</th><th scope=\"col\" style=\"text-align:right\">@</th></tr>\n</thead>\n<tbody>\n<tr><td style=\"text-align:left\">1</td><td style=\"text-align:right\"><code>x|y</code></td></tr>\n<tr><td style=\"text-align:left\"><em>e</em></td><td style=\"text-align:right\"></td></tr>\n</tbody>\n</table>\n</div>\n"),
    ("plain_table", "| A |\n|---|\n| @ |\n", "<div class=\"mdpp-table\">\n<table>\n<thead>\n<tr><th scope=\"col\">A</th></tr>\n</thead>\n<tbody>\n<tr><td>@</td></tr>\n</tbody>\n</table>\n</div>\n"),
    ("footnote", "@[^n] text\n\n[^n]: A *note*.\n", "<p>@<sup><a class=\"footnote-ref\" href=\"#fn-n\" id=\"fnref-n\">[n]</a></sup> text</p>\n<section class=\"footnotes\"><ol><li id=\"fn-n\">A <em>note</em>. <a href=\"#fnref-n\">\\u21a9</a></li></ol></section>\n"),
    ("two_footnotes", "a[^x] b[^y] @\n\n[^y]: Y\n[^x]: X\n", "<p>a<sup><a class=\"footnote-ref\" href=\"#fn-x\" id=\"fnref-x\">[x]</a></sup> b<sup><a class=\"footnote-ref\" href=\"#fn-y\" id=\"fnref-y\">[y]</a></sup> @</p>\n<section class=\"footnotes\"><ol><li id=\"fn-x\">X <a href=\"#fnref-x\">\\u21a9</a></li></ol></section>\n<section class=\"footnotes\"><ol><li id=\"fn-y\">Y <a href=\"#fnref-y\">\\u21a9</a></li></ol></section>\n"),
    ("undefined_footnote", "@[^gone]\n", "<p>@<sup><a class=\"footnote-ref\" href=\"#fn-gone\" id=\"fnref-gone\">[gone]</a></sup></p>\n"),
    ("admonition", "> [!WARNING] Mind @\n> body\n", "<div class=\"admonition admonition-warning\"><p class=\"admonition-title\">Mind @</p><p>body</p>\n</div>\n"),
    ("plain_admonition", "> [!TIP]\n> @\n", "<div class=\"admonition admonition-tip\"><p class=\"admonition-title\">TIP</p><p>@</p>\n</div>\n"),
    ("container", ":::warning \"Mind @\" {#w .big}\ntext\n:::\n", "<div class=\"admonition admonition-warning big\" id=\"w\"><p class=\"admonition-title\">Mind @</p><p>text</p>\n</div>\n"),
    ("details", ":::details \"More @\"\nhidden\n:::\n", "<details class=\"mdpp-container mdpp-container-details\" data-mdpp-container=\"details\"><summary>More @</summary><p>hidden</p>\n</details>\n"),
    ("columns", "::::columns\n:::column\n@\n:::\n:::column\nright\n:::\n::::\n", "<div class=\"mdpp-container mdpp-container-columns\" data-mdpp-container=\"columns\"><div class=\"mdpp-container mdpp-col\" data-mdpp-container=\"column\"><p>@</p>\n</div>\n<div class=\"mdpp-container mdpp-col\" data-mdpp-container=\"column\"><p>right</p>\n</div>\n</div>\n"),
    ("own_container", ":::gadget {.x key=\"v\"}\n@\n:::\n", "<div class=\"mdpp-container mdpp-container-gadget x\" data-mdpp-container=\"gadget\"><p>@</p>\n</div>\n"),
    ("unclosed_container", ":::note\n@\n", "<div class=\"admonition admonition-note\"><p class=\"admonition-title\">NOTE</p><p>@</p>\n</div>\n"),
    ("math_inline", "$x^2 + @$\n", "<p><span class=\"math-inline\">x<sup></sup>+NATION<sub></sub></span></p>\n"),
    ("math_block", "$$\n\\frac{a}{b} \\leq \\alpha\n$$\n", "<div class=\"math-block\"><span class=\"math-frac\"><span class=\"math-frac-num\">a</span><span class=\"math-frac-den\">b</span></span>≤α</div>\n"),
    ("math_symbols", "$\\sum_{i} \\mathbb{R} \\rightarrow \\infty$ @\n", "<p><span class=\"math-inline\">∑<sub>i</sub>ℝ→∞</span> @</p>\n"),
    ("emoji", ":rocket: @ :nope:\n", "<p>🚀 @ :nope:</p>\n"),
    ("emoji_alias", ":thumbs_up: @ :+1:\n", "<p>👍 @ 👍</p>\n"),
    ("definitions", "Term @\n: one\n: two\n", "<dl>\n<dt>Term @</dt>\n<dd>one</dd>\n<dd>two</dd>\n</dl>\n"),
    ("contents", "[[toc]]\n\n# One\n\n## Two\n\n# Three\n\n@\n", "<nav class=\"mdpp-toc\" aria-label=\"Table of contents\">\n<ul>\n<li><a href=\"#one\">One</a><ul>\n<li><a href=\"#two\">Two</a></li>\n</ul></li>\n<li><a href=\"#three\">Three</a></li>\n</ul>\n</nav>\n<h1>One</h1>\n<h2>Two</h2>\n<h1>Three</h1>\n<p>@</p>\n"),
    ("embed", "[[embed:https://YouTube.com/watch?v=@]]\n", "<div class=\"mdpp-embed mdpp-embed-youtube\" data-src=\"https://YouTube.com/watch?v=@\" data-provider=\"youtube\"><a href=\"https://YouTube.com/watch?v=@\">https://YouTube.com/watch?v=@</a></div>\n"),
    ("generic_embed", "[[embed:https://example.org/@]]\n", "<div class=\"mdpp-embed mdpp-embed-generic\" data-src=\"https://example.org/@\" data-provider=\"generic\"><a href=\"https://example.org/@\">https://example.org/@</a></div>\n"),
    ("diagram", "```mermaid\nflowchart TD\n  A --> @\n```\n", "<figure class=\"mdpp-diagram mdpp-diagram-mermaid mdpp-diagram-flowchart\" data-diagram-syntax=\"mermaid\" data-diagram-kind=\"flowchart\"><pre><code class=\"language-mermaid\">flowchart TD\n  A --&gt; @\n</code></pre></figure>\n"),
    ("aliased_diagram", "```gantt\n@\n```\n", "<figure class=\"mdpp-diagram mdpp-diagram-mermaid mdpp-diagram-gantt\" data-diagram-syntax=\"mermaid\" data-diagram-kind=\"gantt\"><pre><code class=\"language-gantt\">@\n</code></pre></figure>\n"),
    ("frontmatter", "---\ntitle: @\nmdpp: 0.10\n---\nbody\n", "<p>body</p>\n"),
    ("crlf", "@\r\nb\r\n", "<p>@\nb</p>\n"),
    ("soft_break", "@\nb\n", "<p>@\nb</p>\n"),
    ("stitched_list", "- @\n\ntext\n\n- b\n", "<ul>\n<li><p>@</p>\n<p>text</p></li>\n<li><p>b</p></li>\n</ul>\n"),
    ("deep_list", "- a\n  - b\n    - c\n      - d\n        - e\n          - @\n", "<ul>\n<li><p>a\n</p>\n<ul>\n<li><p>b\n</p>\n<ul>\n<li><p>c\n</p>\n<ul>\n<li><p>d\n</p>\n<ul>\n<li><p>e\n</p>\n<ul>\n<li><p>@</p></li>\n</ul></li>\n</ul></li>\n</ul></li>\n</ul></li>\n</ul></li>\n</ul>\n"),
    ("jumping_list", "- a\n      - b\n          - c\n            - @\n", "- a\n      - b\n          - c\n            - @\n"),
    ("snake", "snake_case_@ 2*3*4\n", "<p>snake_case_@ 2<em>3</em>4</p>\n"),
    ("empty", "", ""),
    ("blank", " \n\n", ""),
)
# name, source, options, HTML
WITH_OPTIONS = (
    ("heading_ids", "# Über und Co\n\n# A  B\n", {"heading_ids": True}, "<h1 id=\"über-und-co\">Über und Co</h1>\n<h1 id=\"a-b\">A  B</h1>\n"),
    ("source_positions", "# one\n\ntext\n", {"source_positions": True}, "<h1 data-mdpp-source-start-byte=\"0\" data-mdpp-source-end-byte=\"6\" data-mdpp-source-start-line=\"1\" data-mdpp-source-start-col=\"1\" data-mdpp-source-end-line=\"2\" data-mdpp-source-end-col=\"1\">one</h1>\n<p data-mdpp-source-start-byte=\"7\" data-mdpp-source-end-byte=\"12\" data-mdpp-source-start-line=\"3\" data-mdpp-source-start-col=\"1\" data-mdpp-source-end-line=\"4\" data-mdpp-source-end-col=\"1\">text</p>\n"),
    ("hard_wraps", "@\nb\n", {"hard_wraps": True}, "<p>@<br />\nb</p>\n"),
    ("unsafe_html", "a <b>@</b>\n\n<div>\nx\n</div>\n", {"unsafe_html": True}, "<p>a <b>@</b></p>\n<div>\nx\n</div>\n"),
    ("wrap_emoji", ":rocket: @\n", {"wrap_emoji": True}, "<p><span class=\"emoji\" role=\"img\" aria-label=\"rocket\">🚀</span> @</p>\n"),
    ("raw_math", "$x$ @\n\n$$\ny\n$$\n", {"math": "raw"}, "<p>\\(x\\) @</p>\n\\[\ny\n\\]"),
    ("no_math", "$x$ @\n", {"math": "omit"}, "<p> @</p>\n"),
)
# name, source, canonical source
FORMAT = (
    ("setext", "@\n===\ntext\n", "# @\ntext\n"),
    ("closing_hashes", "## @ ##\n\n\n\nx\n", "## @\n\nx\n"),
    ("bullets", "* @\n+ b\n", "- @\n- b\n"),
    ("numbers", "1) @\n7) b\n", "1. @\n2. b\n"),
    ("emphasis", "__b__ and _@_ and a_b_c\n", "**b** and _@_ and a_b_c\n"),
    ("hard_break", "@  \nb\n", "@\\\nb\n"),
    ("task_marks", "- [X] @\n", "- [x] @\n"),
    ("fence", "~~~JS Key=1\n@\n~~~\n", "``` js key=1\n@\n```\n"),
    ("table", "|a|@|\n|:-|-:|\n|1|2|\n", "| a | @ |\n| :--- | ---: |\n| 1 | 2 |\n"),
    ("definitions", "@\n\n[b]: 2\n[a]: 1\n\ny\n", "@\n\ny\n\n[a]: 1\n[b]: 2\n"),
    ("footnotes_last", "[^z]: Z\n[^a]: A\n\n@[^a][^z]\n", "@[^a][^z]\n\n[^a]: A\n[^z]: Z\n"),
    ("admonition", "> [!note]   @\nlazy\n", "> [!NOTE] @\n> lazy\n"),
    ("directives", "[[ TOC ]]\n\n[[ embed : https://a.b/@ ]]\n", "[[toc]]\n\n[[embed:https://a.b/@]]\n"),
    ("unwrap", "@\ntwo  words\n", "@ two words\n"),
    ("code_kept", "```\n @  \n\n\n```\n", "```\n @  \n\n\n```\n"),
    ("container", ":::Note   \"@\"   {.b #i}\nx\n:::\n", ":::note \"@\" {#i .b}\nx\n:::\n"),
    ("nested_list", "- @\n    - b\n        - c\n", "- @\n  - b\n    - c\n"),
    ("renumber", "3. @\n3. b\n3. c\n", "3. @\n4. b\n5. c\n"),
    ("blank_lines", "@\n\n\n\nb\n\n\n", "@\n\nb\n"),
    ("html_kept", "<div  class=x>\n@\n</div>\n", "<div  class=x>\n@\n</div>\n"),
    ("math_kept", "$$\n_x_  @\n$$\n", "$$\n_x_  @\n$$\n"),
    ("frontmatter_kept", "---\ntitle:   @\n---\n# x\n", "---\ntitle:   @\n---\n# x\n"),
    ("trailing", "@   \n", "@\n"),
    ("empty", "", "\n"),
)
# name, source, findings as (code, message, line, column)
LINT = (
    ("list_markers", "- @\n* b\n", (("MD004", "unordered list markers are inconsistent", 1, 1),)),
    ("trailing_space", "@ \nb\n", (("MD009", "trailing whitespace", 1, 9),)),
    ("blank_run", "@\n\n\n\n\nb\n", (("MD012", "multiple consecutive blank lines", 4, 1), ("MD012", "multiple consecutive blank lines", 5, 1))),
    ("bare_url", "go to https://a.b/c now @\n", (("MD034", "bare URL should use explicit link syntax", 1, 7),)),
    ("empty_alt", "@\n\n![ ](x.png)\n", (("MD045", "image alt text is empty", 3, 1),)),
    ("emphasis_styles", "*@* _b_\n", (("MD049", "emphasis styles are inconsistent", 1, 1),)),
    ("undefined_footnote", "@[^a]\n", (("MDPP100", "undefined footnote reference [^a]", 1, 9),)),
    ("unused_footnote", "@\n\n[^a]: note\n", (("MDPP101", "footnote definition [^a] is never referenced", 3, 1),)),
    ("broken_anchor", "see [@](#nope)\n", (("MDPP102", "broken intra-doc link #nope", 1, 5),)),
    ("duplicate_heading", "# Same\n\n@\n\n# Same\n", (("MDPP103", "duplicate heading id #same", 5, 1),)),
    ("unknown_container", ":::foo\n@\n:::\n", (("MDPP104", "unknown container type :::foo", 1, 1),)),
    ("unused_definition", "@\n\n[a]: http://b.c\n", (("MDPP105", "link reference [a] is never used", 3, 1),)),
    ("undefined_reference", "[@][nope]\n", (("MDPP106", "reference link [nope] has no definition", 1, 1),)),
    ("newer_version", "---\ntitle: @\nmdpp: 9.0\n---\nx\n", (("MDPP107", "frontmatter mdpp version 9 is newer than parser 0.1", 1, 1),)),
    ("same_version", "---\ntitle: @\nmdpp: 0.10\n---\nx\n", ()),
    ("several_contents", "[[toc]]\n\n[[toc]]\n\n# @\n", (("MDPP108", "multiple [[toc]] directives", 3, 1),)),
    ("empty_contents", "[[toc]]\n\n@\n", (("MDPP109", "[[toc]] has no headings to populate", 1, 1),)),
    ("generic_embed", "[[embed:https://foo.org/@]]\n", (("MDPP110", "auto-embed provider is generic", 1, 1),)),
    ("known_embed", "[[embed:https://YOUTU.be/@]]\n", ()),
    ("malformed_embed", "[[embed:@]]\n", (("MDPP111", "auto-embed URL is malformed", 1, 1),)),
    ("heading_skip", "# @\n\n### B\n", (("MDPP200", "heading level skips from h1 to h3", 3, 1),)),
    ("autolink", "@ <https://a.b>\n", (("MDPP201", "autolink URL should use descriptive link text", 1, 11),)),
    ("empty_link", "@ [](http://x.y)\n", (("MDPP202", "link text is empty", 1, 10),)),
    ("headless_table", "|---|---|\n| @ | b |\n", (("MDPP203", "table without header row", 1, 1),)),
    ("fence_case", "```Go\n@\n```\n", (("MDPP300", "fence info-string should be lowercase", 1, 4),)),
    ("in_code", "```\nhttps://a.b @ \n\n\n\n\n```\n", (("MD009", "trailing whitespace", 2, 21),)),
    ("off_next_line", "<!-- mdpp-disable-next-line MD045 -->\n\n![](@.png)\n", ()),
    ("off_block", "<!-- mdpp-disable MDPP102 -->\n[@](#x)\n<!-- mdpp-enable MDPP102 -->\n\n[b](#y)\n", (("MDPP102", "broken intra-doc link #y", 5, 1),)),
    ("off_all", "<!-- mdpp-disable -->\n![](@.png)\n", ()),
    ("off_file", "---\nmdpp-disable: [MDPP200]\n---\n# @\n\n### B\n", ()),
    ("clean", "# @\n\nText.\n", ()),
)
# name, source, what stands where the pointer is, card (null: none)
HOVER = (
    ("contents", "[[toc]]\n\n# @\n\n## B\n", "[toc", "**[[toc]]**\n\nTable of contents generated from headings in this document. Currently lists 2 headings."),
    ("embed", "[[embed:https://vimeo.com/@]]\n", "vimeo", "**[[embed:]]**\n\nAuto-embed provider: `vimeo`.\n\nURL: `https://vimeo.com/@`\n\nWill render as: rich embed."),
    ("generic_embed", "[[embed:https://foo.org/@]]\n", "foo", "**[[embed:]]**\n\nAuto-embed provider: `generic`.\n\nURL: `https://foo.org/@`\n\nWill render as: generic link fallback."),
    ("container", ":::details\n@\n:::\n", "@", "**:::details**\n\nDisclosure block container."),
    ("own_container", ":::gadget\n@\n:::\n", "@", "**:::gadget**\n\nCustom block container."),
    ("admonition", "> [!TIP]\n> @\n", "@", "**[!TIP]**\n\nHelpful suggestion or shortcut."),
    ("heading", "text\n\n## Part @\n", "Part", "**Heading**\n\n`#part-%` · level 2\n\nPart @"),
    ("footnote", "x[^a]\n\n[^a]: Of @.\n", "^a]", "**Footnote `[^a]`**\n\nOf @."),
    ("undefined_footnote", "@[^a]\n", "^a", "*Undefined footnote `[^a]`.*"),
    ("footnote_definition", "x[^a]\n\n[^a]: Of @.\n", ": Of", "**Footnote definition `[^a]`**\n\nOf @."),
    ("undefined_reference", "[@][nope]\n", "nope", "*Undefined reference `nope`.*"),
    ("internal_link", "# Old\n\n[@](#old)\n", "#old", "**Internal link**\n\nTarget: `#old`\n\nOld"),
    ("link", "a [b](http://c.d/@)\n", "http", "**Link**\n\n`http://c.d/@`"),
    ("image", "![@](i.png)\n", "i.png", "**Image**\n\nAlt: `@`\n\nSource: `i.png`"),
    ("math", "a $x+y$ @\n", "x+", "**Inline math**\n\n```tex\nx+y\n```"),
    ("math_block", "$$\nx\n$$\n", "x", "**Display math**\n\n```tex\nx\n```"),
    ("emoji", "@ :rocket: b\n", "rocket", "🚀 `:rocket:`"),
    ("code", "```py\n@\n```\n", "@", "**Code block**"),
    ("text", "plain @\n", "plain", None),
)
# source, what stands where the pointer is, definition and references as (role, text of the place)
PLACES = (
    ("anchor", "# Intro\n\nSee [@](#intro) twice [b](#intro).\n", "#intro", "# Intro\n", (("def", "# Intro\n"), ("use", "[@](#intro)"), ("use", "[b](#intro)"))),
    ("footnote", "@[^a] and[^a]\n\n[^a]: Note.\n", "^a", "[^a]: Note.\n", (("def", "[^a]: Note.\n"), ("use", "[^a]"), ("use", "[^a]"))),
    ("label", "[@][ref] and [ref]\n\n\n[ref]: /x\n", "ref]", "[ref]: /x", (("def", "[ref]: /x"), ("use", "[ref]"), ("use", "[ref]"))),
    ("definition_itself", "# Own\n\n[@](#own)\n", "Own", "# Own\n", (("def", "# Own\n"), ("use", "[@](#own)"))),
    ("undefined", "[@][gone]\n", "gone", None, (("use", "[@][gone]"),)),
)
# source, what is renamed, new name, source after the rename
RENAMES = (
    ("heading", "# Old\n\n[@](#old)\n", "Old", "New name", "# New name\n\n[@](#new-name)\n"),
    ("anchor", "# Old\n\n[@](#old)\n", "#old", "Other", "# Other\n\n[@](#other)\n"),
    ("footnote", "@[^a]\n\n[^a]: n\n", "^a", "z9", "@[^z9]\n\n[^z9]: n\n"),
    ("label", "[@][ref]\n\n\n[ref]: /x\n", "ref]", "to", "[@][to]\n\n\n[to]: /x\n"),
)
# source, the text before the pointer, items as (label, insert)
COMPLETIONS = (
    ("footnotes", "@ [^o\n\n[^one]: 1\n[^other]: 2\n[^two]: 3\n", "@ [^o", (("one", "one]"), ("other", "other]"))),
    ("labels", "See [intro][\n\n[intro]: /@\n[other]: /o\n", "[intro][", (("intro", "intro]"), ("other", "other]"))),
    ("short_label", "@ [int\n\n[intro]: /i\n[other]: /o\n", "[int", (("intro", "intro]"),)),
    ("anchors", "# One\n\n# Two\n\n[@](#o\n", "(#o", (("#one", "one"),)),
    ("containers", "@\n\n:::\n", "@\n\n:::", tuple((n, n + "\n${0}\n:::") for n in ("note", "tip", "warning", "caution", "important", "info", "details", "aside", "columns", "column"))),
    ("admonitions", "@\n\n> [!\n", "> [!", tuple((n, n + "]") for n in ("NOTE", "TIP", "WARNING", "CAUTION", "IMPORTANT"))),
    ("directives", "@\n\n[[\n", "@\n\n[[", (("[[toc]]", "[[toc]]"), ("[[embed:]]", "[[embed:${1:https://example.com}]]"))),
    ("in_embed", "[[embed:@\n", "[[embed:", ()),
    ("frontmatter", "---\ntitle: @\nti\nthird: 3\n---\nx\n", "\nti\n", ()),
    ("frontmatter_keys", "---\nthird: 3\n\n---\n@\n", "---\nt", (("tags", "tags: "), ("third", "third: "), ("title", "title: "))),
    ("emoji", "@ :sweat_s\n", ":sweat_s", (("sweat_smile", "sweat_smile:"),)),
    ("nothing", "plain @\n", "plain", ()),
)
# source, folds as (first line, last line, kind)
FOLDS = (
    ("all", "---\ntitle: @\n---\n# A\n\n```\nx\n```\n\n## B\n\n> q\n> r\n\n- a\n- b\n\n:::note\nc\n:::\n\n> [!TIP]\n> d\n\n| h |\n|---|\n| c |\n\n# C\n\nend\n",
     ((1, 3, "comment"), (4, 28, "region"), (6, 8, "region"), (10, 28, "region"), (12, 13, "region"), (15, 16, "region"), (18, 20, "region"), (22, 23, "region"), (25, 27, "region"), (29, 31, "region"))),
)
# source, symbols as (kind, name, number of the heading, number of the heading above)
SYMBOLS = (
    ("all", "---\ntitle: @\n---\n# A\n\n## B\n\n:::note\nx[^n]\n:::\n\n# C\n\n[^n]: N\n", (("Frontmatter", "frontmatter", None, None), ("Heading", "A", 1, None), ("Heading", "B", 2, 1), ("Heading", "C", 3, None), ("ContainerDirective", ":::note", None, None), ("FootnoteDef", "[^n]", None, None))),
)
# source, tokens as (line, start, length, type, modifiers)
TOKENS = (
    ("frontmatter", "---\ntitle: Hello\n---\nx @\n", ((1, 0, 5, "frontmatterKey", 0), (1, 7, 5, "frontmatterValue", 0))),
    ("heading", "## é😀 b ##\n\n@\n", ((0, 3, 5, "heading", 2),)),
    ("quote", "x\n\n> quote @\n", ((2, 0, 2, "comment", 0),)),
    ("list", "- item @\n- [x] done\n", ((0, 0, 2, "operator", 0), (1, 2, 3, "taskMarker", 65536))),
    ("table", "| H | B |\n|---|---|\n| x | @ |\n", ((0, 2, 1, "tableHeader", 0), (0, 6, 1, "tableHeader", 0), (1, 0, 9, "tableSeparator", 0), (2, 2, 1, "string", 0), (2, 6, 8, "string", 0))),
    ("code", "`c` @\n\n```go\nx\n```\n", ((0, 0, 3, "string", 64), (2, 0, 5, "string", 4096), (3, 0, 1, "string", 4096), (4, 0, 3, "string", 4096))),
    ("links", "[a](b) [@][gone] ![i](j)\n", ((0, 0, 6, "link", 576), (0, 7, 16, "link", 1152), (0, 24, 7, "imageAlt", 0))),
    ("marks", "*a* **b** ~~c~~ $m$ :rocket: @\n", ((0, 0, 3, "emphasis", 8192), (0, 4, 5, "emphasis", 16384), (0, 10, 5, "strikethrough", 0), (0, 16, 3, "math", 64), (0, 20, 8, "emojiShortcode", 0))),
    ("directives", "[[toc]]\n\n[[embed:https://a.b]]\n\n# @\n", ((0, 0, 7, "directive", 262144), (2, 0, 8, "directive", 524288), (2, 8, 11, "directiveArgument", 524288), (4, 2, 8, "heading", 1))),
    ("containers", ":::note\n@\n:::\n\n> [!TIP]\n> x\n", ((0, 3, 4, "containerType", 0), (4, 4, 3, "admonitionType", 0))),
    ("footnotes", "@[^a]\n\n[^a]: n\n", ((0, 8, 4, "footnote", 128), (2, 0, 4, "footnote", 2048))),
)
# source, asked-for kinds, actions as (title, kind, new text)
ACTIONS = (
    ("all", "@  \n[a][gone] x[^n]\n\n[u]: /u\n", ("quickfix",), (("Fix MD009: trailing whitespace", "quickfix", ""), ("Fix MDPP105: link reference [u] is never used", "quickfix", ""), ("Create missing reference definition", "quickfix", "\n[gone]: "), ("Create missing footnote definition", "quickfix", "\n[^n]: "))),
    ("inline", "[@][r] end\n\n\n[r]: /x \"T\"\n", ("quickfix",), (("Convert reference link to inline link", "quickfix", "[@](/x \"T\")"),)),
    ("fix_all", "@\n=====\n", ("source.fixAll",), (("Format document with mdpp", "source.fixAll.mdpp", "# @\n"),)),
    ("other_kind", "@\n=====\n", ("refactor",), ()),
)
