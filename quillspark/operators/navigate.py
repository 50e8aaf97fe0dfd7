"""Editor queries as DataFrame queries over parsed documents: positions, definitions, references, renames,
folding, symbols, completion, code actions and semantic tokens. Queries that take positions take a
DataFrame of them, so one run answers for any number of documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.blocks import read
from quillspark.functions.columns import attr, label, slugify
from quillspark.functions.tokens import tokens
from quillspark.functions.vocabulary import FRONTMATTER_KEYS
from quillspark.operators import convert
from quillspark.operators import lint as linter
from quillspark.operators.extract import of_type, once
from quillspark.plans import nodes as plans
from quillspark.plans.store import kept


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text: characters, and one more for each outside the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def to_offsets(parsed: DataFrame, positions: DataFrame) -> DataFrame:
    """positions(doc_id, line, character): + offset in bytes. line and character count from 0, characters in
    UTF-16; inside a pair the character's start, past the end the line's end."""
    lines = plans.lines(parsed).select("doc_id", (F.col("line_no") - 1).alias("line"), "start_byte", "text")
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    walked = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("units"), F.lit(0).alias("bytes")),
        lambda acc, c: F.when(acc["units"] + utf16_length(c) <= F.col("character"), F.struct((acc["units"] + utf16_length(c)).alias("units"), (acc["bytes"] + F.octet_length(c)).alias("bytes"))).otherwise(F.struct(F.lit(1_000_000_000).alias("units"), acc["bytes"].alias("bytes"))),
        lambda acc: acc["bytes"],
    )
    return positions.join(lines, ["doc_id", "line"]).select(*positions.columns, (F.col("start_byte") + walked).alias("offset"))


def to_positions(parsed: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets(doc_id, offset): + line and character from 0. The line is the last that starts at or before the offset."""
    lines = plans.lines(parsed).select("doc_id", "line_no", "start_byte", "end_byte", "text")
    hit = offsets.join(lines, "doc_id").where((F.col("start_byte") <= F.col("offset")) & (F.col("offset") <= F.col("end_byte")))
    before = F.decode(F.substring(F.encode("text", "utf-8"), F.lit(1), F.col("offset") - F.col("start_byte")), "utf-8")
    return hit.select(*offsets.columns, (F.col("line_no") - 1).alias("line"), utf16_length(before).alias("character"))


def _holds(n: Column, size: Column) -> Column:
    """Whether a node's range holds the row's offset; at the end of the text ranges are closed."""
    r = n["range"]
    return r.isNotNull() & (r["start_byte"] <= F.col("offset")) & ((F.col("offset") < r["end_byte"]) | ((F.col("offset") == size) & (r["end_byte"] == size)))


# What hover says of admonitions and containers.
ADMONITION_TEXT = {
    "NOTE": "Context or supporting detail.",
    "TIP": "Helpful suggestion or shortcut.",
    "WARNING": "Risk or important caveat.",
    "CAUTION": "Potentially destructive or surprising behavior.",
    "IMPORTANT": "Information the reader should not miss.",
}
CONTAINER_TEXT = {
    "note": "Admonition-style note container.",
    "tip": "Admonition-style tip container.",
    "warning": "Admonition-style warning container.",
    "caution": "Admonition-style caution container.",
    "important": "Admonition-style important container.",
    "info": "Informational block container.",
    "details": "Disclosure block container.",
    "aside": "Secondary aside content.",
    "columns": "Column layout container.",
    "column": "Column layout container.",
}


def _named(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(other))


def card(n: Column) -> Column:
    """What hover shows of a node of the row's own array, in Markdown; null where it has no card."""
    a = lambda k: F.coalesce(F.element_at(n["attrs"], k), F.lit(""))
    text, kind = F.coalesce(n["text"], F.lit("")), n["type"]
    say = lambda form, *values: F.format_string(form, *values)
    last_text = lambda found: F.element_at(found, -1)["text"]
    notes = F.filter("nodes", lambda x: (x["type"] == "FootnoteDef") & (F.element_at(x["attrs"], "id") == a("id")))
    targets = F.filter("nodes", lambda x: (x["type"] == "Heading") & (F.concat(F.lit("#"), slugify(F.coalesce(x["text"], F.lit("")))) == a("href")))
    headings = F.size(F.filter("nodes", lambda x: x["type"] == "Heading"))
    embed = F.when(a("provider") == "generic", "generic link fallback").otherwise("rich embed")
    return (
        F.when(kind == "TableOfContents", say("**[[toc]]**\n\nTable of contents generated from headings in this document. Currently lists %d headings.", headings))
        .when(kind == "AutoEmbed", say("**[[embed:]]**\n\nAuto-embed provider: `%s`.\n\nURL: `%s`\n\nWill render as: %s.", a("provider"), a("src"), embed))
        .when(kind == "ContainerDirective", say("**:::%s**\n\n%s", a("name"), _named(CONTAINER_TEXT, F.lower(a("name")), "Custom block container.")))
        .when(kind == "Admonition", say("**[!%s]**\n\n%s", F.upper(a("type")), _named(ADMONITION_TEXT, F.upper(a("type")), "Custom admonition type.")))
        .when(kind == "Heading", say("**Heading**\n\n`#%s` \u00b7 level %s\n\n%s", slugify(text), a("level"), text))
        .when((kind == "FootnoteRef") & (F.size(notes) > 0), say("**Footnote `[^%s]`**\n\n%s", a("id"), F.trim(last_text(notes))))
        .when(kind == "FootnoteRef", say("*Undefined footnote `[^%s]`.*", a("id")))
        .when(kind == "FootnoteDef", say("**Footnote definition `[^%s]`**\n\n%s", a("id"), F.trim(text)))
        .when((kind == "Link") & (a("ref") != "") & (a("href") != ""), say("**Reference link `%s`**\n\n%s", a("ref"), a("href")))
        .when((kind == "Link") & (a("ref") != ""), say("*Undefined reference `%s`.*", a("ref")))
        .when((kind == "Link") & a("href").startswith("#") & (F.size(targets) > 0), say("**Internal link**\n\nTarget: `%s`\n\n%s", a("href"), last_text(targets)))
        .when((kind == "Link") & (a("href") != ""), say("**Link**\n\n`%s`", a("href")))
        .when(kind == "Image", say("**Image**\n\nAlt: `%s`\n\nSource: `%s`", a("alt"), a("src")))
        .when(kind == "MathInline", say("**Inline math**\n\n```tex\n%s\n```", F.trim(n["literal"])))
        .when(kind == "MathBlock", say("**Display math**\n\n```tex\n%s\n```", F.trim(F.regexp_replace(n["literal"], r"^\n+|\n+$", ""))))
        .when(kind == "Emoji", say("%s `:%s:`", n["literal"], a("code")))
        .when(kind == "CodeBlock", F.lit("**Code block**"))
    )


def hover(parsed: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, offset, type, card: of the deepest node with a card that holds the offset; found inside the document's row."""
    rows = parsed.select("doc_id", "source", "nodes").join(offsets, "doc_id")
    path = F.filter("nodes", lambda n: _holds(n, F.octet_length("source")))
    cards = F.filter(F.transform(path, lambda n: F.struct(n["depth"].alias("depth"), n["type"].alias("type"), card(n).alias("card"))), lambda c: c["card"].isNotNull())
    return rows.select("doc_id", "offset", F.array_max(cards).alias("c")).where("c is not null").select("doc_id", "offset", "c.type", "c.card")


def symbols(parsed: DataFrame) -> DataFrame:
    """doc_id, source, symbols: every named place of each document as an array of (kind: anchor, label, footnote; name; role: def,
    use; start_byte, end_byte), made from the row's own nodes, link definitions and their uses without a join."""
    place = lambda kind, name, role, r: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(role).alias("role"), r["start_byte"].alias("start_byte"), r["end_byte"].alias("end_byte"))
    a = lambda n, k: F.coalesce(F.element_at(n["attrs"], k), F.lit(""))
    of = lambda *types: F.filter("nodes", lambda n: n["type"].isin(*types) & n["range"].isNotNull())
    anchors = F.transform(of("Heading"), lambda n: place("anchor", slugify(F.coalesce(n["text"], F.lit(""))), "def", n["range"]))
    to_anchors = F.transform(F.filter(of("Link"), lambda n: a(n, "href").startswith("#")), lambda n: place("anchor", F.substring(a(n, "href"), 2, 1 << 20), "use", n["range"]))
    notes = F.transform(of("FootnoteDef"), lambda n: place("footnote", a(n, "id"), "def", n["range"]))
    to_notes = F.transform(of("FootnoteRef"), lambda n: place("footnote", a(n, "id"), "use", n["range"]))
    defs = F.transform("links", lambda d: F.struct(F.lit("label").alias("kind"), d["label"].alias("name"), F.lit("def").alias("role"), d["start_byte"].alias("start_byte"), (d["end_byte"] - 1).alias("end_byte")))
    unresolved = F.transform(F.filter(of("Link", "Image"), lambda n: a(n, "ref") != ""), lambda n: place("label", label(a(n, "ref")), "use", n["range"]))
    uses = F.transform("uses", lambda u: F.struct(F.lit("label").alias("kind"), u["label"].alias("name"), F.lit("use").alias("role"), u["start_byte"].alias("start_byte"), u["end_byte"].alias("end_byte")))
    return parsed.select("doc_id", "source", F.array_distinct(F.concat(anchors, to_anchors, notes, to_notes, defs, unresolved, uses)).alias("symbols"))


def symbols_used(parsed: DataFrame) -> DataFrame:
    """doc_id, kind, name, role, start_byte, end_byte: a row for each of `symbols`."""
    return symbols(parsed).select("doc_id", F.inline("symbols"))


def _under(parsed: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets with source, symbols and s, the narrowest symbol that holds the offset; one join, by document."""
    hits = F.filter("symbols", lambda x: (x["start_byte"] <= F.col("offset")) & (F.col("offset") < x["end_byte"]))
    ranked = F.array_min(F.transform(hits, lambda x: F.struct((x["end_byte"] - x["start_byte"]).alias("n"), x["start_byte"].alias("at"), x["kind"].alias("kind"), x["name"].alias("name"))))
    return symbols(parsed).join(offsets, "doc_id").withColumn("s", ranked).where("s is not null")


def _same(role: str | None = None) -> Column:
    """The symbols that have the kind and name of what stands under the offset."""
    return F.filter("symbols", lambda x: (x["kind"] == F.col("s.kind")) & (x["name"] == F.col("s.name")) & (F.lit(True) if role is None else x["role"] == role))


def definition(parsed: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, offset, kind, name, start_byte, end_byte of what is defined under each offset; a definition is its own."""
    first = F.array_min(F.transform(_same("def"), lambda x: F.struct(x["start_byte"].alias("start_byte"), x["end_byte"].alias("end_byte"))))
    rows = _under(parsed, offsets).withColumn("r", first).where("r is not null")
    return rows.select("doc_id", "offset", "s.kind", "s.name", "r.start_byte", "r.end_byte")


def references(parsed: DataFrame, offsets: DataFrame, declaration: bool = True) -> DataFrame:
    """doc_id, offset, kind, name, role, start_byte, end_byte: all places of what stands under each offset."""
    return _under(parsed, offsets).select("doc_id", "offset", F.inline(_same() if declaration else _same("use"))).select("doc_id", "offset", "kind", "name", "role", "start_byte", "end_byte")


def prepare_rename(parsed: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, offset, start_byte, end_byte: what a rename at each offset would replace there; nothing where nothing has a name."""
    edits = rename(parsed, offsets.withColumn("new_name", F.lit("")))
    near = F.min_by(F.struct("start_byte", "end_byte"), F.struct(F.abs(F.col("start_byte") - F.col("offset")).alias("d"), F.col("start_byte")))
    return edits.groupBy("doc_id", "offset").agg(near.alias("r")).select("doc_id", "offset", "r.start_byte", "r.end_byte")


def rename(parsed: DataFrame, targets: DataFrame) -> DataFrame:
    """Edits for targets(doc_id, offset, new_name): doc_id, offset, start_byte, end_byte, new_text. In each place only the
    name is replaced; anchors follow the new heading's slug."""
    places = _under(parsed, targets).select("doc_id", "offset", "new_name", "source", F.inline(_same()))
    own = F.decode(F.expr("substring(encode(source, 'utf-8'), start_byte + 1, end_byte - start_byte)"), "utf-8")
    rows = places.withColumn("own", own).drop("source")
    old = F.when((F.col("kind") == "anchor") & (F.col("role") == "def"), F.trim(F.regexp_replace(F.regexp_replace("own", r"^[# ]+|[# \n]+\z", ""), r"\n.*", ""))).when(F.col("kind") == "anchor", F.concat(F.lit("#"), F.col("name"))).when(F.col("kind") == "footnote", F.col("name")).when(F.col("role") == "def", F.regexp_extract("own", r"^ {0,3}\[([^\[\]]+)\]:", 1)).otherwise(F.regexp_extract("own", r"\[([^\[\]]+)\][^\[]*\z", 1))
    new = F.when((F.col("kind") == "anchor") & (F.col("role") == "use"), F.concat(F.lit("#"), slugify(F.col("new_name")))).otherwise(F.col("new_name"))
    rows = rows.withColumns({"old": old, "new_text": new}).where(F.contains("own", F.col("old")) & (F.col("old") != ""))
    lead = F.octet_length(F.expr("substring_index(own, old, 1)"))
    return rows.select("doc_id", "offset", (F.col("start_byte") + lead).alias("start_byte"), (F.col("start_byte") + lead + F.octet_length("old")).alias("end_byte"), "new_text").distinct()


def folding_ranges(parsed: DataFrame) -> DataFrame:
    """doc_id, start_line, end_line, kind: blocks of several lines, and sections under headings; distinct. A section ends before
    the next heading of the same or a smaller level, which is looked for among the row's own headings."""
    types = ("CodeBlock", "Diagram", "Frontmatter", "ContainerDirective", "Admonition", "Blockquote", "List", "Table", "FootnoteDef")
    fold = lambda a, b, kind: F.struct(a.alias("start_line"), b.alias("end_line"), kind.alias("kind"))
    placed = F.filter("nodes", lambda n: n["range"].isNotNull())
    last = lambda r: F.when(r["end_col"] == 1, r["end_line"] - 1).otherwise(r["end_line"])
    blocks = F.transform(F.filter(placed, lambda n: n["type"].isin(*types)), lambda n: fold(n["range"]["start_line"], last(n["range"]), F.when(n["type"] == "Frontmatter", "comment").otherwise("region")))
    heads = F.transform(F.filter(placed, lambda n: n["type"] == "Heading"), lambda n: F.struct(F.element_at(n["attrs"], "level").cast("int").alias("level"), n["range"]["start_line"].alias("line")))
    total = F.size("starts") - 1
    after = lambda hs, h, i: F.get(F.filter(F.slice(hs, i + 2, F.size(hs)), lambda x: x["level"] <= h["level"]), F.lit(0))["line"]
    sections = once(heads, lambda hs: F.transform(hs, lambda h, i: fold(h["line"], F.coalesce(after(hs, h, i) - 1, total), F.lit("region"))))
    return parsed.select("doc_id", F.inline(F.array_distinct(F.concat(blocks, sections)))).where("end_line > start_line")


def document_symbols(parsed: DataFrame) -> DataFrame:
    """doc_id, kind, name, ord, parent_ord: frontmatter, the heading tree, containers and footnotes, from one scan."""
    name = F.when(F.col("type") == "Frontmatter", "frontmatter").when(F.col("type") == "FootnoteDef", F.concat(F.lit("[^"), attr("id"), F.lit("]"))).when(F.col("type") == "Heading", F.coalesce("text", F.lit(""))).otherwise(F.concat(F.lit(":::"), attr("name")))
    rows = of_type(plans.nodes(parsed), "Frontmatter", "ContainerDirective", "FootnoteDef", "Heading").select("doc_id", "node_id", F.col("type").alias("kind"), name.alias("name"), F.when(F.col("type") == "Heading", attr("level").cast("int")).alias("level"))
    by = Window.partitionBy("doc_id").orderBy("node_id")
    heading = F.col("level").isNotNull()
    numbered = rows.withColumn("ord", F.when(heading, F.count("level").over(by.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(before) for k in range(1, 6)]
    parent = F.greatest(*(F.when(F.col("level") > k, above[k - 1]) for k in range(1, 6)))
    return numbered.select("doc_id", "kind", "name", "ord", parent.alias("parent_ord"))


# ---------------------------------------------------------------- completion


def _items(pairs: list[tuple[str, str, str]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("detail"), F.lit(c).alias("insert")) for a, b, c in pairs))


def completions(parsed: DataFrame, offsets: DataFrame, emoji: dict[str, str] | None = None) -> DataFrame:
    """doc_id, offset, label, detail, insert: what may be inserted at each offset(doc_id, offset), by the text between it and the
    line's start: frontmatter keys, containers, admonition types, directives, footnote ids, link labels, anchors, emoji."""
    from quillspark.functions.vocabulary import EMOJI

    rows = parsed.select("doc_id", "source", "links", "nodes", "frontmatter").join(offsets, "doc_id")
    before = F.decode(F.expr("substring(encode(source, 'utf-8'), 1, offset)"), "utf-8")
    prefix = F.regexp_extract(before, r"([^\n]*)\z", 1)
    inside = F.regexp_extract("source", r"(?s)\A(---\n(?:.*?\n)??---)(?:\n|\z)", 1)
    rows = rows.select("doc_id", "offset", "links", "nodes", "frontmatter", prefix.alias("prefix"), (F.col("source").startswith("---\n") & (F.col("offset") <= F.octet_length(inside))).alias("front"))
    rows = rows.withColumns({"trimmed": F.regexp_replace("prefix", r"^[ \t]+", ""), "token": F.regexp_extract("prefix", r"([^ \t]*)\z", 1)})
    lower, token, trimmed = F.lower, F.col("token"), F.col("trimmed")
    listed = lambda names, detail, end, head="": F.transform(names, lambda x: F.struct(F.concat(F.lit(head), x).alias("label"), F.lit(detail).alias("detail"), F.concat(x, F.lit(end)).alias("insert")))
    starting = lambda names, begin: F.array_sort(F.array_distinct(F.filter(names, lambda x: F.startswith(lower(x), lower(begin)))))
    own_keys = F.coalesce(F.map_keys(F.from_json("frontmatter", "map<string,string>")), F.array().cast("array<string>"))
    keys = listed(starting(F.concat(F.array(*map(F.lit, FRONTMATTER_KEYS)), own_keys), F.trim(trimmed)), "Frontmatter key", ": ")
    notes = F.transform(F.filter("nodes", lambda n: n["type"] == "FootnoteDef"), lambda n: F.element_at(n["attrs"], "id"))
    labels = F.transform("links", lambda d: d["label"])
    slugs = F.filter(F.transform(F.filter("nodes", lambda n: n["type"] == "Heading"), lambda n: slugify(F.coalesce(n["text"], F.lit("")))), lambda x: x != "")
    codes = F.array(*map(F.lit, sorted(emoji or EMOJI)))
    after = lambda pattern: F.regexp_extract("token", pattern, 1)
    directives = [("[[toc]]", "Insert generated table of contents directive", "[[toc]]"), ("[[embed:]]", "Insert auto-embed directive", "[[embed:${1:https://example.com}]]")]
    boxes = [(n, t, n + "\n${0}\n:::") for n, t in CONTAINER_TEXT.items()]
    marks = [(n, t, n + "]") for n, t in ADMONITION_TEXT.items()]
    labelled = (token.startswith("[") | F.contains("token", F.lit("]["))) & ~F.contains("token", F.lit("](")) & ~token.startswith("[[") & ~token.startswith("[^")
    items = (
        F.when(F.col("front") & ~trimmed.startswith("---") & (F.size(keys) > 0), keys)
        .when(F.contains("trimmed", F.lit("[[embed:")), F.array().cast("array<struct<label:string,detail:string,insert:string>>"))
        .when(trimmed.startswith(":::"), _items(boxes))
        .when(F.contains("prefix", F.lit("[!")), _items(marks))
        .when(trimmed.startswith("[[") | trimmed.endswith("[["), _items(directives))
        .when(token.startswith("[^"), listed(starting(notes, after(r"^\[\^(.*)\z")), "Footnote ID", "]"))
        .when(labelled, listed(starting(labels, F.when(F.contains("token", F.lit("][")), after(r".*\]\[(.*)\z")).otherwise(after(r"^\[(.*)\z"))), "Reference label", "]"))
        .when(F.contains("token", F.lit("(#")), listed(starting(slugs, after(r".*\(#(.*)\z")), "Heading anchor", "", "#"))
        .when(token.rlike(r"^:[A-Za-z0-9_+-]+\z"), listed(starting(codes, after(r"^:(.*)\z")), "Emoji shortcode", ":"))
    )
    return rows.select("doc_id", "offset", F.inline(items))


# ---------------------------------------------------------------- code actions

KINDS = ("quickfix", "source.fixAll.mdpp")


def allowed(only: tuple[str, ...] | None, kind: str) -> bool:
    """Whether a kind, or one above it, is asked for."""
    return not only or any(kind == o or kind.startswith(f"{o}.") for o in only)


def code_actions(parsed: DataFrame, ranges: DataFrame | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, title, kind, code, start_byte, end_byte, new_text: fixes of findings, missing definitions, references made inline, and
    the whole document formatted. With ranges(doc_id, from_byte, to_byte) only what touches one of a document's ranges; an empty
    range touches what it borders on. `only` names the kinds that are asked for."""
    parsed = kept(parsed, "parsed")
    parts = []
    if allowed(only, "quickfix"):
        found = linter.lint(parsed, [r for r in linter.RULES if r in linter.FIXABLE or r in ("MDPP100", "MDPP106")], keep=False)
        fixes = found.where("new_text is not null").select("doc_id", F.concat(F.lit("Fix "), F.col("code"), F.lit(": "), F.col("message")).alias("title"), F.lit("quickfix").alias("kind"), "code", "start_byte", "end_byte", "new_text", F.col("start_byte").alias("a"), F.col("end_byte").alias("z"))
        size = parsed.select("doc_id", F.octet_length("source").alias("size"), F.when(F.col("source") == "", "").when(F.col("source").endswith("\n\n"), "").when(F.col("source").endswith("\n"), "\n").otherwise("\n\n").alias("gap"))
        note = F.regexp_extract("message", r"\[(\^?[^\]]+)\]", 1)
        what = F.when(F.col("code") == "MDPP100", "Create missing footnote definition").otherwise("Create missing reference definition")
        missing = found.where("code in ('MDPP100', 'MDPP106')").join(size, "doc_id")
        created = missing.select("doc_id", what.alias("title"), F.lit("quickfix").alias("kind"), "code", F.col("size").alias("start_byte"), F.col("size").alias("end_byte"), F.concat("gap", F.lit("["), note, F.lit("]: ")).alias("new_text"), F.col("start_byte").alias("a"), F.col("end_byte").alias("z"))
        parts += [fixes, created, _inlined(parsed)]
    if allowed(only, "source.fixAll.mdpp"):
        whole = convert.formatted(parsed).where("changed")
        parts.append(whole.select("doc_id", F.lit("Format document with mdpp").alias("title"), F.lit("source.fixAll.mdpp").alias("kind"), F.lit("").alias("code"), F.lit(0).alias("start_byte"), F.octet_length("source").alias("end_byte"), F.col("formatted").alias("new_text"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("z")))
    if not parts:
        none = parsed.limit(0)
        return none.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("kind", "string"), ("code", "string"), ("start_byte", "int"), ("end_byte", "int"), ("new_text", "string"))))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    if ranges is not None:
        f, t = F.col("from_byte"), F.col("to_byte")
        touches = F.col("a").isNull() | F.when(f == t, (F.col("a") <= f) & (f <= F.col("z"))).when(F.col("a") == F.col("z"), (f <= F.col("a")) & (F.col("a") <= t)).otherwise((f < F.col("z")) & (F.col("a") < t))
        every = every.join(ranges, "doc_id").where(touches)
    return every.select("doc_id", "title", "kind", "code", "start_byte", "end_byte", "new_text").distinct()


def _inlined(parsed: DataFrame) -> DataFrame:
    """References whose label has a definition, as inline links."""
    target = lambda p: F.get(F.filter("links", lambda d: d["label"] == p["label"]), F.lit(0))
    rows = parsed.select("doc_id", F.inline(F.transform("pairs", lambda p: F.struct(p.alias("p"), target(p).alias("d")))))
    quoted = F.when(F.col("d.title") != "", F.concat(F.lit(' "'), F.col("d.title"), F.lit('"'))).otherwise("")
    a, z = F.col("p.start_byte"), F.col("p.end_byte")
    return rows.select("doc_id", F.lit("Convert reference link to inline link").alias("title"), F.lit("quickfix").alias("kind"), F.lit("").alias("code"), a.alias("start_byte"), z.alias("end_byte"), F.concat(F.lit("["), F.col("p.shown"), F.lit("]("), F.col("d.href"), quoted, F.lit(")")).alias("new_text"), a.alias("a"), z.alias("z"))


# ---------------------------------------------------------------- semantic tokens


def semantic_tokens(docs: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """doc_id, line, start, length (from 0, UTF-16), type, modifiers (bits), delta_line, delta_start of docs(doc_id, source), of their bytes
    first..last: one pass over the documents, no shuffle."""

    def one(source: str) -> tuple[list[dict]]:
        found, line, start = [], 0, 0
        for at, character, length, kind, bits in tokens(read(source), first, last):
            found.append({"line": at, "start": character, "length": length, "type": kind, "modifiers": bits, "delta_line": at - line, "delta_start": character - start if at == line else character})
            line, start = at, character
        return (found,)

    fields = [("line", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("type", pa.string()), ("modifiers", pa.int32()), ("delta_line", pa.int32()), ("delta_start", pa.int32())]
    kind = "tokens array<struct<line:int,start:int,length:int,type:string,modifiers:int,delta_line:int,delta_start:int>>"
    return convert.mapped(docs, {"tokens": pa.list_(pa.struct(fields))}, kind, one).select("doc_id", F.inline("tokens"))
