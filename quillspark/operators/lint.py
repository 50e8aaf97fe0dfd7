"""The linter: every rule a DataFrame query over nodes and lines, united, suppressed and sorted.

A rule takes the Context's tables and returns findings(doc_id, code, message, start_byte, end_byte, line,
col, end_line, end_col, new_text, related, off); new_text is a fix, the range's replacement, off what the document
suppresses. Rules of one's own are such functions too; they may leave out the last two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import attr, direct_media, label, slugify
from quillspark.functions.vocabulary import CONTAINERS, IGNORED, SEVERITY, SEVERITY_RANK, TITLES
from quillspark.operators.extract import format_version, of_type
from quillspark.plans import nodes as plans
from quillspark.plans.store import kept

SPEC_VERSION = "0.1"
# Patterns by which the rules find what they report.
REFERENCE = r"^ {0,3}\[([^\]\^][^\]]*)\]:[ \t]*(\S+)"
BARE_URL = r"https?://[^\s<>()]+"
STARRED = r"(^|[^*])\*[^*\s][^*]*\*"
UNDERSCORED = r"(^|[^_])_[^_\s][^_]*_"

RELATED = "array<struct<message:string,start_byte:int,end_byte:int,line:int,col:int>>"


@dataclass
class Context:
    parsed: DataFrame
    nodes: DataFrame
    lines: DataFrame

    @classmethod
    def of(cls, parsed: DataFrame) -> Context:
        return cls(parsed, plans.nodes(parsed), plans.lines(parsed))


def at_node(rows: DataFrame, code: str | Column, message: Column, related: Column | None = None) -> DataFrame:
    """Findings at the range of a node, or at 1:1 where it has none."""
    r = lambda f, other: F.coalesce(F.col(f"range.{f}"), F.lit(other))
    named = F.lit(code) if isinstance(code, str) else code
    beside = F.lit(None) if related is None else related
    return rows.select("doc_id", named.alias("code"), message.alias("message"), r("start_byte", 0).alias("start_byte"), r("end_byte", 1).alias("end_byte"), r("start_line", 1).alias("line"), r("start_col", 1).alias("col"), r("end_line", 1).alias("end_line"), r("end_col", 2).alias("end_col"), F.lit(None).cast("string").alias("new_text"), beside.cast(RELATED).alias("related"), "off")


def at_line(rows: DataFrame, code: str, message: Column, start: Column, end: Column, new_text: Column | None = None) -> DataFrame:
    """Findings on bytes start..end of a line."""
    n, a = F.col("line_no"), F.col("start_byte")
    fix = F.lit(None) if new_text is None else new_text
    return rows.select("doc_id", F.lit(code).alias("code"), message.alias("message"), (a + start).cast("int").alias("start_byte"), (a + end).cast("int").alias("end_byte"), n.alias("line"), (start + 1).cast("int").alias("col"), n.alias("end_line"), (end + 1).cast("int").alias("end_col"), fix.cast("string").alias("new_text"), F.lit(None).cast(RELATED).alias("related"), "off")


def at_document(rows: DataFrame, code: str, message: Column) -> DataFrame:
    return at_node(rows.withColumn("range", F.lit(None).cast(plans.RANGE)), code, message)


def ignored_ranges(c: Context) -> DataFrame:
    """doc_id, a, b: what source rules don't look into."""
    own = of_type(c.nodes, *IGNORED).where("range is not null").select("doc_id", F.col("range.start_byte").alias("a"), F.col("range.end_byte").alias("b"))
    # a definition's range takes its line feed
    defs = c.lines.where(F.col("text").rlike(f"(?d){REFERENCE}")).select("doc_id", F.col("start_byte").alias("a"), (F.col("end_byte") + 1).alias("b"))
    return own.union(defs)


def outside(rows: DataFrame, ranges: DataFrame, start: str = "s", end: str = "e") -> DataFrame:
    """rows whose start..end lies in none of the document's ranges: an anti join on the key and the interval."""
    r = ranges.withColumnRenamed("doc_id", "d")
    return rows.join(r, (rows["doc_id"] == r["d"]) & (r["a"] <= rows[start]) & (rows[end] <= r["b"]), "left_anti")


def open_lines(c: Context) -> DataFrame:
    return outside(c.lines, ignored_ranges(c), "start_byte", "end_byte")


# ---------------------------------------------------------------- rules over nodes


def _ids(kind: str) -> Column:
    """The ids of a document's nodes of one type."""
    return F.array_distinct(F.transform(F.filter("nodes", lambda n: n["type"] == kind), lambda n: F.element_at(n["attrs"], "id")))


def undefined_footnote(c: Context) -> DataFrame:
    refs = c.parsed.select("doc_id", "off", _ids("FootnoteDef").alias("defs"), F.inline(F.filter("nodes", lambda n: n["type"] == "FootnoteRef")))
    return at_node(refs.where(~F.array_contains("defs", attr("id"))), "MDPP100", F.concat(F.lit("undefined footnote reference [^"), attr("id"), F.lit("]")))


def unused_footnote(c: Context) -> DataFrame:
    defs = c.parsed.select("doc_id", "off", _ids("FootnoteRef").alias("refs"), F.inline(F.filter("nodes", lambda n: n["type"] == "FootnoteDef")))
    return at_node(defs.where(~F.array_contains("refs", attr("id"))), "MDPP101", F.concat(F.lit("footnote definition [^"), attr("id"), F.lit("] is never referenced")))


def broken_anchor(c: Context) -> DataFrame:
    """Links to anchors that no heading of the row's own nodes has."""
    slugs = F.transform(F.filter("nodes", lambda n: n["type"] == "Heading"), lambda n: slugify(F.coalesce(n["text"], F.lit(""))))
    uses = c.parsed.select("doc_id", "off", slugs.alias("slugs"), F.inline(F.filter("nodes", lambda n: (n["type"] == "Link") & F.element_at(n["attrs"], "href").startswith("#"))))
    slug = F.substring(attr("href"), 2, 1 << 20)
    return at_node(uses.where(~F.array_contains("slugs", slug)), "MDPP102", F.concat(F.lit("broken intra-doc link #"), slug))


def duplicate_heading(c: Context) -> DataFrame:
    """Second and later headings of a slug; the first one is related."""
    h = of_type(c.nodes, "Heading").withColumn("slug", slugify(F.coalesce("text", F.lit(""))))
    by = Window.partitionBy("doc_id", "slug").orderBy("node_id")
    first = F.first("range").over(by)
    rows = h.withColumns({"nth": F.row_number().over(by), "first": first}).where("nth > 1")
    related = F.when(F.col("first").isNotNull(), F.array(F.struct(F.lit("first heading with this id").alias("message"), F.col("first.start_byte"), F.col("first.end_byte"), F.col("first.start_line").alias("line"), F.col("first.start_col").alias("col"))))
    return at_node(rows, "MDPP103", F.concat(F.lit("duplicate heading id #"), F.col("slug")), related)


def _embed_ok() -> Column:
    return attr("src").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")


def _of_one_node(code: str) -> Callable[[Context], DataFrame]:
    """A rule that a node breaks by itself."""
    return lambda c: single_nodes(c, code)


#: Rules of single nodes: type, condition, message.
SINGLE: dict[str, tuple[tuple[str, ...], Callable[[], Column], Callable[[], Column]]] = {
    "MDPP104": (("ContainerDirective",), lambda: ~attr("name").isin(*CONTAINERS), lambda: F.concat(F.lit("unknown container type :::"), attr("name"))),
    "MDPP106": (("Link",), lambda: (attr("ref") != "") & (attr("href") == ""), lambda: F.concat(F.lit("reference link ["), attr("ref"), F.lit("] has no definition"))),
    "MDPP110": (("AutoEmbed",), lambda: (attr("provider") == "generic") & _embed_ok() & ~direct_media(attr("src")), lambda: F.lit("auto-embed provider is generic")),
    "MDPP111": (("AutoEmbed",), lambda: ~_embed_ok(), lambda: F.lit("auto-embed URL is malformed")),
    "MDPP202": (("Link",), lambda: (F.trim(F.coalesce("text", F.lit(""))) == "") & (attr("href") != ""), lambda: F.lit("link text is empty")),
    "MD045": (("Image",), lambda: F.trim(attr("alt")) == "", lambda: F.lit("image alt text is empty")),
}


def single_nodes(c: Context, *codes: str) -> DataFrame:
    """All given rules of single nodes in one scan of the nodes."""
    chosen = {k: SINGLE[k] for k in codes}
    holds = {k: F.col("type").isin(*types) & when() for k, (types, when, _) in chosen.items()}
    hits = F.filter(F.array(*(F.when(holds[k], F.struct(F.lit(k).alias("code"), say().alias("said"))) for k, (_, _, say) in chosen.items())), lambda x: x.isNotNull())
    rows = of_type(c.nodes, *sorted({t for types, _, _ in chosen.values() for t in types})).withColumn("hit", F.explode(hits))
    return at_node(rows, F.col("hit.code"), F.col("hit.said"))


def unused_definition(c: Context) -> DataFrame:
    """Definitions whose label stands nowhere in brackets that aren't themselves a definition or an inline link."""
    found = c.lines.where(F.col("text").rlike(f"(?d){REFERENCE}")).withColumn("label", label(F.regexp_extract("text", REFERENCE, 1)))
    last = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(F.desc("line_no")))
    defs = found.withColumn("nth", last).where("nth = 1")
    tokens = c.lines.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"!?\[([^\]\n]+)\](?![:(\[])"), 1)).alias("label")).select("doc_id", label(F.col("label")).alias("label"))
    nodes = of_type(c.nodes, "Link", "Image").where(attr("ref") != "").select("doc_id", label(attr("ref")).alias("label"))
    unused = defs.join(tokens.union(nodes).distinct(), ["doc_id", "label"], "left_anti")
    return at_line(unused, "MDPP105", F.concat(F.lit("link reference ["), F.col("label"), F.lit("] is never used")), F.lit(0), F.octet_length(F.regexp_extract("text", REFERENCE, 0)) + 1, F.lit(""))


def newer_version(c: Context) -> DataFrame:
    return at_document(format_version(c.parsed).where(F.col("version") > SPEC_VERSION), "MDPP107", F.concat(F.lit("frontmatter mdpp version "), F.col("version"), F.lit(f" is newer than parser {SPEC_VERSION}")))


def several_tocs(c: Context) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
    return at_node(of_type(c.nodes, "TableOfContents").withColumn("nth", nth).where("nth > 1"), "MDPP108", F.lit("multiple [[toc]] directives"))


def empty_toc(c: Context) -> DataFrame:
    lone = c.parsed.where(~F.exists("nodes", lambda n: n["type"] == "Heading"))
    return at_node(of_type(plans.nodes(lone), "TableOfContents"), "MDPP109", F.lit("[[toc]] has no headings to populate"))


def heading_skip(c: Context) -> DataFrame:
    h = of_type(c.nodes, "Heading").withColumn("l", attr("level").cast("int"))
    before = F.lag("l").over(Window.partitionBy("doc_id").orderBy("node_id"))
    return at_node(h.withColumn("before", before).where("l > before + 1"), "MDPP200", F.concat(F.lit("heading level skips from h"), F.col("before"), F.lit(" to h"), F.col("l")))


# ---------------------------------------------------------------- rules over lines


def trailing_space(c: Context) -> DataFrame:
    kept = F.octet_length(F.regexp_replace("text", r"[ \t]+\z", ""))
    return at_line(c.lines.where(F.col("text").rlike(r"[ \t]\z")), "MD009", F.lit("trailing whitespace"), kept, F.octet_length("text"), F.lit(""))


def blank_run(c: Context) -> DataFrame:
    """From the third line of each island of blank lines; ignored lines end an island."""
    blank = open_lines(c).where(F.col("text").rlike(r"(?U)^\s*\z"))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    islands = blank.withColumn("island", F.col("line_no") - F.row_number().over(by))
    nth = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("line_no"))
    return at_line(islands.withColumn("nth", nth).where("nth >= 3"), "MD012", F.lit("multiple consecutive blank lines"), F.lit(0), F.octet_length("text"))


def list_markers(c: Context) -> DataFrame:
    marks = open_lines(c).where(F.col("text").rlike(r"^ *[-*+] ")).select("doc_id", "off", F.substring(F.ltrim("text"), 1, 1).alias("m"))
    return at_document(marks.groupBy("doc_id").agg(F.min("m").alias("a"), F.max("m").alias("z"), F.first("off").alias("off")).where("a <> z"), "MD004", F.lit("unordered list markers are inconsistent"))


def emphasis_styles(c: Context) -> DataFrame:
    seen = open_lines(c).groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(STARRED)).alias("a"), F.bool_or(F.col("text").rlike(UNDERSCORED)).alias("b"), F.first("off").alias("off"))
    return at_document(seen.where("a and b"), "MD049", F.lit("emphasis styles are inconsistent"))


def _urls(c: Context) -> DataFrame:
    """URLs in lines that aren't ignored, with the character before and after and their bytes."""
    rows = open_lines(c).where(F.col("text").rlike("https?://"))
    found = rows.withColumn("x", F.explode(F.regexp_extract_all("text", F.lit(rf"(?:^|.){BARE_URL}>?"), 0)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "line_no", "x").orderBy("x"))
    place = F.octet_length(F.expr("substring_index(text, x, nth)"))
    url = F.regexp_extract("x", BARE_URL, 0)
    before = F.when(F.col("x").rlike("^https?://") & (place == 0), F.lit("")).when(F.substring("x", 1, 4) == "http", F.lit("")).otherwise(F.substring("x", 1, 1))
    out = found.withColumn("nth", nth).withColumns({"before": before, "after": F.when(F.col("x").endswith(">"), ">").otherwise(""), "p": place + F.octet_length(before), "url": url})
    return outside(out.withColumns({"s": F.col("start_byte") + F.col("p"), "e": F.col("start_byte") + F.col("p") + F.octet_length("url")}), ignored_ranges(c))


def bare_url(c: Context) -> DataFrame:
    return at_line(_urls(c).where(~F.col("before").isin("<", "(")), "MD034", F.lit("bare URL should use explicit link syntax"), F.col("p"), F.col("p") + F.octet_length("url"))


def autolink(c: Context) -> DataFrame:
    return at_line(_urls(c).where("before = '<' and after = '>'"), "MDPP201", F.lit("autolink URL should use descriptive link text"), F.col("p"), F.col("p") + F.octet_length("url"))


def headless_table(c: Context) -> DataFrame:
    delimiter = r"^ {0,3}(?=[^ ])(?=.*\|)[ \t]*\|*(?:[ \t]*:?-{3,}:?[ \t]*\|*)+[ \t]*\z"
    tables = of_type(c.nodes, "Table").where("range is not null").select("doc_id", F.col("range.start_byte").alias("a"), F.col("range.end_byte").alias("b"))
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    filled = F.when(~F.col("text").rlike(r"(?U)^\s*\z"), F.col("text"))
    rows = c.lines.withColumn("next", F.first(filled, ignorenulls=True).over(ahead))
    rows = rows.where(F.col("text").rlike(delimiter) & F.contains("next", F.lit("|")) & ~F.col("next").rlike(delimiter))
    rows = outside(outside(rows, ignored_ranges(c), "start_byte", "end_byte"), tables, "start_byte", "end_byte")
    return at_line(rows, "MDPP203", F.lit("table without header row"), F.lit(0), F.octet_length("text"))


def fence_case(c: Context) -> DataFrame:
    rows = c.lines.withColumn("lang", F.regexp_extract("text", r"^\s*```\s*(\S+)", 1)).where((F.col("lang") != "") & (F.col("lang") != F.lower("lang")))
    place = F.octet_length(F.expr("substring_index(text, lang, 1)"))
    return at_line(rows, "MDPP300", F.lit("fence info-string should be lowercase"), place, place + F.octet_length("lang"), F.lower("lang"))


RULES: dict[str, Callable[[Context], DataFrame]] = {
    "MD004": list_markers, "MD009": trailing_space, "MD012": blank_run, "MD034": bare_url, "MD045": _of_one_node("MD045"), "MD049": emphasis_styles,
    "MDPP100": undefined_footnote, "MDPP101": unused_footnote, "MDPP102": broken_anchor, "MDPP103": duplicate_heading, "MDPP104": _of_one_node("MDPP104"),
    "MDPP105": unused_definition, "MDPP106": _of_one_node("MDPP106"), "MDPP107": newer_version, "MDPP108": several_tocs, "MDPP109": empty_toc,
    "MDPP110": _of_one_node("MDPP110"), "MDPP111": _of_one_node("MDPP111"), "MDPP200": heading_skip, "MDPP201": autolink, "MDPP202": _of_one_node("MDPP202"), "MDPP203": headless_table,
    "MDPP300": fence_case,
}
#: Rules that read the parsed documents more than once, and how many such scans lint() does without keeping them.
SCANS = {"MD012": 3, "MD004": 3, "MD049": 3, "MD034": 5, "MDPP201": 5, "MDPP203": 4, "MDPP105": 3}
MOST_SCANS = 2
#: Rules whose findings carry a fix.
FIXABLE = ("MD009", "MDPP105", "MDPP300")


# ---------------------------------------------------------------- suppression, filters, fixes


def rules(spark: SparkSession) -> DataFrame:
    """code, severity, title: the registry of rules."""
    return spark.createDataFrame([(c, SEVERITY[c], TITLES[c]) for c in sorted(RULES)], "code string, severity string, title string")


def _hidden(off: str = "off") -> Column:
    """Whether a finding's line is switched off for its code."""
    return F.exists(off, lambda o: ((o["code"] == F.col("code")) | (o["code"] == "*")) & (F.col("line") > o["after"]) & (o["until"].isNull() | (F.col("line") <= o["until"])))


def lint(parsed: DataFrame, rules: list[str] | None = None, without: list[str] | None = None, least: str = "hint", extra: list[Callable[[Context], DataFrame]] | None = None, keep: bool = True) -> DataFrame:
    """Findings with severity; suppressed ones are gone. Ask for order at the sink: doc_id, start_byte, code.

    What is suppressed comes with each document from the parser, so no rule needs a join for it; rules of single nodes
    share one scan. Where the chosen rules scan the documents more than MOST_SCANS times, the parsed documents are
    written once and read column by column, unless keep is false because they are a table already; nothing stays in the
    session's cache.
    """
    chosen = [r for r in (rules or RULES) if r not in (without or ())]
    single = [r for r in chosen if r in SINGLE]
    others = [r for r in chosen if r not in SINGLE]
    if keep and bool(single) + sum(SCANS.get(r, 1) for r in others) + len(extra or ()) > MOST_SCANS:
        parsed = kept(parsed, "parsed")
    c = Context.of(parsed)
    given = [f(c) for f in extra or []]
    for i, f in enumerate(given):
        if "off" not in f.columns:
            f = f.join(parsed.select("doc_id", "off"), "doc_id")
        given[i] = f if "related" in f.columns else f.withColumn("related", F.lit(None).cast(RELATED))
    parts = [*([single_nodes(c, *single)] if single else []), *(RULES[r](c) for r in others), *given]
    found = reduce(DataFrame.unionByName, parts)
    return _ranked(found, least).where(~_hidden()).drop("off")


def _ranked(found: DataFrame, least: str) -> DataFrame:
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY_RANK.items() for x in pair))
    named = found if "severity" in found.columns else found.withColumn("severity", F.coalesce(severity[F.col("code")], F.lit("warning")))
    return named.where(rank[F.col("severity")] >= SEVERITY_RANK.get(least, 0))


def with_parse_diagnostics(parsed: DataFrame, findings: DataFrame, rules: list[str] | None = None, without: list[str] | None = None, least: str = "hint") -> DataFrame:
    """Findings and what the parser reported, which goes through the same filters."""
    d = plans.diagnostics(parsed)
    if rules:
        d = d.where(F.col("code").isin(*rules))
    if without:
        d = d.where(~F.col("code").isin(*without))
    named = d.select("doc_id", "code", "severity", "message", F.col("range.start_byte").alias("start_byte"), F.col("range.end_byte").alias("end_byte"), F.col("range.start_line").alias("line"), F.col("range.start_col").alias("col"), F.col("range.end_line").alias("end_line"), F.col("range.end_col").alias("end_col"), F.lit(None).cast("string").alias("new_text"), F.lit(None).cast(RELATED).alias("related"))
    return findings.unionByName(_ranked(named, least))


def fixed(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, source with every fix applied, from the last to the first, on bytes."""
    edits = findings.where("new_text is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "new_text")), asc=False).alias("edits"))
    text = F.encode("source", "utf-8")
    cut = lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["start_byte"]), F.encode(e["new_text"], "utf-8"), F.substring(acc, e["end_byte"] + 1, F.octet_length(acc)))
    joined = parsed.select("doc_id", "source").join(edits, "doc_id", "left")
    none = F.expr("cast(array() as array<struct<start_byte:int,end_byte:int,new_text:string>>)")
    return joined.select("doc_id", F.decode(F.aggregate(F.coalesce("edits", none), text, cut), "utf-8").alias("source"), F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"))


def reported(findings: DataFrame, style: str = "text") -> DataFrame:
    """doc_id, line of the report: text, github or json."""
    span = lambda a, b, c, d: F.struct(F.col("start_byte"), F.col("end_byte"), F.col(a).alias("start_line"), F.col(b).alias("start_col"), F.col(c).alias("end_line"), F.col(d).alias("end_col"))
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise(F.lit("notice"))
    shown = {
        "text": F.format_string("%s:%d:%d: %s %s: %s", F.col("doc_id").cast("string"), "line", "col", "severity", "code", "message"),
        "github": F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", level, F.col("doc_id").cast("string"), "line", "col", "code", "message"),
        "json": F.to_json(F.struct(F.col("doc_id").cast("string").alias("file"), "code", "severity", "message", span("line", "col", "end_line", "end_col").alias("range"), F.when(F.col("new_text").isNotNull(), F.struct(span("line", "col", "end_line", "end_col").alias("range"), "new_text")).alias("fix"), "related")),
    }[style]
    return findings.select("doc_id", "start_byte", "code", shown.alias("report"))
