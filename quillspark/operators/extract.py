"""Extraction over the nodes table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import attr, reading_minutes, slugify, words
from quillspark.plans.nodes import nodes


def of_type(n: DataFrame, *types: str) -> DataFrame:
    return n.where(F.col("type").isin(*types))


def headings(p: DataFrame) -> DataFrame:
    """doc_id, ord (from 1), level, text, slug, in document order. The rank is counted inside the document's own
    array, so no shuffle is needed."""
    own = F.filter("nodes", lambda n: n["type"] == "Heading")
    rows = p.select("doc_id", F.posexplode(own).alias("k", "h"))
    text = F.coalesce(F.col("h.text"), F.lit(""))
    return rows.select("doc_id", (F.col("k") + 1).alias("ord"), F.element_at("h.attrs", "level").cast("int").alias("level"), text.alias("text"), slugify(text).alias("slug"))


def table_of_contents(p: DataFrame) -> DataFrame:
    return headings(p).select("doc_id", "ord", "level", F.col("slug").alias("id"), "text")


def toc_tree(p: DataFrame) -> DataFrame:
    """headings with parent_ord: the nearest heading before with a smaller level."""
    h = headings(p)
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(before) for k in range(1, 6)]
    parent = F.greatest(*(F.when(F.col("level") > k, above[k - 1]) for k in range(1, 6)))
    return h.withColumn("parent_ord", parent)


def word_counts(p: DataFrame) -> DataFrame:
    """doc_id, words of Text nodes, reading_minutes; computed inside the row."""
    total = F.aggregate(F.filter("nodes", lambda n: n["type"] == "Text"), F.lit(0), lambda acc, n: acc + words(n["literal"]))
    return p.select("doc_id", total.alias("words")).select("doc_id", "words", reading_minutes(F.col("words")).alias("reading_minutes"))


def type_counts(p: DataFrame) -> DataFrame:
    """doc_id, type, n."""
    return nodes(p).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def text_of(p: DataFrame, *types: str) -> DataFrame:
    """doc_id, node_id, type, text: the Text and CodeSpan literals of each subtree, which is a slice of the row's nodes."""
    said = lambda n: F.array_join(F.transform(F.filter(below(n), lambda x: x["type"].isin("Text", "CodeSpan")), lambda x: x["literal"]), "")
    found = F.transform(F.filter("nodes", lambda n: n["type"].isin(*types)), lambda n: F.struct(n["node_id"].alias("node_id"), n["type"].alias("type"), said(n).alias("text")))
    return p.select("doc_id", F.inline(found))


def below(n: Column) -> Column:
    """The descendants of a node of the row's own array: they stand right after it."""
    return F.slice("nodes", n["node_id"] + 2, n["last_desc"] - n["node_id"])


def surface_text(p: DataFrame, *types: str) -> DataFrame:
    """Like text_of, with breaks as line feeds and unresolved references as written."""
    raw = lambda x: F.coalesce(F.element_at(x["attrs"], "raw"), F.lit(""))
    said = lambda x: F.when(raw(x) != "", raw(x)).when(x["type"].isin("SoftBreak", "HardBreak"), F.lit("\n")).when(x["type"].isin("Text", "CodeSpan"), x["literal"]).otherwise(F.lit(""))
    hidden = lambda x, raws: F.exists(raws, lambda r: (x["node_id"] > r["node_id"]) & (x["node_id"] <= r["last_desc"]))
    shown = lambda n: once(F.filter(below(n), lambda x: raw(x) != ""), lambda raws: F.array_join(F.transform(F.filter(below(n), lambda x: ~hidden(x, raws)), said), ""))
    found = F.transform(F.filter("nodes", lambda n: n["type"].isin(*types)), lambda n: F.struct(n["node_id"].alias("node_id"), shown(n).alias("text")))
    return p.select("doc_id", F.inline(found))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def links(n: DataFrame) -> DataFrame:
    return of_type(n, "Link").select("doc_id", "node_id", attr("href").alias("href"), attr("title").alias("title"), attr("ref").alias("ref"), F.coalesce("text", F.lit("")).alias("text"))


def link_definitions(p: DataFrame) -> DataFrame:
    """doc_id, label, href, title of reference definitions, as the parser took them; of a repeated label the last holds."""
    return p.select("doc_id", F.inline("links")).select("doc_id", "label", "href", "title")


def tasks(n: DataFrame) -> DataFrame:
    return of_type(n, "TaskListItem").select("doc_id", "node_id", (attr("checked") == "true").alias("checked"), F.coalesce("text", F.lit("")).alias("text"))


def table_cells(p: DataFrame) -> DataFrame:
    """doc_id, table (from 1 in each document), row (0 is the head), col, align, text: a cell finds its row and table by parent
    inside the document's own array."""
    parent = lambda n: F.element_at("nodes", n["parent_id"] + 1)
    aligns = lambda t: F.split(F.coalesce(F.element_at(t["attrs"], "align"), F.lit("")), ",")

    def cell(c: Column, tables: Column) -> Column:
        row = parent(c)
        t = parent(row)
        return F.struct(F.array_position(tables, t["node_id"]).cast("int").alias("table"), row["ordinal"].alias("row"), c["ordinal"].alias("col"), F.coalesce(F.get(aligns(t), c["ordinal"]), F.lit("")).alias("align"), F.coalesce(c["text"], F.lit("")).alias("text"))

    ids = F.transform(F.filter("nodes", lambda x: x["type"] == "Table"), lambda x: x["node_id"])
    return p.select("doc_id", F.inline(once(ids, lambda tables: F.transform(F.filter("nodes", lambda x: x["type"] == "TableCell"), lambda c: cell(c, tables)))))


def footnotes(n: DataFrame) -> DataFrame:
    """References and definitions of each id, counted in one pass."""
    own = of_type(n, "FootnoteRef", "FootnoteDef")
    count = lambda t: F.count(F.when(F.col("type") == t, 1))
    return own.groupBy("doc_id", attr("id").alias("id")).agg(count("FootnoteRef").alias("refs"), count("FootnoteDef").alias("defs"))


def frontmatter(p: DataFrame) -> DataFrame:
    """doc_id, key, value of the frontmatter's top-level keys; lists and maps are JSON, null stays null."""
    return p.select("doc_id", F.explode(F.from_json("frontmatter", "map<string,string>")).alias("key", "value"))


def frontmatter_value(p: DataFrame, path: str) -> DataFrame:
    """doc_id, value at a JSON path such as $.author.name or $.tags[0]."""
    return p.where("frontmatter is not null").select("doc_id", F.get_json_object("frontmatter", path).alias("value"))


def format_version(p: DataFrame) -> DataFrame:
    return p.where("version <> ''").select("doc_id", "off", "version")


def path_at(p: DataFrame, offsets: DataFrame) -> DataFrame:
    """Nodes from the root down that contain each offset(doc_id, offset); at the end of the text ranges are closed."""
    rows = p.join(offsets, "doc_id")
    size = F.octet_length("source")
    holds = lambda n: n["range"].isNotNull() & (n["range"]["start_byte"] <= F.col("offset")) & ((F.col("offset") < n["range"]["end_byte"]) | ((F.col("offset") == size) & (n["range"]["end_byte"] == size)))
    found = rows.select("doc_id", "offset", F.inline(F.filter("nodes", holds)))
    one = Window.partitionBy("doc_id", "offset", "depth").orderBy("node_id")
    return found.withColumn("rn", F.row_number().over(one)).where("rn = 1").select("doc_id", "offset", "depth", "type", "node_id")


def nested(p: DataFrame, inner: str, outer: str) -> DataFrame:
    """doc_id, root_last (the highest node id of the document), outer_id and, in n, how many inner nodes are below each
    outer node that has any. Intervals are compared in the document's own array, so that one pass over the parsed
    documents does it and nothing is joined, shuffled or broadcast."""
    ids = F.transform(F.filter("nodes", lambda x: x["type"] == inner), lambda x: x["node_id"])
    below = lambda o, own: F.size(F.filter(own, lambda k: (k > o["node_id"]) & (k <= o["last_desc"]))).cast("long")
    found = once(ids, lambda own: F.transform(F.filter("nodes", lambda x: x["type"] == outer), lambda o: F.struct(o["node_id"].alias("outer_id"), below(o, own).alias("n"))))
    root = F.filter("nodes", lambda x: x["type"] == "Document")
    return p.select("doc_id", F.get(root, F.lit(0))["last_desc"].alias("root_last"), F.inline(found)).where("n > 0")
