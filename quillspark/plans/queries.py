"""The registered queries over the corpora, each with SQL that works out its answer from the base tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import attr, class_token, direct_media, escape_html, fence_language, slugify, words
from quillspark.functions.vocabulary import CONTAINERS
from quillspark.operators import convert, extract, lint, navigate, server
from quillspark.plans import corpora, samples
from quillspark.plans.nodes import nodes, parsed
from quillspark.plans.store import kept, shared_dir
from quillspark.sources import files
from quillspark.streaming import edits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


OUTLINE = """heads AS (
  SELECT r_regionkey AS doc_id, -1 AS n, -1 AS s, 1 AS level, r_name AS text FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 2, n_name FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, 3, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY n, s) AS ord, level, text,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') AS slug FROM heads)"""


@query("headings", f"WITH {OUTLINE} SELECT doc_id, ord, level, text, slug FROM h")
def headings(spark, d):
    return extract.headings(parsed(corpora.outline(spark, d)))


@query("table_of_contents", f"WITH {OUTLINE} SELECT doc_id, ord, level, slug AS id, text FROM h")
def table_of_contents(spark, d):
    return extract.table_of_contents(parsed(corpora.outline(spark, d)))


@query("toc_tree", f"WITH {OUTLINE} SELECT doc_id, ord, level, text, slug, CASE WHEN level > 1 THEN (SELECT max(b.ord) FROM h b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) END AS parent_ord FROM h")
def toc_tree(spark, d):
    return extract.toc_tree(parsed(corpora.outline(spark, d)))


@query("word_counts", f"WITH {OUTLINE}, w AS (SELECT doc_id, CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS words FROM h GROUP BY 1) SELECT doc_id, words, CASE WHEN words = 0 THEN 0 ELSE greatest(1, words // 200) END AS reading_minutes FROM w")
def word_counts(spark, d):
    return extract.word_counts(parsed(corpora.outline(spark, d)))


@query("node_type_counts", "SELECT o_custkey AS doc_id, t AS type, CASE WHEN t IN ('Document', 'List') THEN 1 ELSE count(*) END AS n FROM orders, (VALUES ('Document'), ('List'), ('TaskListItem'), ('Paragraph'), ('Text')) v(t) GROUP BY 1, 2")
def node_type_counts(spark, d):
    return extract.type_counts(parsed(corpora.task_list(spark, d)))


@query("tasks", "SELECT o_custkey AS doc_id, 'order ' || o_orderkey AS text, o_orderstatus = 'F' AS checked FROM orders")
def tasks(spark, d):
    return extract.tasks(nodes(parsed(corpora.task_list(spark, d)))).drop("node_id")


@query(
    "node_intervals",
    "SELECT o_custkey AS doc_id, count(*) AS items, 1 + 3 * count(*) AS root_last FROM orders GROUP BY 1",
)
def node_intervals(spark, d):
    return extract.nested(parsed(corpora.task_list(spark, d)), "TaskListItem", "List").select("doc_id", F.col("n").alias("items"), "root_last")


@query(
    "table_cells",
    """SELECT n_regionkey AS doc_id, 1 AS "table", row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, 0 AS col, 'left' AS align, n_name AS text FROM nation
UNION ALL SELECT n_regionkey, 1, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1, 'right', CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT r, 1, 0, 0, 'left', 'Nation' FROM (SELECT DISTINCT n_regionkey AS r FROM nation) UNION ALL SELECT r, 1, 0, 1, 'right', 'Key' FROM (SELECT DISTINCT n_regionkey AS r FROM nation)""",
)
def table_cells(spark, d):
    return extract.table_cells(parsed(corpora.pipe_table(spark, d)))


LINKS = "use AS (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders)"


@query(
    "link_resolution",
    f"""WITH {LINKS} SELECT doc_id, CASE WHEN k % 3 <> 0 THEN 'https://orders.example/' || k ELSE '' END AS href, CASE WHEN k % 3 = 0 THEN 'o' || k ELSE '' END AS ref, 'order ' || k AS text FROM use
UNION ALL SELECT doc_id, 'https://orders.example/' || k, '', 'o' || k FROM use WHERE k % 3 <> 0 UNION ALL SELECT doc_id, 'https://unused.example/' || k, '', 'u' || k FROM use WHERE k % 5 = 0""",
)
def link_resolution(spark, d):
    return extract.links(nodes(parsed(corpora.reference_links(spark, d)))).select("doc_id", "href", "ref", "text")


@query("link_definitions", f"WITH {LINKS} SELECT doc_id, 'o' || k AS label, 'https://orders.example/' || k AS href, '' AS title FROM use WHERE k % 3 <> 0 UNION ALL SELECT doc_id, 'u' || k, 'https://unused.example/' || k, '' FROM use WHERE k % 5 = 0")
def link_definitions(spark, d):
    return extract.link_definitions(parsed(corpora.reference_links(spark, d)))


@query("footnotes", "SELECT l_orderkey AS doc_id, 'n' || l_linenumber AS id, count(*) AS refs, CASE WHEN l_linenumber % 4 <> 0 THEN 1 ELSE 0 END AS defs FROM lineitem GROUP BY l_orderkey, l_linenumber")
def footnotes(spark, d):
    return extract.footnotes(nodes(parsed(corpora.footnoted(spark, d))))


KIND = "CASE p_size % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'details' WHEN 2 THEN 'gadget' ELSE 'column' END"


@query("container_attributes", f"""SELECT p_partkey AS doc_id, {KIND} AS name, p_name AS title, 'p' || p_partkey AS id, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS class, '{{"data":"' || p_size || '"}}' AS extra FROM part""")
def container_attributes(spark, d):
    n = extract.of_type(nodes(parsed(corpora.containers(spark, d))), "ContainerDirective")
    return n.select("doc_id", attr("name").alias("name"), attr("title").alias("title"), attr("id").alias("id"), attr("class").alias("class"), attr("attrs").alias("extra"))


@query("admonition_types", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'important' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' WHEN 3 THEN 'tip' ELSE 'caution' END AS type, count(*) AS n, count(DISTINCT 'Order ' || o_orderkey) AS titles FROM orders GROUP BY 1")
def admonition_types(spark, d):
    n = extract.of_type(nodes(parsed(corpora.admonitions(spark, d))), "Admonition")
    return n.groupBy(attr("type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct(attr("title")).alias("titles"))


_HOST = " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(corpora.HOSTS))
_PROVIDER = "CASE p_partkey % 10 WHEN 0 THEN 'youtube' WHEN 1 THEN 'youtube' WHEN 2 THEN 'vimeo' WHEN 3 THEN 'github' WHEN 4 THEN 'twitter' WHEN 5 THEN 'spotify' WHEN 6 THEN 'soundcloud' WHEN 9 THEN 'codepen' ELSE 'generic' END"


@query("embeds", f"SELECT p_partkey AS doc_id, 'https://' || CASE p_partkey % 10 {_HOST} END || p_partkey AS src, {_PROVIDER} AS provider, p_partkey % 10 = 7 AS media FROM part")
def embeds(spark, d):
    n = extract.of_type(nodes(parsed(corpora.embeds(spark, d))), "AutoEmbed")
    return n.select("doc_id", attr("src").alias("src"), attr("provider").alias("provider"), direct_media(attr("src")).alias("media"))


@query("frontmatter", "SELECT c_custkey AS doc_id, 'title' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'mdpp', CASE WHEN c_custkey % 7 = 0 THEN '0.2' ELSE '0.1' END FROM customer")
def frontmatter(spark, d):
    return extract.frontmatter(parsed(corpora.fronted(spark, d)))


@query("diagrams", "SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 1 THEN 'gantt' WHEN 2 THEN 'sequence' WHEN 4 THEN 'c4' ELSE '' END AS kind, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'mermaid' WHEN 2 THEN 'sequence' WHEN 3 THEN 'go' WHEN 4 THEN 'c4' ELSE 'sql' END AS language FROM part")
def diagrams(spark, d):
    n = extract.of_type(nodes(parsed(corpora.fenced(spark, d))), "Diagram", "CodeBlock")
    return n.select("doc_id", attr("kind").alias("kind"), fence_language(attr("language")).alias("language"))


@query("slugs", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS class, p_name AS escaped, len(string_split(p_name, ' ')) AS words FROM part")
def slugs(spark, d):
    p = corpora.table(spark, d, "part")
    return p.select("p_partkey", slugify(F.col("p_name")).alias("slug"), class_token(F.col("p_type")).alias("class"), escape_html(F.col("p_name")).alias("escaped"), words(F.col("p_name")).alias("words"))


@query("text_by_subtree", "SELECT n_regionkey AS doc_id, string_agg(n_name || n_nationkey, '' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def text_by_subtree(spark, d):
    found = extract.text_of(parsed(corpora.pipe_table(spark, d)), "Table")
    return found.select("doc_id", F.expr("substring(text, length('NationKey') + 1)").alias("text"))


@query("surface_text", "SELECT o_orderkey AS doc_id, 'status ' || o_orderstatus || chr(10) || 'lazy line' AS text FROM orders")
def surface_text(spark, d):
    p = parsed(corpora.admonitions(spark, d))
    return extract.surface_text(p, "Admonition").select("doc_id", "text")


@query("line_table", """SELECT doc_id, n AS n_lines, b AS n_bytes, e AS n_blank FROM (SELECT doc_id, len(string_split(t, chr(10))) AS n, strlen(t) AS b, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) = '')) AS e
FROM (SELECT doc_id, CASE WHEN x = '' OR x LIKE '%' || chr(10) THEN x ELSE x || chr(10) END AS t FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents)))""")
def line_table(spark, d):
    from quillspark.plans.nodes import lines, normalised

    src = corpora.prose(spark, d).select("doc_id", normalised(F.col("source")).alias("source"))
    return lines(src).groupBy("doc_id").agg(F.count("*").alias("n_lines"), (F.max("end_byte")).alias("n_bytes"), F.count(F.when(F.col("text").rlike(r"^\s*$"), 1)).alias("n_blank"))


# ---------------------------------------------------------------- lint


def _linted(corpus: Query, *codes: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lint.lint(parsed(corpus(spark, d)), list(codes)).select("doc_id", "code", "severity", "message", "line")

    return run


query("lint_undefined_reference", f"WITH {LINKS} SELECT doc_id, 'MDPP106' AS code, 'error' AS severity, 'reference link [o' || k || '] has no definition' AS message, row_number AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS row_number FROM use) WHERE k % 3 = 0")(_linted(corpora.reference_links, "MDPP106"))
query(
    "lint_unused_definition",
    f"""WITH {LINKS}, n AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id) AS uses, (k % 3 <> 0)::INT AS a, (k % 5 = 0)::INT AS b FROM use),
p AS (SELECT *, sum(a + b) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM n)
SELECT doc_id, 'MDPP105' AS code, 'warning' AS severity, 'link reference [u' || k || '] is never used' AS message, CAST(uses + 2 + upto AS BIGINT) AS line FROM p WHERE b = 1""",
)(_linted(corpora.reference_links, "MDPP105"))
query("lint_undefined_footnote", "SELECT l_orderkey AS doc_id, 'MDPP100' AS code, 'error' AS severity, 'undefined footnote reference [^n' || l_linenumber || ']' AS message, 1 AS line FROM lineitem WHERE l_linenumber % 4 = 0")(_linted(corpora.footnoted, "MDPP100", "MDPP101"))
query("lint_unknown_container", f"SELECT p_partkey AS doc_id, 'MDPP104' AS code, 'warning' AS severity, 'unknown container type :::gadget' AS message, 1 AS line FROM part WHERE {KIND} NOT IN {CONTAINERS}")(_linted(corpora.containers, "MDPP104"))
query("lint_embeds", f"SELECT p_partkey AS doc_id, 'MDPP110' AS code, 'info' AS severity, 'auto-embed provider is generic' AS message, 1 AS line FROM part WHERE {_PROVIDER} = 'generic' AND p_partkey % 10 <> 7")(_linted(corpora.embeds, "MDPP110", "MDPP111"))
query("lint_newer_version", "SELECT c_custkey AS doc_id, 'MDPP107' AS code, 'info' AS severity, 'frontmatter mdpp version 0.2 is newer than parser 0.1' AS message, 1 AS line FROM customer WHERE c_custkey % 7 = 0")(_linted(corpora.fronted, "MDPP107"))
query("lint_fence_case", "SELECT p_partkey AS doc_id, 'MDPP300' AS code, 'info' AS severity, 'fence info-string should be lowercase' AS message, 1 AS line FROM part WHERE p_partkey % 6 IN (1, 3)")(_linted(corpora.fenced, "MDPP300"))
SKIPS = """h AS (SELECT l_orderkey AS doc_id, row_number() OVER o AS nth, CAST(l_quantity AS INT) % 4 + 1 AS l, 'flag-' || lower(l_returnflag) || '-' || (CAST(l_quantity AS INT) % 4 + 1) AS slug
FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity))"""
query("lint_heading_skip", f"WITH {SKIPS}, p AS (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY nth) AS b FROM h) SELECT doc_id, 'MDPP200' AS code, 'warning' AS severity, 'heading level skips from h' || b || ' to h' || l AS message, 2 * nth - 1 AS line FROM p WHERE l > b + 1")(_linted(corpora.skipping, "MDPP200"))
query("lint_duplicate_heading", f"WITH {SKIPS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY nth) AS k FROM h) SELECT doc_id, 'MDPP103' AS code, 'warning' AS severity, 'duplicate heading id #' || slug AS message, 2 * nth - 1 AS line FROM p WHERE k > 1")(_linted(corpora.skipping, "MDPP103"))


# ---------------------------------------------------------------- conversions, positions, edits


@query("html_outline", f"WITH {OUTLINE} SELECT doc_id, string_agg('<h' || level || ' id=\"' || slug || '\">' || text || '</h' || level || '>' || chr(10), '' ORDER BY ord) AS html FROM h GROUP BY 1")
def html_outline(spark, d):
    from quillspark.functions.render import Options

    return convert.html(corpora.outline(spark, d), Options(heading_ids=True))


@query(
    "html_table",
    """SELECT n_regionkey AS doc_id, '<div class="mdpp-table">' || chr(10) || '<table>' || chr(10) || '<colgroup>' || chr(10) || '<col style="text-align:left" />' || chr(10) || '<col style="text-align:right" />' || chr(10) || '</colgroup>' || chr(10)
|| '<thead>' || chr(10) || '<tr><th scope="col" style="text-align:left">Nation</th><th scope="col" style="text-align:right">Key</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10)
|| string_agg('<tr><td style="text-align:left">' || n_name || '</td><td style="text-align:right">' || n_nationkey || '</td></tr>' || chr(10), '' ORDER BY n_nationkey) || '</tbody>' || chr(10) || '</table>' || chr(10) || '</div>' || chr(10) AS html FROM nation GROUP BY 1""",
)
def html_table(spark, d):
    return convert.html(corpora.pipe_table(spark, d))


@query("html_tasks", "SELECT o_custkey AS doc_id, '<ul>' || chr(10) || string_agg('<li class=\"task-list-item\"><input type=\"checkbox\" disabled' || CASE WHEN o_orderstatus = 'F' THEN ' checked' ELSE '' END || ' />order ' || o_orderkey || '</li>' || chr(10), '' ORDER BY o_orderkey) || '</ul>' || chr(10) AS html FROM orders GROUP BY 1")
def html_tasks(spark, d):
    return convert.html(corpora.task_list(spark, d))


@query("html_admonitions", "SELECT o_orderkey AS doc_id, '<div class=\"admonition admonition-' || CASE o_orderkey % 5 WHEN 0 THEN 'important' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' WHEN 3 THEN 'tip' ELSE 'caution' END || '\"><p class=\"admonition-title\">Order ' || o_orderkey || '</p><p>status ' || o_orderstatus || chr(10) || 'lazy line</p>' || chr(10) || '</div>' || chr(10) AS html FROM orders")
def html_admonitions(spark, d):
    return convert.html(corpora.admonitions(spark, d))


@query("html_embeds", f"SELECT p_partkey AS doc_id, '<div class=\"mdpp-embed mdpp-embed-' || p || '\" data-src=\"' || s || '\" data-provider=\"' || p || '\"><a href=\"' || s || '\">' || s || '</a></div>' || chr(10) AS html FROM (SELECT p_partkey, {_PROVIDER} AS p, 'https://' || CASE p_partkey % 10 {_HOST} END || p_partkey AS s FROM part)")
def html_embeds(spark, d):
    return convert.html(corpora.embeds(spark, d))


UNTIDY = "'# ' || n_name || chr(10) || chr(10) || '- key ' || n_nationkey || chr(10) || '- **region** ' || n_regionkey || chr(10) || chr(10) || '``` sql' || chr(10) || 'select 1;' || chr(10) || '```' || chr(10) || '## End' || chr(10)"


@query("formatted", f"SELECT n_nationkey AS doc_id, {UNTIDY} AS formatted, true AS changed FROM nation")
def formatted(spark, d):
    return convert.formatted(corpora.untidy(spark, d)).drop("source")


@query("format_is_stable", f"SELECT n_nationkey AS doc_id, {UNTIDY} AS formatted, false AS changed FROM nation")
def format_is_stable(spark, d):
    once = convert.formatted(corpora.untidy(spark, d)).select("doc_id", F.col("formatted").alias("source"))
    return convert.formatted(once).drop("source")


@query("format_diffs", f"""SELECT n_nationkey AS doc_id, '--- ' || n_nationkey || chr(10) || '+++ ' || n_nationkey || ' (formatted)' || chr(10) || '@@' || chr(10)
|| '-' || replace(n_name || chr(10) || '=====' || chr(10) || chr(10) || chr(10) || chr(10) || '* key ' || n_nationkey || chr(10) || '* __region__ ' || n_regionkey || chr(10) || chr(10) || '~~~SQL' || chr(10) || 'select 1;' || chr(10) || '~~~' || chr(10) || '## End ##' || chr(10), chr(10), chr(10) || '-') || chr(10) || '+' || replace({UNTIDY}, chr(10), chr(10) || '+') AS diff FROM nation""")
def format_diffs(spark, d):
    return convert.diffs(corpora.untidy(spark, d))


_FRONT = "'title: ' || c_name || chr(10) || 'segment: \"' || c_mktsegment || '\"' || chr(10) || 'mdpp: ' || v"
_SPAN = "'{{\"start_byte\":' || {0} || ',\"end_byte\":' || {1} || ',\"start_line\":' || {2} || ',\"start_col\":1,\"end_line\":' || {3} || ',\"end_col\":' || {4} || '}}'"


@query("tree_json", f"""SELECT doc_id, '{{"file":"' || doc_id || '","root":{{"type":"Document","range":' || {_SPAN.format("0", "n + 8 + length(body) + 1", 1, 7, 1)} || ',"children":[{{"type":"Frontmatter","literal":"' || replace(replace(front, '"', '\\"'), chr(10), '\\n') || '","range":' || {_SPAN.format("0", "n + 8", 1, 6, 1)} || '}},{{"type":"Paragraph","range":' || {_SPAN.format("n + 8", "n + 9 + length(body)", 6, 7, 1)} || ',"children":[{{"type":"Text","literal":"' || body || '","range":' || {_SPAN.format("n + 8", "n + 8 + length(body)", 6, 6, "1 + length(body)")} || '}}]}}]}},"frontmatter":{{"mdpp":' || v || ',"segment":"' || c_mktsegment || '","title":"' || c_name || '"}}}}' AS json
FROM (SELECT *, length(front) + 1 AS n FROM (SELECT c_custkey AS doc_id, c_name, c_mktsegment, v, {_FRONT} AS front, 'Customer ' || c_custkey || '.' AS body FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN '0.2' ELSE '0.1' END AS v FROM customer)))""")
def tree_json(spark, d):
    return convert.tree_json(corpora.fronted(spark, d))


@query("folding_ranges", "SELECT o_custkey AS doc_id, 1 AS start_line, count(*) AS end_line, 'region' AS kind FROM orders GROUP BY 1 HAVING count(*) > 1")
def folding_ranges(spark, d):
    return navigate.folding_ranges(parsed(corpora.task_list(spark, d)))


@query("document_symbols", f"WITH {OUTLINE} SELECT doc_id, 'Heading' AS kind, text AS name, ord, CASE WHEN level > 1 THEN (SELECT max(b.ord) FROM h b WHERE b.doc_id = h.doc_id AND b.ord < h.ord AND b.level < h.level) END AS parent_ord FROM h")
def document_symbols(spark, d):
    return navigate.document_symbols(parsed(corpora.outline(spark, d)))


@query("named_places", "SELECT l_orderkey AS doc_id, 'n' || l_linenumber AS name, CASE WHEN l_linenumber % 4 <> 0 THEN 1 ELSE 0 END AS defs, count(*) AS uses FROM lineitem GROUP BY l_orderkey, l_linenumber")
def named_places(spark, d):
    s = navigate.symbols_used(parsed(corpora.footnoted(spark, d))).where("kind = 'footnote'")
    return s.groupBy("doc_id", "name").agg(F.count(F.when(F.col("role") == "def", 1)).alias("defs"), F.count(F.when(F.col("role") == "use", 1)).alias("uses"))


@query(
    "semantic_tokens",
    """WITH p AS (SELECT p_partkey AS doc_id, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 3 THEN 'Go' ELSE 'sql' END AS g FROM part WHERE p_partkey % 6 IN (0, 3, 5))
SELECT doc_id, v.line, 0 AS start, CASE v.line WHEN 0 THEN 3 + len(g) WHEN 1 THEN 5 WHEN 2 THEN 7 + len(CAST(doc_id AS VARCHAR)) ELSE 3 END AS length, 'string' AS type, 4096 AS modifiers, CASE WHEN v.line = 0 THEN 0 ELSE 1 END AS delta_line, 0 AS delta_start FROM p, (VALUES (0), (1), (2), (3)) v(line)""",
)
def semantic_tokens(spark, d):
    return navigate.semantic_tokens(corpora.fenced(spark, d))


@query("positions_to_offsets", "SELECT doc_id, 0 AS line, 7 AS character, strlen(substr(string_split(coalesce(text, ''), chr(10))[1], 1, 7)) AS \"offset\" FROM documents")
def positions_to_offsets(spark, d):
    docs = corpora.prose(spark, d)
    at = docs.select("doc_id", F.lit(0).alias("line"), F.lit(7).alias("character"))
    return navigate.to_offsets(docs, at)


@query("definitions_at", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER w AS nth, CASE WHEN o_orderkey % 3 <> 0 THEN '[o' || o_orderkey || ']: https://orders.example/' || o_orderkey ELSE '' END AS def,
  sum(length('See [order ' || o_orderkey || '][o' || o_orderkey || '] first.') + 1) OVER (PARTITION BY o_custkey) + 2 AS body FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT doc_id, 13 + length(CAST(k AS VARCHAR)) AS "offset", 'label' AS kind, 'o' || k AS name, body AS start_byte, body + length(def) AS end_byte FROM o WHERE nth = 1 AND def <> ''""")
def definitions_at(spark, d):
    """What the first reference of each document leads to."""
    docs = corpora.reference_links(spark, d)
    at = docs.select("doc_id", (F.expr("locate('][o', source)") + 1).alias("offset"))
    return navigate.definition(parsed(docs), at)


def _edit_events(spark: SparkSession, d: str) -> DataFrame:
    """Each order writes its key at the head of its customer's document."""
    o = corpora.table(spark, d, "orders")
    uri = F.concat(F.lit("c"), F.col("o_custkey"))
    none = F.lit(None).cast("int")
    opened = o.select(uri.alias("uri")).distinct().select("uri", F.lit(0).alias("version"), F.lit(-1).cast("long").alias("seq"), F.lit("open").alias("kind"), none.alias("start_line"), none.alias("start_char"), none.alias("end_line"), none.alias("end_char"), F.lit("").alias("text"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    zero = F.lit(0)
    changes = o.select(uri.alias("uri"), nth.alias("version"), F.col("o_orderkey").cast("long").alias("seq"), F.lit("change").alias("kind"), zero.alias("start_line"), zero.alias("start_char"), zero.alias("end_line"), zero.alias("end_char"), F.concat(F.col("o_orderkey"), F.lit(";")).alias("text"))
    return opened.union(changes)


_EDITED = "SELECT 'c' || o_custkey AS uri, string_agg(o_orderkey || ';', '' ORDER BY o_orderkey DESC) AS source, count(*) AS version FROM orders GROUP BY 1"


@query("edits_replayed", _EDITED)
def edits_replayed(spark, d):
    return edits.latest(_edit_events(spark, d)).select("uri", "source", "version")


@query("edits_streamed", _EDITED)
def edits_streamed(spark, d):
    """The same events as a stream of files in two micro-batches, with each document's text as keyed state."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    every = kept(_edit_events(spark, d), "events")
    cut = every.where("seq >= 0").agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    for part in (every.where(F.col("seq") <= cut), every.where(F.col("seq") > cut)):
        part.write.mode("append").json(f"{at}/in")
        found = edits.documents(files.stream_events(spark, f"{at}/in"))
        sink = found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(edits.RESULTS).parquet(f"{at}/out")
    return states.groupBy("uri").agg(F.max_by("source", "seq").alias("source"), F.max_by("version", "seq").alias("version"))


@query("node_paths", "SELECT r_regionkey AS doc_id, 3 AS \"offset\", v.depth, v.type FROM region, (VALUES (0, 'Document'), (1, 'Heading'), (2, 'Text')) v(depth, type)")
def node_paths(spark, d):
    """What holds the second letter of each document's first heading, from the root down."""
    p = parsed(corpora.outline(spark, d))
    return extract.path_at(p, p.select("doc_id", F.lit(3).alias("offset"))).drop("node_id")


@query("code_actions", f"""WITH {LINKS}, g AS (SELECT doc_id, CASE WHEN bool_or(k % 3 <> 0 OR k % 5 = 0) THEN chr(10) ELSE '' END AS gap FROM use GROUP BY 1)
SELECT doc_id, 'Create missing reference definition' AS title, gap || '[o' || k || ']: ' AS new_text FROM use JOIN g USING (doc_id) WHERE k % 3 = 0 UNION ALL SELECT doc_id, 'Fix MDPP105: link reference [u' || k || '] is never used', '' FROM use WHERE k % 5 = 0
UNION ALL SELECT doc_id, 'Convert reference link to inline link', '[order ' || k || '](https://orders.example/' || k || ')' FROM use WHERE k % 3 <> 0""")
def code_actions(spark, d):
    return navigate.code_actions(parsed(corpora.reference_links(spark, d)), only=("quickfix",)).select("doc_id", "title", "new_text")


@query("lint_reports", f"WITH {LINKS} SELECT doc_id, '::error file=' || doc_id || ',line=' || n || ',col=5,title=MDPP106::reference link [o' || k || '] has no definition' AS report FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM use) WHERE k % 3 = 0")
def lint_reports(spark, d):
    found = lint.lint(parsed(corpora.reference_links(spark, d)), ["MDPP106"])
    return lint.reported(found, "github").select("doc_id", "report")


@query("lint_fixed", "SELECT p_partkey AS doc_id, '```' || CASE p_partkey % 6 WHEN 1 THEN 'mermaid' ELSE 'go' END || chr(10) || 'gantt' || chr(10) || '  part ' || p_partkey || chr(10) || '```' || chr(10) AS source FROM part WHERE p_partkey % 6 IN (1, 3)")
def lint_fixed(spark, d):
    p = parsed(corpora.fenced(spark, d))
    return lint.fixed(p, lint.lint(p, ["MDPP300"])).where("n_edits > 0").select("doc_id", "source")


# ---------------------------------------------------------------- samples: each construct by itself, once a nation


def literal(value: str | int | None) -> str:
    """A value as SQL writes it."""
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


def sampled(spark: SparkSession, d: str, rows: list[tuple[str, ...]], *names: str) -> DataFrame:
    """doc_id (name/nation), source and the other named strings of each sample, for each nation."""
    nation = corpora.table(spark, d, "nation")
    each = nation.select("n_nationkey", "n_name", F.explode(F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("name", "source", *names), r, strict=True))) for r in rows))).alias("s"))
    put = lambda c: F.replace(F.col(f"s.{c}"), F.lit("@"), F.col("n_name"))
    return each.select(F.concat("s.name", F.lit("/"), F.col("n_nationkey")).alias("doc_id"), *(put(c).alias(c) for c in ("source", *names)))


def expected(columns: str, rows: list[tuple], put: str = "") -> str:
    """SQL over nation: a row for each (name, ...) and nation; {} in `put` is a column in which @ becomes the name."""
    names = columns.split(", ")
    shown = ", ".join(f"replace({n}, '@', n_name) AS {n}" if n in put.split(", ") else n for n in names)
    return f"SELECT name || '/' || n_nationkey AS doc_id, {shown} FROM nation, (VALUES {values(rows)}) v(name, {columns})"


@query("html_samples", expected("html", [(n, h) for n, _, h in samples.HTML], "html"))
def html_samples(spark, d):
    return convert.html(sampled(spark, d, [(n, s) for n, s, _ in samples.HTML]))


@query("html_options", expected("html", [(n, h) for n, _, _, h in samples.WITH_OPTIONS], "html"))
def html_options(spark, d):
    from quillspark.functions.render import Options

    parts = [convert.html(sampled(spark, d, [(n, s)]), Options(**o)) for n, s, o, _ in samples.WITH_OPTIONS]
    return reduce(DataFrame.union, parts)


@query("format_samples", expected("formatted", [(n, f) for n, _, f in samples.FORMAT], "formatted"))
def format_samples(spark, d):
    return convert.formatted(sampled(spark, d, [(n, s) for n, s, _ in samples.FORMAT])).select("doc_id", "formatted")


@query("format_samples_stable", "SELECT 25 * 0 AS changed, count(*) * " + str(len(samples.FORMAT)) + " AS documents FROM nation")
def format_samples_stable(spark, d):
    """Formatting what is formatted changes nothing."""
    once = convert.formatted(sampled(spark, d, [(n, s) for n, s, _ in samples.FORMAT])).select("doc_id", F.col("formatted").alias("source"))
    return convert.formatted(once).agg(F.count(F.when(F.col("changed"), 1)).alias("changed"), F.count("*").alias("documents"))


def _linted_samples(spark: SparkSession, d: str) -> DataFrame:
    return lint.lint(parsed(sampled(spark, d, [(n, s) for n, s, _ in samples.LINT])))


_FINDINGS = [(n, c, lint.SEVERITY[c], m, i, k) for n, _, found in samples.LINT for c, m, i, k in found]
# columns on a line that the nation's name stands before, in which it is counted as one character
_SHIFTED = "CASE WHEN name IN ('trailing_space', 'undefined_footnote', 'autolink', 'empty_link', 'in_code') THEN col - 8 + length(n_name) ELSE col END"


@query("lint_samples", f"SELECT name || '/' || n_nationkey AS doc_id, code, severity, message, line, {_SHIFTED} AS col FROM nation, (VALUES {values(_FINDINGS)}) v(name, code, severity, message, line, col)")
def lint_samples(spark, d):
    return _linted_samples(spark, d).select("doc_id", "code", "severity", "message", "line", "col")


@query("lint_all_rules", f"SELECT code, severity, count(*) * 25 AS n FROM (VALUES {values(_FINDINGS)}) v(name, code, severity, message, line, col) GROUP BY 1, 2")
def lint_all_rules(spark, d):
    """Every rule at once; found counts a rule and severity."""
    return _linted_samples(spark, d).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("lint_text_reports", f"SELECT name || '/' || n_nationkey AS doc_id, name || '/' || n_nationkey || ':' || line || ':' || {_SHIFTED} || ': ' || severity || ' ' || code || ': ' || message AS report FROM nation, (VALUES {values(_FINDINGS)}) v(name, code, severity, message, line, col)")
def lint_text_reports(spark, d):
    return lint.reported(_linted_samples(spark, d), "text").select("doc_id", "report")


@query("lint_json_reports", """SELECT 'f/' || n_nationkey AS doc_id, '{"file":"f/' || n_nationkey || '","code":"MDPP300","severity":"info","message":"fence info-string should be lowercase","range":{"start_byte":3,"end_byte":5,"start_line":1,"start_col":4,"end_line":1,"end_col":6},"fix":{"range":{"start_byte":3,"end_byte":5,"start_line":1,"start_col":4,"end_line":1,"end_col":6},"new_text":"go"}}' AS report FROM nation
UNION ALL SELECT 'h/' || n_nationkey, '{"file":"h/' || n_nationkey || '","code":"MDPP103","severity":"warning","message":"duplicate heading id #a","range":{"start_byte":5,"end_byte":9,"start_line":3,"start_col":1,"end_line":4,"end_col":1},"related":[{"message":"first heading with this id","start_byte":0,"end_byte":4,"line":1,"col":1}]}' FROM nation""")
def lint_json_reports(spark, d):
    return lint.reported(lint.lint(parsed(sampled(spark, d, [("f", "```Go\nx\n```\n"), ("h", "# A\n\n# A\n")]))), "json").select("doc_id", "report")


@query("lint_filters", "SELECT 'MDPP100' AS code, count(*) AS n FROM nation UNION ALL SELECT 'MDPP102', 2 * count(*) FROM nation")
def lint_filters(spark, d):
    """Chosen rules, without one of them, from a severity up."""
    p = parsed(sampled(spark, d, [(n, s) for n, s, _ in samples.LINT]))
    found = lint.lint(p, ["MDPP100", "MDPP102", "MDPP106", "MDPP103"], ["MDPP106"], least="error")
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query("parse_diagnostics", "SELECT 'open/' || n_nationkey AS doc_id, 'MDPP-PARSE-002' AS code, 'warning' AS severity, 1 AS line FROM nation UNION ALL SELECT 'jump/' || n_nationkey, 'MDPP-PARSE-000', 'error', 1 FROM nation")
def parse_diagnostics(spark, d):
    """An unclosed container, and a list that the parser fails on."""
    p = parsed(sampled(spark, d, [("open", ":::note\n@\n"), ("jump", "- a\n      - b\n          - c\n            - @\n"), ("fine", "@\n")]))
    none = lint.lint(p, ["MDPP104"])
    return lint.with_parse_diagnostics(p, none, least="warning").select("doc_id", "code", "severity", "line")


def at_needle(docs: DataFrame, needle: str = "needle") -> DataFrame:
    """doc_id, offset: the byte at which the needle stands first."""
    return docs.select("doc_id", F.octet_length(F.expr(f"substring_index(source, {needle}, 1)")).alias("offset"))


@query("hover_cards", f"SELECT name || '/' || n_nationkey AS doc_id, replace(replace(card, '@', n_name), '%', lower(replace(n_name, '_', '-'))) AS card FROM nation, (VALUES {values([(n, c) for n, _, _, c in samples.HOVER if c])}) v(name, card)")
def hover_cards(spark, d):
    docs = sampled(spark, d, [r[:3] for r in samples.HOVER], "needle")
    return navigate.hover(parsed(docs), at_needle(docs)).select("doc_id", "card")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places with the text that stands there."""
    own = F.decode(F.expr("substring(encode(source, 'utf-8'), start_byte + 1, end_byte - start_byte)"), "utf-8")
    return places.join(docs.select("doc_id", "source"), "doc_id").withColumn("text", own)


@query("definition_places", expected("text", [(n, t) for n, _, _, t, _ in samples.PLACES if t], "text"))
def definition_places(spark, d):
    docs = sampled(spark, d, [r[:3] for r in samples.PLACES], "needle")
    return _texts(docs, navigate.definition(parsed(docs), at_needle(docs))).select("doc_id", "text")


@query("reference_places", expected("role, text", [(n, role, t) for n, _, _, _, found in samples.PLACES for role, t in found], "text"))
def reference_places(spark, d):
    docs = sampled(spark, d, [r[:3] for r in samples.PLACES], "needle")
    return _texts(docs, navigate.references(parsed(docs), at_needle(docs))).select("doc_id", "role", "text")


@query("renamed", expected("source", [(n, s) for n, _, _, _, s in samples.RENAMES], "source"))
def renamed(spark, d):
    docs = sampled(spark, d, [r[:4] for r in samples.RENAMES], "needle", "new_name")
    p = parsed(docs)
    targets = at_needle(docs).join(docs.select("doc_id", "new_name"), "doc_id")
    edits_of = navigate.rename(p, targets).select("doc_id", "start_byte", "end_byte", "new_text")
    return lint.fixed(p, edits_of).select("doc_id", "source")


@query("rename_prepared", expected("text", [("heading", "Old"), ("anchor", "#old"), ("footnote", "a"), ("label", "ref")]))
def rename_prepared(spark, d):
    docs = sampled(spark, d, [r[:3] for r in samples.RENAMES], "needle")
    return _texts(docs, navigate.prepare_rename(parsed(docs), at_needle(docs))).select("doc_id", "text")


@query("completions", expected("label, insert_text", [(n, a, b) for n, _, _, found in samples.COMPLETIONS for a, b in found]))
def completions(spark, d):
    docs = sampled(spark, d, [r[:3] for r in samples.COMPLETIONS], "needle")
    # the pointer stands after the needle; in frontmatter after its first line's end
    at = docs.select("doc_id", F.when(F.col("doc_id").startswith("frontmatter"), F.lit(0)).otherwise(F.octet_length(F.expr("substring_index(source, needle, 1)"))).alias("a"), F.octet_length("needle").alias("n"))
    offsets = at.select("doc_id", F.when(F.col("doc_id").startswith("frontmatter_keys/"), F.lit(13)).when(F.col("doc_id").startswith("frontmatter/"), F.lit(0)).otherwise(F.col("a") + F.col("n")).alias("offset"))
    found = navigate.completions(parsed(docs), offsets.where("offset > 0"))
    return found.where("not (doc_id like 'frontmatter_keys/%' and label not like 't%')").select("doc_id", "label", F.col("insert").alias("insert_text"))


@query("folds", expected("start_line, end_line, kind", [(n, *f) for n, _, found in samples.FOLDS for f in found]))
def folds(spark, d):
    return navigate.folding_ranges(parsed(sampled(spark, d, [r[:2] for r in samples.FOLDS])))


@query("symbol_samples", expected("kind, symbol, ord, parent_ord", [(n, *f) for n, _, found in samples.SYMBOLS for f in found]))
def symbol_samples(spark, d):
    return navigate.document_symbols(parsed(sampled(spark, d, [r[:2] for r in samples.SYMBOLS]))).select("doc_id", "kind", F.col("name").alias("symbol"), "ord", "parent_ord")


_WIDE = "CASE WHEN (name, line, start) IN (('table', 2, 6), ('links', 0, 7), ('directives', 4, 2)) THEN length - 8 + length(n_name) ELSE length END"
_MOVED = "CASE WHEN (name, line) IN (('footnotes', 0)) OR (name, line, start) = ('links', 0, 24) THEN start - 8 + length(n_name) ELSE start END"


@query("token_samples", f"SELECT name || '/' || n_nationkey AS doc_id, line, {_MOVED} AS start, {_WIDE} AS length, type, modifiers FROM nation, (VALUES {values([(n, *t) for n, _, found in samples.TOKENS for t in found])}) v(name, line, start, length, type, modifiers)")
def token_samples(spark, d):
    return navigate.semantic_tokens(sampled(spark, d, [r[:2] for r in samples.TOKENS])).drop("delta_line", "delta_start")


@query("token_ranges", "SELECT 'r/' || n_nationkey AS doc_id, 2 AS line, 2 AS start, length(n_name) AS length, 'heading' AS type, 1 AS modifiers FROM nation")
def token_ranges(spark, d):
    """Only what lies behind the first ten bytes."""
    return navigate.semantic_tokens(sampled(spark, d, [("r", "# First\n\n# @\n")]), 9).drop("delta_line", "delta_start")


@query("action_samples", expected("title, kind, new_text", [(n, *a) for n, _, _, found in samples.ACTIONS for a in found], "title, new_text"))
def action_samples(spark, d):
    parts = [navigate.code_actions(sampled(spark, d, [(n, s)]).transform(parsed), only=only) for n, s, only, _ in samples.ACTIONS]
    return reduce(DataFrame.union, parts).select("doc_id", "title", "kind", "new_text")


@query("actions_in_range", "SELECT 'a/' || n_nationkey AS doc_id, 'Fix MD009: trailing whitespace' AS title FROM nation")
def actions_in_range(spark, d):
    """Two findings, one of them in the range that is asked for."""
    p = parsed(sampled(spark, d, [("a", "@ \n\n[u]: /u\n")]))
    ranges = p.select("doc_id", F.lit(0).alias("from_byte"), F.expr("locate('\n', source)").alias("to_byte"))
    return navigate.code_actions(p, ranges, ("quickfix",)).select("doc_id", "title")


@query("utf16_positions", "SELECT n_nationkey AS doc_id, v.line, v.character, CASE v.line WHEN 0 THEN v.off ELSE v.off + 7 + length(n_name) END AS \"offset\" FROM nation, (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 6), (1, 0, 0), (1, 1, 1), (1, 2, 3), (1, 9, 3)) v(line, character, off)")
def utf16_positions(spark, d):
    """Positions before, inside and after a pair, and past a line's end."""
    docs = corpora.table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("ab\U0001f600"), "n_name", F.lit("\nzé\n")).alias("source"))
    at = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(a).alias("line"), F.lit(b).alias("character")) for a, b in ((0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1), (1, 2), (1, 9))))).alias("p")).select("doc_id", "p.line", "p.character")
    return navigate.to_offsets(docs, at)


@query("frontmatter_values", "SELECT 'y/' || n_nationkey AS doc_id, n_name AS author, 'b' AS second_tag, '0.1' AS version, 3 AS keys FROM nation")
def frontmatter_values(spark, d):
    """Nested maps, lists and numbers; a document whose frontmatter isn't well formed has none."""
    p = parsed(sampled(spark, d, [("y", "---\nauthor:\n  name: @\ntags:\n  - a\n  - b\nmdpp: 0.10\n---\nx\n"), ("bad", "---\ntitle: [@\n---\nx\n"), ("twice", "---\na: 1\na: 2\n---\n@\n")]))
    keys = extract.frontmatter(p).groupBy("doc_id").agg(F.count("*").alias("keys"))
    named = extract.frontmatter_value(p, "$.author.name").withColumnRenamed("value", "author")
    tag = extract.frontmatter_value(p, "$.tags[1]").withColumnRenamed("value", "second_tag")
    return named.join(tag, "doc_id").join(extract.format_version(p).drop("off"), "doc_id").join(keys, "doc_id")


@query("previews", "SELECT 'p/' || n_nationkey AS doc_id, '<h1 id=\"' || lower(replace(n_name, '_', '-')) || '\" data-mdpp-source-start-byte=\"23\" data-mdpp-source-end-byte=\"' || 26 + length(n_name) || '\" data-mdpp-source-start-line=\"5\" data-mdpp-source-start-col=\"1\" data-mdpp-source-end-line=\"6\" data-mdpp-source-end-col=\"1\">' || n_name || '</h1>' || chr(10) AS html, '{\"mdpp\":0.1,\"x\":\"y\"}' AS frontmatter, '0.1' AS version, lower(replace(n_name, '_', '-')) AS first_id FROM nation")
def previews(spark, d):
    found = convert.previewed(sampled(spark, d, [("p", "---\nx: y\nmdpp: 0.1\n---\n# @\n")]))
    return found.select("doc_id", "html", "frontmatter", "version", F.col("toc")[0]["id"].alias("first_id"))


@query("pages_to_print", "SELECT 'p/' || n_nationkey AS doc_id, '<style>' || 'body' AS opening, '</style></head><body><p>' || n_name || '</p>' || chr(10) || '</body></html>' AS ending, '{\"paperWidth\":8.27,\"paperHeight\":11.69,\"marginTop\":1.0,\"marginRight\":0.0,\"marginBottom\":0.0,\"marginLeft\":0.0,\"printBackground\":true,\"displayHeaderFooter\":true,\"headerTemplate\":\"\",\"footerTemplate\":\"<b>x</b>\"}' AS settings FROM nation")
def pages_to_print(spark, d):
    page = convert.Page(paper="a4", margins=(1.0, 0.0, 0.0, 0.0), footer="<b>x</b>", background=True)
    found = convert.printable(sampled(spark, d, [("p", "@\n")]), css="p{}", page=page)
    return found.select("doc_id", F.regexp_extract("page", "(<style>body)", 1).alias("opening"), F.regexp_replace(F.regexp_extract("page", r"(?s)(p\{\}</style>.*)", 1), r"^p\{\}", "").alias("ending"), "settings")


@query("rpc_events", "SELECT 'doc' || o_custkey AS uri, count(*) AS version, string_agg(o_orderkey, ',' ORDER BY o_orderkey) || '.' AS source FROM orders GROUP BY 1")
def rpc_events(spark, d):
    """Each customer's document is opened and its orders are appended, as notifications of an editor."""
    o = corpora.table(spark, d, "orders")
    uri = F.concat(F.lit("doc"), F.col("o_custkey"))
    one = lambda method, doc, more: F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit(f"textDocument/{method}").alias("method"), F.struct(doc.alias("textDocument"), *more).alias("params")))
    opened = o.select(uri.alias("uri")).distinct().select(F.lit(-1).cast("long").alias("seq"), one("didOpen", F.struct("uri", F.lit(0).alias("version"), F.lit(".").alias("text")), []).alias("message"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    # the place before the last character: whatever lies past a line's end is the line's end
    far = F.struct(F.lit(0).alias("line"), F.col("at").alias("character"))
    grown = o.withColumns({"n": nth, "text": F.concat(F.when(nth > 1, ",").otherwise(""), F.col("o_orderkey").cast("string"))})
    grown = grown.withColumn("at", F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    change = F.array(F.struct(F.struct(far.alias("start"), far.alias("end")).alias("range"), F.col("text")))
    changes = grown.select(F.col("o_orderkey").cast("long").alias("seq"), one("didChange", F.struct(uri.alias("uri"), F.col("n").alias("version")), [change.alias("contentChanges")]).alias("message"))
    return edits.latest(files.edit_events(opened.union(changes))).select("uri", "version", "source")


@query("markdown_files", f"WITH {OUTLINE} SELECT level, text, slug FROM h")
def markdown_files(spark, d):
    """Documents written as files, one each, and read back."""
    path = f"{shared_dir(spark)}/markdown-{uuid.uuid4().hex}"
    files.write_text(corpora.outline(spark, d).repartition("doc_id"), "source", path)
    return extract.headings(parsed(files.read_markdown(spark, path))).select("level", "text", "slug")


_HEADING_RANGE = '{"start":{"line":0,"character":0},"end":{"line":1,"character":0}}'


@query("server_responses", f"""SELECT n_nationkey * 10 + v.k AS seq, '{{"jsonrpc":"2.0","id":' || v.k || replace(v.r, '@', n_name) || '}}' AS response FROM nation, (VALUES
(0, ',"result":{{"contents":{{"kind":"markdown","value":"**Link**\\n\\n`http://x.y/@`"}}}}'), (1, ',"result":[{{"uri":"doc@","range":{_HEADING_RANGE}}}]'),
(2, ',"result":[{{"startLine":0,"endLine":4,"kind":"region"}}]'), (3, ',"error":{{"code":-32601,"message":"method not found"}}'), (4, ',"error":{{"code":-32602,"message":"document is not open"}}'), (5, ',"result":null'),
(6, ',"result":{{"data":[0,2,3,5,1,2,0,9,6,576,0,10,' || 16 + length(n_name) || ',6,576]}}')) v(k, r)""")
def server_responses(spark, d):
    """Requests about a document a nation: a card, a definition, folds, an unknown method, a closed document, nothing to say, tokens."""
    docs = sampled(spark, d, [("doc", "# Top\n\n[t](#top) [l](http://x.y/@)\n\nend\n")]).join(corpora.table(spark, d, "nation"), F.col("doc_id") == F.concat(F.lit("doc/"), F.col("n_nationkey")))
    docs = docs.select("n_nationkey", F.concat(F.lit("doc"), "n_name").alias("doc_id"), "source")
    calls = (("textDocument/hover", 2, 15, ""), ("textDocument/definition", 2, 5, ""), ("textDocument/foldingRange", 0, 0, ""), ("textDocument/nothing", 0, 0, ""), ("textDocument/hover", 0, 0, "closed"), ("textDocument/hover", 4, 1, ""), ("textDocument/semanticTokens/full", 0, 0, ""))
    call = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("method"), F.lit(a).alias("line"), F.lit(b).alias("character"), F.lit(c).alias("other")) for k, (m, a, b, c) in enumerate(calls))))
    rows = docs.select("n_nationkey", "doc_id", call.alias("c"))
    uri = F.concat(F.col("doc_id"), F.col("c.other"))
    message = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("c.k").alias("id"), F.col("c.method").alias("method"), F.struct(F.struct(uri.alias("uri")).alias("textDocument"), F.struct("c.line", "c.character").alias("position")).alias("params")))
    batch = rows.select((F.col("n_nationkey") * 10 + F.col("c.k")).alias("seq"), message.alias("message"))
    return server.answered(server.requests(batch), docs.select("doc_id", "source"))


@query("html_highlighted", "SELECT 'c/' || n_nationkey AS doc_id, '<pre><code class=\"language-python\"><span class=\"hl-keyword\">def</span> <span class=\"hl-function\">f</span><span class=\"hl-punctuation\">(</span>x<span class=\"hl-punctuation\">)</span><span class=\"hl-punctuation\">:</span>  <span class=\"hl-comment\"># ' || n_name || '</span>' || chr(10) || '    <span class=\"hl-keyword\">return</span> x <span class=\"hl-operator\">+</span> <span class=\"hl-number\">1</span> <span class=\"hl-operator\">&lt;</span> <span class=\"hl-string\">&#34;a&#34;</span>' || chr(10) || '</code></pre>' || chr(10) AS html FROM nation UNION ALL SELECT 'n/' || n_nationkey, '<pre><code class=\"language-unknown\">if ' || n_name || chr(10) || '</code></pre>' || chr(10) FROM nation")
def html_highlighted(spark, d):
    from quillspark.functions.highlight import highlight
    from quillspark.functions.render import Options

    return convert.html(sampled(spark, d, [("c", "```python\ndef f(x):  # @\n    return x + 1 < \"a\"\n```\n"), ("n", "```unknown\nif @\n```\n")]), Options(highlight=highlight))


@query("chunked_paragraphs", "SELECT 'long/' || n_nationkey AS doc_id, 2 AS stars, 0 AS emphases FROM nation UNION ALL SELECT 'short/' || n_nationkey, 0, 1 FROM nation")
def chunked_paragraphs(spark, d):
    """Emphasis over a chunk's end stays text; inside a chunk it doesn't."""
    filler = "word, " * 60
    p = parsed(sampled(spark, d, [("long", f"*{filler}@*\n"), ("short", "*@*\n")]), chunked=True)
    stars = F.length("t") - F.length(F.replace("t", F.lit("*"), F.lit("")))
    text = extract.text_of(p, "Paragraph").select("doc_id", F.col("text").alias("t")).select("doc_id", stars.alias("stars"))
    count = p.select("doc_id", F.size(F.filter("nodes", lambda n: n["type"] == "Emphasis")).alias("emphases"))
    return text.join(count, "doc_id")
