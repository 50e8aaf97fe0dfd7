"""The DataFrame operators: lint rules, edits, sources, and registered queries against their SQL."""

import json
import os

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as E
from quillspark.operators import convert, extract, lint, navigate
from quillspark.plans.nodes import bounded, parsed
from quillspark.sources import files
from quillspark.streaming import edits

SF = "/root/testdata/sf0.001"
POSITIVE = [
    ("MD004", "- a\n* b\n"), ("MD009", "a \n"), ("MD012", "a\n\n\n\nb\n"), ("MD034", "go to https://a.b/c now\n"), ("MD045", "![ ](x.png)\n"), ("MD049", "*a* _b_\n"),
    ("MDPP100", "x[^a]\n"), ("MDPP101", "x\n\n[^a]: note\n"), ("MDPP102", "[a](#nope)\n"), ("MDPP103", "# A\n\n# A\n"), ("MDPP104", ":::foo\nx\n:::\n"), ("MDPP105", "x\n\n[a]: http://b.c\n"),
    ("MDPP106", "[x][nope]\n"), ("MDPP107", "---\nmdpp: 9.0\n---\nx\n"), ("MDPP108", "[[toc]]\n\n[[toc]]\n\n# A\n"), ("MDPP109", "[[toc]]\n"), ("MDPP110", "[[embed:https://foo.org/x]]\n"),
    ("MDPP111", "[[embed:nope]]\n"), ("MDPP200", "# A\n\n### B\n"), ("MDPP201", "<https://a.b>\n"), ("MDPP202", "[](http://x.y)\n"), ("MDPP203", "|---|---|\n| a | b |\n"), ("MDPP300", "```Go\nx\n```\n"),
]
SILENT = [
    ("block", "<!-- mdpp-disable MD009 -->\na \n<!-- mdpp-enable MD009 -->\n"), ("next", "<!-- mdpp-disable-next-line MD045 -->\n\n![](x.png)\n"), ("all", "<!-- mdpp-disable -->\n![](x.png)\n"),
    ("file", "---\nmdpp-disable: [MDPP200]\n---\n# A\n\n### B\n"), ("clean", "# A\n\nText.\n"), ("code", "```\nhttps://a.b\n\n\n\n\n```\n"), ("empty", ""),
]


def test_every_rule_and_suppression(spark):
    docs = spark.createDataFrame([*POSITIVE, *SILENT, ("null", None)], "doc_id string, source string")
    p = parsed(docs)
    found = lint.lint(p)
    codes = {}
    for r in found.collect():
        codes.setdefault(r.doc_id, set()).add(r.code)
        assert r.severity == lint.SEVERITY[r.code]
    for code, _ in POSITIVE:
        assert code in codes[code]
    assert not {n for n, _ in SILENT} & set(codes) and "null" not in codes
    fixed = {r.doc_id: r.source for r in lint.fixed(p, found).collect()}
    assert (fixed["MD009"], fixed["MDPP105"], fixed["MDPP300"]) == ("a\n", "x\n\n", "```go\nx\n```\n")
    only = lint.lint(p, least="error").select("code").distinct().collect()
    assert {r.code for r in only} <= {c for c, s in lint.SEVERITY.items() if s == "error"}
    assert lint.reported(found.where("code = 'MDPP106'"), "text").first().report == "MDPP106:1:1: error MDPP106: reference link [nope] has no definition"


def test_positions_in_utf16(spark):
    src = "ab😀c\nzé\n"
    p = spark.createDataFrame([(1, src)], "doc_id long, source string")
    at = spark.createDataFrame([(1, 0, c) for c in range(6)] + [(1, 1, 9)], "doc_id long, line int, character int")
    got = {(r.line, r.character): r.offset for r in navigate.to_offsets(p, at).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 2, (0, 4): 6, (0, 5): 7, (1, 9): 11}
    for (line, character), offset in got.items():
        assert len(src.encode()[:offset].decode()) == edits.to_index(src, line, character)


def test_edit_stream_and_replay_agree(spark, tmp_path):
    rows = [
        ("u", 1, 1, "open", None, None, None, None, "héllo 😀 x\nb"), ("u", 2, 2, "change", 0, 6, 0, 8, "Y"), ("u", 3, 3, "change", 5, 0, 0, 0, "bad"), ("v", 1, 4, "change", 0, 0, 0, 0, "z"),
        ("u", 4, 5, "save", None, None, None, None, "saved"), ("u", 5, 6, "close", None, None, None, None, None),
    ]
    events = spark.createDataFrame(rows, edits.EVENTS)
    want = [tuple(r) for r in edits.replayed(events).orderBy("seq").collect()]
    assert [w[4] for w in want] == ["héllo 😀 x\nb", "héllo Y x\nb", "héllo Y x\nb", None, "saved", None]
    assert [bool(w[5]) for w in want] == [False, False, True, True, False, False]
    events.coalesce(1).write.json(f"{tmp_path}/in")
    q = edits.documents(files.stream_events(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("edit_results").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("edit_results").orderBy("seq").collect()] == want


def test_messages_and_events(spark):
    sent = [{"method": "textDocument/didOpen", "params": {"textDocument": {"uri": "a", "version": 1, "text": "q"}}}, {"method": "textDocument/didChange", "params": {"textDocument": {"uri": "a", "version": 2}, "contentChanges": [{"text": "whole"}]}}]
    data = b"".join(map(files.framed, sent))
    assert list(files.messages(data)) == sent and len(list(files.messages(data[:-3]))) == 1
    events = files.edit_events(spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(sent)], "seq long, message string"))
    assert [r.source for r in edits.replayed(events).orderBy("seq").collect()] == ["q", "whole"]
    assert [(r.version, r.source) for r in edits.latest(events).collect()] == [(2, "whole")]
    many = {"method": "textDocument/didChange", "params": {"textDocument": {"uri": "a", "version": 2}, "contentChanges": [{"text": str(i)} for i in range(1500)]}}
    rows = [(0, json.dumps(sent[0])), (1, json.dumps(many)), (2, json.dumps(sent[1]))]
    assert edits.latest(files.edit_events(spark.createDataFrame(rows, "seq long, message string"))).first().source == "whole"
    assert files.error_response(3, files.METHOD_NOT_FOUND, "no")["error"]["code"] == -32601 and files.response(3, {})["id"] == 3


def test_published_findings_and_closed_documents(spark):
    rows = [("a", 1, 1, "open", "x", None), ("a", 2, 2, "change", "go https://a.b\n", None), ("b", 1, 3, "open", "fine\n", None), ("c", 1, 4, "close", None, None)]
    found = {(r.doc_id, r.code): r.severity_number for r in edits.published(spark.createDataFrame(rows, edits.RESULTS)).collect()}
    assert found == {("a", "MD034"): 3, ("b", None): None, ("c", None): None}


def test_lint_of_a_long_line_and_rules_of_ones_own(spark):
    p = parsed(spark.createDataFrame([(1, "a" * 100_000), (2, "<!-- mdpp-disable OWN -->\n# A\n"), (3, "# B\n")], "doc_id long, source string"))
    own = lambda c: lint.at_node(lint.of_type(c.nodes, "Heading"), "OWN", lint.F.lit("a heading")).drop("off", "related")
    found = lint.lint(p, ["MD034", "MD009"], extra=[own])
    assert [(r.doc_id, r.code, r.severity) for r in found.collect()] == [(3, "OWN", "warning")]
    assert lint.rules(spark).count() == len(lint.RULES) == 23


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.md").write_text("* x\n")
    (tmp_path / "b.md").write_text("- x\n")
    docs = files.read_markdown(spark, str(tmp_path))
    done = convert.formatted(docs)
    assert done.where("changed").count() == 1
    files.write_changed(done, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").first().formatted == "- x\n"
    own = tmp_path / "own"
    own.mkdir()
    for name, text in (("a.md", "* x\n"), ("b.md", "- y\n")):
        (own / name).write_text(text)
        (own / name).chmod(0o640)
    before = (own / "b.md").stat().st_mtime_ns
    found = files.rewritten(convert.formatted(files.read_markdown(spark, str(own)))).collect()
    assert sorted((r.doc_id.rsplit("/", 1)[1], r.changed) for r in found) == [("a.md", True), ("b.md", False)]
    assert (own / "a.md").read_text() == "- x\n" and (own / "a.md").stat().st_mode & 0o777 == 0o640
    assert (own / "b.md").stat().st_mtime_ns == before and sorted(p.name for p in own.iterdir()) == ["a.md", "b.md"]


def test_rename_and_preview(spark):
    docs = spark.createDataFrame([(1, "---\nmdpp: 0.1\n---\n# Old\n\n[x](#old)\n")], "doc_id long, source string")
    p = parsed(docs)
    at = spark.createDataFrame([(1, 20)], "doc_id long, offset int")
    assert [tuple(r) for r in navigate.prepare_rename(p, at).collect()] == [(1, 20, 20, 23)]
    edits_of = navigate.rename(p, at.selectExpr("*", "'New name' AS new_name")).orderBy("start_byte").collect()
    assert [(r.start_byte, r.end_byte, r.new_text) for r in edits_of] == [(20, 23, "New name"), (29, 33, "#new-name")]
    shown = convert.previewed(docs).first()
    assert shown.version == "0.1" and shown.toc[0].id == "old" and 'id="old"' in shown.html


def normal(rows):
    return sorted(repr([None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]) for r in rows)


NAMES = ["headings", "toc_tree", "word_counts", "table_cells", "link_resolution", "footnotes", "container_attributes", "embeds", "diagrams", "slugs", "line_table", "lint_unused_definition", "lint_heading_skip", "html_table", "formatted", "format_diffs", "semantic_tokens", "edits_replayed", "code_actions", "tree_json", "definitions_at", "html_samples", "html_options", "format_samples", "format_samples_stable",
    "lint_samples", "lint_json_reports", "lint_filters", "parse_diagnostics", "hover_cards", "definition_places", "reference_places", "renamed", "rename_prepared", "completions", "folds", "symbol_samples", "token_samples", "token_ranges",
    "action_samples", "actions_in_range", "utf16_positions", "frontmatter_values", "previews", "pages_to_print", "rpc_events", "markdown_files", "edits_streamed", "node_paths", "server_responses", "html_highlighted", "chunked_paragraphs"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = E.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(E.oracle_sql()[name])
    assert sorted(want.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert normal(map(tuple, got.select(columns).collect())) == normal(con.sql(f"SELECT {picked} FROM want").fetchall())


def test_node_intervals_is_one_pass_without_a_join(spark):
    got = E.queries()["node_intervals"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Broadcast" not in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = con.sql(E.oracle_sql()["node_intervals"]).fetchall()
    assert normal(map(tuple, got.select("doc_id", "items", "root_last").collect())) == normal(want)


def test_nested_counts_below_each_outer_node(spark):
    docs = spark.createDataFrame([(1, "- a\n  - b\n  - c\n\n# H\n\n- d\n"), (2, "no list\n"), (3, None)], "doc_id long, source string")
    p = parsed(docs)
    nodes = [r for r in p.selectExpr("doc_id", "inline(nodes)").collect() if r.doc_id == 1]
    outer = {o.node_id: sum(o.node_id < x.node_id <= o.last_desc and x.type == "ListItem" for x in nodes) for o in nodes if o.type == "List"}
    found = extract.nested(p, "ListItem", "List").collect()
    assert sorted((r.outer_id, r.n) for r in found) == sorted(outer.items()) and len(outer) == 3
    assert {(r.doc_id, r.root_last) for r in found} == {(1, nodes[0].last_desc)}


def test_batches_of_documents_are_bounded_by_bytes():
    texts = ["x" * 100, None, "", "é" * 200, "y" * 30, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "source"])
    cut = [b.column(0).to_pylist() for b in bounded(batch, rows=3, most=120)]
    assert cut == [[0, 1, 2], [3], [4, 5]] and [b.num_rows for b in bounded(batch, rows=4)] == [4, 2]
    assert list(bounded(batch.slice(0, 0))) == []


def test_entry(spark):
    assert E.entry(spark).count() > 0
