"""Requests of editors, answered in one run: a table of JSON-RPC requests and a table of open documents give a table of
responses. Each method is one query over all documents that its requests name."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.tokens import MODIFIERS, TYPES
from quillspark.operators import convert, navigate
from quillspark.plans import nodes as plans
from quillspark.plans.store import kept
from quillspark.sources.files import INVALID_PARAMS, METHOD_NOT_FOUND

# What the server can do.
CAPABILITIES = {
    "textDocumentSync": {"openClose": True, "change": 2, "save": {"includeText": True}},
    "hoverProvider": True,
    "definitionProvider": True,
    "referencesProvider": True,
    "renameProvider": True,
    "codeActionProvider": {"codeActionKinds": ["quickfix", "source.fixAll", "source.fixAll.mdpp"]},
    "foldingRangeProvider": True,
    "documentSymbolProvider": True,
    "documentFormattingProvider": True,
    "completionProvider": {"triggerCharacters": ["[", "]", "^", ":", "!", "#"]},
    "semanticTokensProvider": {"legend": {"tokenTypes": list(TYPES), "tokenModifiers": list(MODIFIERS)}, "range": True, "full": True},
}
REQUEST = "id string, method string, params struct<textDocument: struct<uri: string>, position: struct<line: int, character: int>>"
#: Methods that need a position, and those that need a document alone.
AT_POSITION = ("textDocument/hover", "textDocument/definition", "textDocument/references", "textDocument/completion")
OF_DOCUMENT = ("textDocument/foldingRange", "textDocument/documentSymbol", "textDocument/formatting", "textDocument/semanticTokens/full")
WITHOUT = ("initialize", "shutdown")


def requests(batch: DataFrame, column: str = "message") -> DataFrame:
    """seq, id, method, doc_id, line, character of batch(seq, message)."""
    m = batch.select("seq", F.from_json(column, REQUEST).alias("m"))
    return m.select("seq", "m.id", "m.method", F.col("m.params.textDocument.uri").alias("doc_id"), F.col("m.params.position.line").alias("line"), F.col("m.params.position.character").alias("character"))


def _listed(rows: DataFrame, keys: list[str], item: Column, *order: str) -> DataFrame:
    """keys and result: the rows' items in order, as JSON."""
    pairs = F.array_sort(F.collect_list(F.struct(*(F.col(o) for o in order), item.alias("item"))))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(pairs, lambda x: x["item"])).alias("result"))


def _located(parsed: DataFrame, places: DataFrame) -> DataFrame:
    """places with range: start and end as line and character."""
    ends = places.select("doc_id", F.explode(F.array("start_byte", "end_byte")).alias("offset")).distinct()
    at = navigate.to_positions(parsed, ends).select("doc_id", "offset", F.struct("line", "character").alias("at"))
    first, last = (at.select("doc_id", F.col("offset").alias(c), F.col("at").alias(n)) for c, n in (("start_byte", "start"), ("end_byte", "end")))
    return places.join(first, ["doc_id", "start_byte"]).join(last, ["doc_id", "end_byte"]).withColumn("range", F.struct("start", "end"))


def _at(method: str, p: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, offset, result of one method."""
    keys, location = ["doc_id", "offset"], F.struct(F.col("doc_id").alias("uri"), "range")
    if method == "textDocument/hover":
        contents = F.struct(F.lit("markdown").alias("kind"), F.col("card").alias("value"))
        return navigate.hover(p, offsets).select(*keys, F.to_json(F.struct(contents.alias("contents"))).alias("result"))
    if method == "textDocument/definition":
        return _listed(_located(p, navigate.definition(p, offsets)), keys, location, "start_byte")
    if method == "textDocument/references":
        return _listed(_located(p, navigate.references(p, offsets)), keys, location, "start_byte", "end_byte")
    offered = _listed(navigate.completions(p, offsets), keys, F.struct("label", "detail", F.col("insert").alias("insertText")), "label")
    return offered.select(*keys, F.concat(F.lit('{"isIncomplete":false,"items":'), "result", F.lit("}")).alias("result"))


def _of(method: str, p: DataFrame) -> DataFrame:
    """doc_id, result of one method."""
    if method == "textDocument/foldingRange":
        item = F.struct((F.col("start_line") - 1).alias("startLine"), (F.col("end_line") - 1).alias("endLine"), "kind")
        return _listed(navigate.folding_ranges(p), ["doc_id"], item, "start_line", "end_line")
    if method == "textDocument/documentSymbol":
        return _listed(navigate.document_symbols(p), ["doc_id"], F.struct("name", F.col("kind").alias("detail")), "ord", "kind", "name")
    if method == "textDocument/formatting":
        last = F.element_at(F.split("source", "\n", -1), -1)
        end = F.struct((F.size(F.split("source", "\n", -1)) - 1).alias("line"), navigate.utf16_length(last).alias("character"))
        zero = F.struct(F.lit(0).alias("line"), F.lit(0).alias("character"))
        edit = F.struct(F.struct(zero.alias("start"), end.alias("end")).alias("range"), F.col("formatted").alias("newText"))
        return convert.formatted(p).where("changed").select("doc_id", F.to_json(F.array(edit)).alias("result"))
    number = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")) - 1
    five = F.array("delta_line", "delta_start", "length", number.cast("int"), "modifiers")
    rows = navigate.semantic_tokens(p).withColumn("five", five).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "start", "five"))).alias("t"))
    return rows.select("doc_id", F.to_json(F.struct(F.flatten(F.transform("t", lambda x: x["five"])).alias("data"))).alias("result"))


def answered(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """seq, response (JSON) of requests(seq, id, method, doc_id, line, character) to docs(doc_id, source), one for each. An unknown
    method and a document that isn't open are errors; a position without an answer has a null result."""
    asked = kept(asked, "requests")
    p = kept(plans.parsed(docs), "parsed")
    # the known methods that are asked for at all: as many rows as there are methods
    called = {r["method"] for r in asked.where(F.col("method").isin(*AT_POSITION, *OF_DOCUMENT, *WITHOUT)).select("method").distinct().collect()}
    parts = [asked.where("method = 'initialize'").select("seq", F.lit(json.dumps({"capabilities": CAPABILITIES}, separators=(",", ":"))).alias("result"))]
    for m in (m for m in AT_POSITION if m in called):
        place = navigate.to_offsets(p, asked.where((F.col("method") == m) & F.col("line").isNotNull())).select("seq", "doc_id", "offset")
        parts.append(place.join(_at(m, p, place.select("doc_id", "offset").distinct()), ["doc_id", "offset"]).select("seq", "result"))
    for m in (m for m in OF_DOCUMENT if m in called):
        own = asked.where(F.col("method") == m).select("seq", "doc_id")
        parts.append(own.join(_of(m, p.join(own.select("doc_id").distinct(), "doc_id", "left_semi")), "doc_id").select("seq", "result"))
    results = parts[0]
    for part in parts[1:]:
        results = results.union(part)
    is_open = docs.select("doc_id", F.lit(True).alias("open")).distinct()
    joined = asked.join(results, "seq", "left").join(is_open, "doc_id", "left")
    fault = lambda code, text: F.concat(F.lit(f',"error":{{"code":{code},"message":'), F.lit(json.dumps(text)), F.lit("}}"))
    known = F.col("method").isin(*AT_POSITION, *OF_DOCUMENT, *WITHOUT)
    closed = F.col("method").isin(*AT_POSITION, *OF_DOCUMENT) & F.col("open").isNull()
    body = F.when(~F.coalesce(known, F.lit(False)), fault(METHOD_NOT_FOUND, "method not found")).when(closed, fault(INVALID_PARAMS, "document is not open")).otherwise(F.concat(F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}")))
    number_or_text = F.when(F.col("id").rlike(r"^-?\d+$"), F.col("id")).otherwise(F.coalesce(F.concat(F.lit('"'), "id", F.lit('"')), F.lit("null")))
    return joined.select("seq", F.concat(F.lit('{"jsonrpc":"2.0","id":'), number_or_text, body).alias("response"))
