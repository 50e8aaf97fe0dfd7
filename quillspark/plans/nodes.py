"""The engine's tables: documents in, `parsed` once, then nodes, lines and diagnostics as DataFrames.

One Arrow-batched pass parses each document into an array of flat nodes; explode turns it into rows with
no shuffle. node_id is the pre-order number and last_desc the highest id in the subtree, so that a
descendant test is an equi key and an interval.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import frontmatter
from quillspark.functions.blocks import read
from quillspark.functions.inline import Node
from quillspark.functions.render import utf8
from quillspark.functions.suppress import suppressions
from quillspark.plans.store import spread

RANGE = "struct<start_byte:int,end_byte:int,start_line:int,start_col:int,end_line:int,end_col:int>"
NODE = f"struct<node_id:int,parent_id:int,ordinal:int,depth:int,last_desc:int,type:string,literal:string,attrs:map<string,string>,text:string,range:{RANGE}>"
DIAGNOSTIC = f"struct<code:string,severity:string,message:string,range:{RANGE}>"
LINK = "struct<label:string,href:string,title:string,start_byte:int,end_byte:int>"
USE = "struct<label:string,start_byte:int,end_byte:int>"
PAIR = "struct<label:string,shown:string,start_byte:int,end_byte:int>"
OFF = "struct<code:string,after:int,until:int>"

_INT = pa.int32()
_RANGE = pa.struct([(n, _INT) for n in ("start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col")])
_NODE = pa.struct([*((n, _INT) for n in ("node_id", "parent_id", "ordinal", "depth", "last_desc")), ("type", pa.string()), ("literal", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("range", _RANGE)])
_DIAGNOSTIC = pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("range", _RANGE)])

_LINK = pa.struct([*((n, pa.string()) for n in ("label", "href", "title")), ("start_byte", _INT), ("end_byte", _INT)])
_USE = pa.struct([("label", pa.string()), ("start_byte", _INT), ("end_byte", _INT)])
_PAIR = pa.struct([("label", pa.string()), ("shown", pa.string()), ("start_byte", _INT), ("end_byte", _INT)])
_OFF = pa.struct([("code", pa.string()), ("after", _INT), ("until", _INT)])

#: Types whose own text is asked for often: kept beside the node.
TEXTUAL = {"Heading", "Link", "Paragraph", "TableCell", "DefinitionTerm", "DefinitionDesc", "ListItem", "TaskListItem", "FootnoteDef"}


class Places:
    """Byte to 1-based line and byte column."""

    def __init__(self, source: str) -> None:
        self.starts, at = [0], source.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = source.find("\n", at + 1)

    def range(self, start: int, end: int) -> dict[str, int] | None:
        if start < 0:
            return None
        sl, el = bisect_right(self.starts, start), bisect_right(self.starts, end)
        return {"start_byte": start, "end_byte": end, "start_line": sl, "start_col": start - self.starts[sl - 1] + 1, "end_line": el, "end_col": end - self.starts[el - 1] + 1}


def flat(root: Node, places: Places) -> list[dict]:
    """The tree in pre-order."""
    out: list[dict] = []
    stack = [(root, -1, 0, 0)]
    while stack:
        n, parent, ordinal, depth = stack.pop()
        k = len(out)
        out.append(
            {
                "node_id": k, "parent_id": None if parent < 0 else parent, "ordinal": ordinal, "depth": depth, "last_desc": k, "type": n.type, "literal": utf8(n.literal),
                "attrs": [(a, utf8(v)) for a, v in n.attrs.items()], "text": utf8(n.text()) if n.type in TEXTUAL else None, "range": places.range(n.start, n.end),
            }
        )
        stack += [(c, k, i, depth + 1) for i, c in reversed(list(enumerate(n.children)))]
    for row in reversed(out):
        if row["parent_id"] is not None:
            p = out[row["parent_id"]]
            p["last_desc"] = max(p["last_desc"], row["last_desc"])
    return out


def bounded(batch: pa.RecordBatch, rows: int = 256, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` documents and, but for a longer one, `most` bytes of source: nodes take some
    hundred times the memory of their source."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and (k - first == rows or held + n > most):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def parsed(docs: DataFrame, emoji: dict[str, str] | None = None, chunked: bool = False) -> DataFrame:
    """doc_id, source (as lowered), starts (of its lines, in bytes), nodes, diagnostics, off (what comments and
    frontmatter suppress: code or *, after which line, until which or null), frontmatter (JSON, null without one),
    version, links (the definition of each label), uses (of those labels in brackets) and pairs (resolved [text][label]
    links) of docs(doc_id, source).

    Null source is the empty document. A document that the parser fails on is one Text node and a
    diagnostic; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                out: tuple[list, ...] = tuple([] for _ in range(10))
                for text in batch.column(1).to_pylist():
                    root, low, diagnostics, front, links, uses, pairs = read(text or "", emoji, chunked)
                    places = Places(low)
                    own = (
                        utf8(low), places.starts, flat(root, places), [{"code": c, "severity": s, "message": m, "range": places.range(a, b)} for c, s, m, a, b in diagnostics],
                        [{"code": c, "after": a, "until": b} for c, a, b in suppressions(low, front)], None if front is None else frontmatter.as_json(front), frontmatter.version_of(front),
                        [{"label": utf8(a), "href": utf8(b), "title": utf8(c), "start_byte": s, "end_byte": e} for a, b, c, s, e in links],
                        [{"label": utf8(a), "start_byte": s, "end_byte": e} for a, s, e in uses], [{"label": utf8(a), "shown": utf8(b), "start_byte": s, "end_byte": e} for a, b, s, e in pairs],
                    )
                    for column, value in zip(out, own, strict=True):
                        column.append(value)
                kinds = (pa.string(), pa.list_(_INT), pa.list_(_NODE), pa.list_(_DIAGNOSTIC), pa.list_(_OFF), pa.string(), pa.string(), pa.list_(_LINK), pa.list_(_USE), pa.list_(_PAIR))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "source", "starts", "nodes", "diagnostics", "off", "frontmatter", "version", "links", "uses", "pairs"])

    own = spread(docs.select("doc_id", F.col("source").cast("string").alias("source")))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, source string, starts array<int>, nodes array<{NODE}>, diagnostics array<{DIAGNOSTIC}>, off array<{OFF}>, frontmatter string, version string, links array<{LINK}>, uses array<{USE}>, pairs array<{PAIR}>")


def nodes(parsed_docs: DataFrame) -> DataFrame:
    """doc_id, off and the fields of each node."""
    return parsed_docs.select("doc_id", "off", F.inline("nodes"))


def diagnostics(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.select("doc_id", F.inline("diagnostics"))


def normalised(source: Column) -> Column:
    """Line ends as LF and one at the end of a text that isn't empty."""
    lf = F.regexp_replace(source, "\r\n?", "\n")
    return F.when((lf == "") | lf.endswith("\n"), lf).otherwise(F.concat(lf, F.lit("\n")))


def with_starts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source) with starts, the byte at which each line begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for text in batch.column(1).to_pylist():
                own = [0]
                for line in (text or "").encode().split(b"\n")[:-1]:
                    own.append(own[-1] + len(line) + 1)
                starts.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(_INT))], names=["doc_id", "source", "starts"])

    own = docs.select("doc_id", "source")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, source string, starts array<int>")


def lines(parsed_docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start_byte, end_byte (before the line feed), text, and off of parsed documents; the empty string
    after the last LF is a line. The parser has found where lines begin, so this is one explode."""
    whole = parsed_docs if "starts" in parsed_docs.columns else with_starts(parsed_docs)
    off = ["off"] if "off" in whole.columns else []
    rows = whole.select("doc_id", *off, F.posexplode(F.arrays_zip(F.split("source", "\n", -1).alias("text"), F.col("starts").alias("start"))).alias("k", "x"))
    text = F.col("x.text")
    return rows.select("doc_id", (F.col("k") + 1).alias("line_no"), F.col("x.start").alias("start_byte"), (F.col("x.start") + F.octet_length(text)).alias("end_byte"), text.alias("text"), *off)
