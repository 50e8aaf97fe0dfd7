"""Whole-document conversions: HTML, canonical source, nested JSON. One Arrow-batched pass each, no shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fmt, frontmatter
from quillspark.functions.blocks import parse, read
from quillspark.functions.render import Options, render
from quillspark.plans.store import spread


#: Stands for the file's name until the row's own is put there.
MARK = "\x7ffile\x7f"


def mapped(docs: DataFrame, kinds: dict[str, pa.DataType], sql: str, f: Callable[[str], tuple]) -> DataFrame:
    """doc_id and the columns that f makes of each source, in slices of a batch; a null source is the empty document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = [f(s or "") for s in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True))], names=["doc_id", *kinds])

    own = spread(docs.select("doc_id", F.col("source").cast("string").alias("source")))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {sql}")


def html(docs: DataFrame, options: Options = Options()) -> DataFrame:
    def one(source: str) -> tuple[str]:
        root, low, _ = parse(source)
        return (render(root, low, options),)

    return mapped(docs, {"html": pa.string()}, "html string", one)


def formatted(docs: DataFrame) -> DataFrame:
    """doc_id, source, formatted, changed, from one pass over the rows."""

    def one(source: str) -> tuple[str, str, bool]:
        out = fmt.format_source(source)
        return source, out, out != source

    return mapped(docs, {"source": pa.string(), "formatted": pa.string(), "changed": pa.bool_()}, "source string, formatted string, changed boolean", one)


def tree_json(docs: DataFrame, pretty: bool = False) -> DataFrame:
    """doc_id, json: file (the doc_id), frontmatter, diagnostics, headings, table of contents and the tree; on several lines
    where pretty."""

    def one(source: str) -> tuple[str]:
        return (fmt.as_json(read(source), MARK, pretty),)

    found = mapped(docs, {"json": pa.string()}, "json string", one)
    name = F.to_json(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("f")))
    value = F.expr("substring(name, 6, length(name) - 6)")
    return found.withColumn("name", name).select("doc_id", F.replace("json", F.lit(f'"{MARK}"'), value).alias("json"))


def diffs(docs: DataFrame) -> DataFrame:
    """doc_id, diff: old lines with -, new lines with +; in Catalyst expressions over both texts."""
    marked = lambda c, sign: F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.concat(F.lit(sign), x)), "\n")
    name = F.col("doc_id").cast("string")
    return formatted(docs).where("changed").select("doc_id", F.concat_ws("\n", F.concat(F.lit("--- "), name), F.concat(F.lit("+++ "), name, F.lit(" (formatted)")), F.lit("@@"), marked("source", "-"), marked("formatted", "+")).alias("diff"))


# The sheet under the user's own, and paper sizes in inches.
SHEET = (
    'body{font-family:system-ui,-apple-system,BlinkMacSystemFont,"Segoe UI",sans-serif;line-height:1.5;color:#111;margin:0;}'
    "pre,code{font-family:ui-monospace,SFMono-Regular,Menlo,Consolas,monospace;}"
    "pre{white-space:pre-wrap;background:#f6f8fa;padding:12px;border-radius:6px;}"
    "table{border-collapse:collapse;width:100%;}th,td{border:1px solid #d0d7de;padding:4px 8px;}"
    "blockquote{border-left:4px solid #d0d7de;margin-left:0;padding-left:12px;color:#57606a;}"
    ".admonition,.mdpp-container{border:1px solid #d0d7de;border-left-width:4px;padding:8px 12px;margin:1em 0;border-radius:6px;}"
    ".admonition-title,.mdpp-container-title{font-weight:700;margin-top:0;}"
    ".mdpp-toc{border:1px solid #d0d7de;padding:8px 12px;margin:1em 0;border-radius:6px;}"
    ".mdpp-embed{border:1px solid #d0d7de;padding:12px;margin:1em 0;border-radius:6px;}@page{margin:0.5in;}"
)
PAPER = {"letter": (8.5, 11.0), "a4": (8.27, 11.69), "legal": (8.5, 14.0)}


@dataclass(frozen=True)
class Page:
    """What a browser is told to print: paper is letter, a4, legal or custom (width and height in inches, letter where
    they aren't positive); margins (top, right, bottom, left) are half an inch each where all are 0."""

    paper: str = "letter"
    width: float = 0.0
    height: float = 0.0
    margins: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    header: str = ""
    footer: str = ""
    background: bool = False

    def settings(self) -> dict[str, object]:
        own = self.paper == "custom" and self.width > 0 and self.height > 0
        width, height = (self.width, self.height) if own else PAPER.get(self.paper, PAPER["letter"])
        margins = self.margins if any(self.margins) else (0.5,) * 4
        sides = dict(zip(("marginTop", "marginRight", "marginBottom", "marginLeft"), margins, strict=True))
        return {"paperWidth": width, "paperHeight": height, **sides, "printBackground": self.background, "displayHeaderFooter": bool(self.header or self.footer), "headerTemplate": self.header, "footerTemplate": self.footer}


def printable(docs: DataFrame, css: str = "", options: Options = Options(heading_ids=True), page: Page = Page()) -> DataFrame:
    """doc_id, page (the HTML that a browser prints to PDF) and settings (JSON of how); the browser itself is outside
    this engine."""
    shell = ('<!doctype html><html><head><meta charset="utf-8"><style>', "</style></head><body>", "</body></html>")
    settings = json.dumps(page.settings(), separators=(",", ":"))
    return html(docs, options).select("doc_id", F.concat(F.lit(shell[0] + SHEET + css + shell[1]), F.col("html"), F.lit(shell[2])).alias("page"), F.lit(settings).alias("settings"))


def previewed(docs: DataFrame) -> DataFrame:
    """doc_id, html with heading ids and source positions, frontmatter (JSON), toc (array of level, id, text), version (of
    the frontmatter, or empty), all from one parse."""
    options = Options(heading_ids=True, source_positions=True)

    def one(source: str) -> tuple:
        p = read(source)
        return render(p.root, p.source, options), None if p.front is None else frontmatter.as_json(p.front), fmt.contents(p.root), frontmatter.version_of(p.front)

    toc = pa.list_(pa.struct([("level", pa.int32()), ("id", pa.string()), ("text", pa.string())]))
    return mapped(docs, {"html": pa.string(), "frontmatter": pa.string(), "toc": toc, "version": pa.string()}, "html string, frontmatter string, toc array<struct<level:int,id:string,text:string>>, version string", one)
