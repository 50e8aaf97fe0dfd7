"""Sources and sinks: Markdown files in, text, JSON, reports and framed messages out."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id (the file's name) and source: a row a file, whatever store the path names."""
    rows = spark.read.text(list(paths), wholetext=True)
    return rows.select(F.input_file_name().alias("doc_id"), F.col("value").alias("source"))


def stream_markdown(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("source"))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Edit events from JSON lines files."""
    from quillspark.streaming.edits import EVENTS

    return spark.readStream.schema(EVENTS).json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text a row; the rows stay on the executors that made them."""
    df.select(column).write.mode("overwrite").text(path)


def write_changed(formatted: DataFrame, path: str) -> None:
    """Changed documents only, beside the input, never over it."""
    formatted.where("changed").select("doc_id", "formatted").write.mode("overwrite").parquet(path)


def rewritten(done: DataFrame) -> DataFrame:
    """Write each changed document of (doc_id: its file, formatted, changed) over its file and return doc_id, changed.

    A file is replaced in one step by its new version, with the mode it had where the store has modes; what is already
    canonical isn't touched. A repeated task writes the same bytes again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, changed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not changed:
                    continue
                where, path = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:/", "file:///", 1))
                part = f"{path}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(text.encode())
                if isinstance(where, fs.LocalFileSystem):
                    os.chmod(part, os.stat(path).st_mode & 0o7777)
                where.move(part, path)
            yield batch.select([0, 2])

    return done.select("doc_id", "formatted", "changed").mapInArrow(run, "doc_id string, changed boolean")


def framed(payload: dict) -> bytes:
    body = json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


# Error codes.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603


def response(request_id: int | str | None, result: object) -> dict:
    return {"jsonrpc": "2.0", "id": request_id, "result": result}


def error_response(request_id: int | str | None, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": request_id, "error": {"code": code, "message": message}}


def notification(method: str, params: object) -> dict:
    return {"jsonrpc": "2.0", "method": method, "params": params}


def messages(data: bytes) -> Iterator[dict]:
    """Framed messages of a byte stream; header names in any case. A body that isn't there in full ends the walk."""
    at = 0
    while (stop := data.find(b"\r\n\r\n", at)) >= 0:
        head = {k.strip().lower(): v.strip() for k, _, v in (h.partition(b":") for h in data[at:stop].split(b"\r\n"))}
        size = int(head[b"content-length"])
        if len(data) < stop + 4 + size:
            return
        yield json.loads(data[stop + 4 : stop + 4 + size])
        at = stop + 4 + size


def edit_events(batch: DataFrame, column: str = "message") -> DataFrame:
    """Edit events from a column of JSON-RPC notifications(seq, message). seq of an event is the message's in the upper
    half and the change's in the lower one, so changes stay in order however many a message has."""
    schema = "method string, params struct<textDocument: struct<uri: string, version: int, text: string>, text: string, contentChanges: array<struct<range: struct<start: struct<line: int, character: int>, `end`: struct<line: int, character: int>>, text: string>>>"
    m = batch.select("seq", F.from_json(column, schema).alias("m"))
    kind = F.regexp_extract("m.method", r"^textDocument/did(Open|Change|Save|Close)$", 1)
    doc = F.col("m.params.textDocument")
    rows = m.where(kind != "").select("seq", F.lower(kind).alias("kind"), doc["uri"].alias("uri"), doc["version"].alias("version"), F.coalesce(doc["text"], F.col("m.params.text")).alias("whole"), F.posexplode_outer("m.params.contentChanges").alias("k", "c"))
    r = lambda p, f: F.col(f"c.range.{p}.{f}")
    return rows.select("uri", "version", (F.shiftleft(F.col("seq").cast("long"), 32) + F.coalesce("k", F.lit(0))).alias("seq"), "kind", r("start", "line").alias("start_line"), r("start", "character").alias("start_char"), r("end", "line").alias("end_line"), r("end", "character").alias("end_char"), F.coalesce("c.text", "whole").alias("text"))
