"""The stream of edit events: keyed state per document, findings of each new version.

An event opens, changes, saves or closes a document. Changes carry an optional range in UTF-16 positions;
without one they replace the whole text. Each document's text and version is its state; an event
that doesn't apply leaves the state as it was and comes out as an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "uri string, version int, seq long, kind string, start_line int, start_char int, end_line int, end_char int, text string"
RESULTS = "uri string, version int, seq long, kind string, source string, error string"
STATE = "version int, source string"
_ARROW = pa.schema([("uri", pa.string()), ("version", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("source", pa.string()), ("error", pa.string())])


def to_index(source: str, line: int, character: int) -> int:
    """Index of a position in UTF-16 units; inside a pair the character's start, past a line its end, past the text its end."""
    at = 0
    for _ in range(line):
        nxt = source.find("\n", at)
        if nxt < 0:
            return len(source)
        at = nxt + 1
    units = 0
    while at < len(source) and source[at] != "\n":
        units += 2 if ord(source[at]) > 0xFFFF else 1
        if units > character:
            break
        at += 1
    return at


def edited(source: str, start: tuple[int, int] | None, end: tuple[int, int] | None, text: str) -> str:
    """The source after one edit; a range whose end is before its start is refused."""
    if start is None or end is None:
        return text
    a, b = to_index(source, *start), to_index(source, *end)
    if b < a:
        raise ValueError("the range ends before it starts")
    return source[:a] + text + source[b:]


def advance(state: tuple[int, str] | None, event: dict) -> tuple[tuple[int, str] | None, str | None]:
    """The state after an event, and an error."""
    kind, text = event["kind"], event["text"]
    if kind == "open":
        return (event["version"], text or ""), None
    if state is None:
        return None, f"{kind} of a document that isn't open"
    if kind == "close":
        return None, None
    if kind == "save":
        return (state[0], state[1] if text is None else text), None
    if kind != "change":
        return state, f"unknown event {kind}"
    place = lambda p: None if event[f"{p}_line"] is None else (int(event[f"{p}_line"]), int(event[f"{p}_char"] or 0))
    try:
        return (event["version"], edited(state[1], place("start"), place("end"), text or "")), None
    except ValueError as e:
        return state, str(e)


def _rows(frames: Iterable[pd.DataFrame]) -> list[dict]:
    rows = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
    return sorted(rows, key=lambda r: r["seq"])


def _walk(uri: str, rows: list[dict], held: tuple[int, str] | None) -> tuple[tuple[int, str] | None, list[dict]]:
    """State after all rows, and a result for each."""
    out = []
    for r in rows:
        held, error = advance(held, r)
        out.append({"uri": uri, "version": held[0] if held else r["version"], "seq": r["seq"], "kind": r["kind"], "source": held[1] if held else None, "error": error})
    return held, out


def documents(events: DataFrame) -> DataFrame:
    """uri, version, seq, kind, source, error after each event of a stream; events of a micro-batch apply in order of seq."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = _walk(key[0], _rows(frames), tuple(state.get) if state.exists else None)
        if held is None:
            state.remove()
        else:
            state.update((int(held[0] or 0), held[1]))
        yield pd.DataFrame(out, columns=_ARROW.names)

    return events.groupBy("uri").applyInPandasWithState(update, RESULTS, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame) -> DataFrame:
    """The same over a finished table of events: the last row of each document is its state."""

    def run(events_of_one: pa.Table) -> pa.Table:
        rows = sorted(events_of_one.to_pylist(), key=lambda r: r["seq"])
        return pa.Table.from_pylist(_walk(rows[0]["uri"], rows, None)[1], schema=_ARROW)

    return events.groupBy("uri").applyInArrow(run, RESULTS)


def latest(events: DataFrame) -> DataFrame:
    """uri, version, seq, kind, source, error: each document after its last event alone, so that the output is as large as the
    documents and not as all their versions."""

    def run(events_of_one: pa.Table) -> pa.Table:
        rows = sorted(events_of_one.to_pylist(), key=lambda r: r["seq"])
        held: tuple[int, str] | None = None
        error = None
        for r in rows:
            held, error = advance(held, r)
        last = rows[-1]
        row = {"uri": last["uri"], "version": held[0] if held else last["version"], "seq": last["seq"], "kind": last["kind"], "source": held[1] if held else None, "error": error}
        return pa.Table.from_pylist([row], schema=_ARROW)

    return events.groupBy("uri").applyInArrow(run, RESULTS)


# Severities as they are sent.
SEVERITY_NUMBER = {"error": 1, "warning": 2, "info": 3, "hint": 4}


def published(batch: DataFrame, least: str = "hint") -> DataFrame:
    """Findings of each document's last state in a micro-batch, for foreachBatch, with severity_number 1 to 4. A document
    without findings, or a closed one, has one row without a code, so that what was shown before is cleared."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillspark.operators.lint import lint, with_parse_diagnostics
    from quillspark.plans.nodes import parsed
    from quillspark.plans.store import kept

    last = F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("seq")))
    now = kept(batch.withColumn("rn", last).where("rn = 1").select(F.col("uri").alias("doc_id"), "source", "version"), "states")
    p = kept(parsed(now.where("source is not null")), "parsed")
    number = F.create_map(*(F.lit(x) for pair in SEVERITY_NUMBER.items() for x in pair))
    found = with_parse_diagnostics(p, lint(p, least=least, keep=False), least=least).withColumn("severity_number", number[F.col("severity")])
    return now.select("doc_id", "version").join(found, "doc_id", "left")
