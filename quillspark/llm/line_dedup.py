"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window starts at each line that isn't blank and runs until it holds MIN_WORDS words or MIN_LINES
lines; what is shorter than that is no passage. Where it ends depends on its own lines alone, so a
passage that stands twice has the same windows in both places, and the line with the least hash of each is the same:
the window's fingerprint. A document keeps the positions that are least in some window, far fewer than it has
windows, and these alone are shuffled. Positions whose line is selected once in the corpus can't be of a repeated
passage. The others are joined, and each match is extended: back and on over the windows that it is the fingerprint
of, from its first one to its last one, compared by the hashes of all their lines; then line by line beyond the
last whole window. What stands at an earlier place in (doc_id, line) order is a later repeat and is deleted.

Everything inside a document is computed on its own array of lines, so no line is shuffled but for those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import keyed_join, table, texts_of, written

MIN_WORDS, MIN_LINES = 50, 6


def with_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, ls: the lines that aren't blank as (pos: line number, words, x and y: two 64-bit hashes)."""
    lines = F.split(F.regexp_replace("text", r"[ \t\r\x0B\f]+", " "), "\n", -1)
    placed = F.transform(lines, lambda t, i: F.struct(i.alias("pos"), F.trim(t).alias("line")))
    words = lambda t: (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("int")
    hashed = F.transform(F.filter(placed, lambda e: e["line"] != ""), lambda e: F.struct(e["pos"].alias("pos"), words(e["line"]).alias("words"), F.xxhash64(e["line"]).alias("x"), F.xxhash64(F.lit("second"), e["line"]).alias("y")))
    return texts_of(docs).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text", hashed.alias("ls"))


def size_from(i: Column, min_words: int, min_lines: int) -> Column:
    """Lines of the window that starts at entry i of ls; null where too few are left."""
    line = lambda k: F.get("ls", i + k)
    held = line(0)["words"]
    size = F.when(held >= min_words, 1) if min_lines > 1 else F.lit(1)
    for k in range(1, min_lines):
        held = held + F.coalesce(line(k)["words"], F.lit(0))
        size = size.when(line(k).isNotNull() & (held >= min_words if k < min_lines - 1 else F.lit(True)), k + 1)
    return size


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def selected(min_words: int, min_lines: int) -> Column:
    """The positions that are fingerprints, as (print: the line's hashes, lo, hi: first and last window that it is least
    in). The least position never goes back from one window to the next, so these are next to one another."""
    sized = F.filter(F.transform("ls", lambda _, i: F.struct(i.alias("start"), size_from(i, min_words, min_lines).alias("size"))), lambda w: w["size"].isNotNull())
    least = lambda w: F.array_min(F.transform(F.slice("ls", w["start"] + 1, w["size"]), lambda e, k: F.struct(e["x"].alias("x"), e["y"].alias("y"), (w["start"] + k).alias("at"))))
    windows = F.transform(sized, lambda w: F.struct(w["start"].alias("start"), least(w).alias("m")))
    heads = lambda ws: F.filter(ws, lambda w, i: (i == 0) | (F.get(ws, i - 1)["m"]["at"] != w["m"]["at"]))
    ranged = lambda ws: bound(heads(ws), lambda hs: F.transform(hs, lambda h, i: F.struct(F.struct(h["m"]["x"].alias("x"), h["m"]["y"].alias("y")).alias("print"), h["start"].alias("lo"), F.coalesce(F.get(hs, i + 1)["start"], F.size(ws)).alias("hi"))))
    return bound(windows, ranged)


def key_of(lines: Column) -> Column:
    """Hash of a run of lines."""
    return F.struct(F.xxhash64(F.transform(lines, lambda e: e["x"])).alias("x"), F.xxhash64(F.lit("second"), F.transform(lines, lambda e: e["y"])).alias("y"))


def matched_windows(keyed: DataFrame, min_words: int, min_lines: int) -> DataFrame:
    """row, doc_id, start (entry of ls), size, key, ahead (up to min_lines lines from there): the windows of all
    fingerprints that stand in more than one place."""
    prints = written(keyed.select("row", F.inline(selected(min_words, min_lines))), "line-prints")
    often = written(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "line-often")
    met = keyed_join(prints, often, "print", "n", prints.count())
    met = met.groupBy("row").agg(F.collect_list(F.sequence("lo", F.col("hi") - 1)).alias("starts"))
    each = keyed.select("row", "doc_id", "ls").join(met, "row").withColumn("start", F.explode(F.flatten("starts")))
    sized = each.select("row", "doc_id", "start", size_from(F.col("start"), min_words, min_lines).alias("size"), F.slice("ls", F.col("start") + 1, min_lines).alias("ahead"))
    return sized.select("*", key_of(F.slice("ahead", F.lit(1), F.col("size"))).alias("key"))


def later_spans(spans: DataFrame, total: int) -> DataFrame:
    """Of spans (row, doc_id, start, key, ...) those whose key stands at an earlier place too, and n, how often it stands."""
    at = F.struct("doc_id", "row", "start")
    first = spans.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed_join(spans, first, "key", "n", total).where(at != F.col("first")).drop("first")


def extensions(spans: DataFrame, later: DataFrame, total: int) -> DataFrame:
    """row, pos, last of what matches go on for beyond their last whole windows, with any earlier place.

    Less than a window is left after the start of the last whole one, so runs of up to min_lines lines from there say
    it all; they are keyed like windows. A window whose next line starts a later repeat is left to that one.
    """
    follow = later.select("row", (F.col("start") - 1).alias("start"))
    ends = later.join(follow, ["row", "start"], "left_anti").groupBy("key").agg(F.max("n").alias("n"))
    near = keyed_join(spans, ends, "key", "n", total).where(F.size("ahead") > F.col("size"))
    longer = near.withColumn("m", F.explode(F.sequence(F.col("size") + 1, F.size("ahead")))).withColumn("ahead", F.slice("ahead", F.lit(1), F.col("m")))
    keyed = longer.select("row", "doc_id", "start", F.get("ahead", F.lit(0))["pos"].alias("pos"), F.element_at("ahead", -1)["pos"].alias("last"), key_of(F.col("ahead")).alias("key"))
    # a span goes out once a length, at most min_lines - 1 times
    return later_spans(keyed, total).select("row", "pos", "last")


def repeats(keyed: DataFrame, min_words: int, min_lines: int) -> DataFrame:
    """row, runs: array of (first, last) line numbers to delete, maximal and in order."""
    spans = written(matched_windows(keyed, min_words, min_lines), "line-windows")
    total = spans.count()
    later = written(later_spans(spans, total), "line-repeats")
    found = later.select("row", F.get("ahead", F.lit(0))["pos"].alias("pos"), F.get("ahead", F.col("size") - 1)["pos"].alias("last"))
    found = found.union(extensions(spans, later, total))
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", "last")))))
    firsts = lambda g: F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1) < x - 1))
    lasts = lambda g: F.filter(g, lambda x, i: (i == F.size(g) - 1) | (F.get(g, i + 1) > x + 1))
    gone = found.groupBy("row").agg(lines.alias("gone"))
    return gone.select("row", F.arrays_zip(firsts(F.col("gone")).alias("first"), lasts(F.col("gone")).alias("last")).alias("runs"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed (runs first-last from 0), text.

    A run of lines of at least min_words words or min_lines lines is deleted where the same lines stood before, in
    the order of doc_id and line; blank lines inside a run go with it. Lines are compared with white space collapsed.
    Null is the empty text, one blank line; a text shorter than a window stays; texts of any length are compared
    whole; of windows in which two lines tie for the least hash the first is the fingerprint in every place; of rows
    that repeat a doc_id the later in input order loses what the earlier holds, and rows without an id come first;
    an empty table gives no rows; extra columns are ignored.
    """
    # row numbers are written before they are used, so that a repeated task can't give others
    keyed = written(with_lines(docs), "line-texts")
    runs = repeats(keyed, min_words, min_lines)
    joined = keyed.select("row", "doc_id", "text").join(runs, "row", "left")
    lines = F.split("text", "\n", -1)
    gone = F.coalesce(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))), F.array().cast("array<int>"))
    kept = joined.withColumns({"lines": lines, "gone": gone})
    rest = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i)), "\n")
    shown = F.array_join(F.transform(F.coalesce("runs", F.expr("cast(array() as array<struct<first:int,last:int>>)")), lambda r: F.concat_ws("-", r["first"], r["last"])), ",")
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), shown.alias("removed"), F.when(F.size("gone") > 0, rest).otherwise(F.col("text")).alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(ls[i], '[ \\t\\r\\x0B\\f]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
l AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM x WHERE line <> ''),
p AS (SELECT a.doc_id, b.doc_id AS other, a.ord - b.ord AS diagonal, a.ord, a.pos, a.words FROM l a JOIN l b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.ord < a.ord))),
i AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY ord) AS island FROM p),
m AS (SELECT DISTINCT doc_id, min(pos) AS a, max(pos) AS b FROM i GROUP BY doc_id, other, diagonal, island HAVING count(*) >= {MIN_LINES} OR sum(words) >= {MIN_WORDS}),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM m),
s AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g),
r AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM s GROUP BY doc_id, island),
v AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a + 1) AS n FROM r GROUP BY 1),
k AS (SELECT doc_id, string_agg(ls[i], chr(10) ORDER BY i) AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) z
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = z.doc_id AND g.pos = z.i - 1) GROUP BY 1)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, coalesce(k.text, '') AS text
FROM d LEFT JOIN v USING (doc_id) LEFT JOIN k USING (doc_id)
"""
}
QUERIES = {"op3_line_dedup": op3_line_dedup}
