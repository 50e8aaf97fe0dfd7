"""Benchmark decontamination by winnowing.

Every document keeps the minimum hash of each run of `WINDOW - GRAM + 1` consecutive GRAM-word grams.
A span of WINDOW words that document and benchmark share has the same minimum in both, so it shares a
fingerprint: none is missed. Fingerprint hits are extended both ways and compared word by word.
The benchmark side is fetched in blocks of a fixed number of words; each block meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import BY_PUNCT, column, grams, hash_words, in_batches, slices, table, text_buffer, texts_of

WINDOW = 8
GRAM = 4
#: Words of benchmark text that go to the executors at once.
BLOCK_WORDS = 2_000_000


def fingerprints(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the grams that are minima of a window of `window` words (rightmost of equals)."""
    h = grams(words, gram)
    w = window - gram + 1
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, at = h[w - 1 : w - 1 + n].copy(), np.arange(w - 1, w - 1 + n)
    for back in range(1, w):
        other = h[w - 1 - back : w - 1 - back + n]
        smaller = other < least
        least[smaller] = other[smaller]
        at[smaller] = np.flatnonzero(smaller) + w - 1 - back
    return np.unique(at)


class Index:
    """Fingerprints of benchmark items, and their words for the comparison that confirms a hit."""

    def __init__(self, items: list[tuple[int, str]], window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        text = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(text), dtype=np.uint8)
        words, _, _, first = hash_words(data, np.cumsum([0, *map(len, text)]), BY_PUNCT)
        self.ids = [i for i, _ in items]
        self.words = words
        self.of = np.repeat(np.arange(len(items)), np.diff(first))
        self.first = first
        self.short: dict[int, dict[int, list[int]]] = {}
        prints: list[tuple[int, int]] = []
        for k in range(len(items)):
            own = words[first[k] : first[k + 1]]
            if 0 < len(own) < window:
                self.short.setdefault(len(own), {}).setdefault(int(grams(own, len(own))[0]), []).append(k)
            elif len(own):
                h = grams(own, gram)
                prints += [(int(h[p]), int(first[k]) + int(p)) for p in fingerprints(own, gram, window)]
        prints.sort()
        self.keys = np.array([h for h, _ in prints], dtype=np.uint64)
        self.at = np.array([p for _, p in prints], dtype=np.int64)

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, end word) of the spans of one text's words that an item shares: maximal
        extensions of at least `window` words, and whole short items."""
        found: set[tuple[int, int, int]] = set()
        if len(self.keys) and len(words) >= self.window:
            own = grams(words, self.gram)
            picked = fingerprints(words, self.gram, self.window)
            left = np.searchsorted(self.keys, own[picked], side="left")
            right = np.searchsorted(self.keys, own[picked], side="right")
            ahead: dict[tuple[int, int], int] = {}  # diagonal -> end of its last extension
            for p, a, b in zip(picked[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
                for q in self.at[a:b].tolist():
                    k = int(self.of[q])
                    lo, hi = int(self.first[k]), int(self.first[k + 1])
                    if ahead.get((k, p - q), -1) > p:
                        continue
                    n = min(len(words) - p, hi - q)
                    differ = np.flatnonzero(words[p : p + n] != self.words[q : q + n])
                    end = p + (int(differ[0]) if len(differ) else n)
                    m = min(p, q - lo)
                    differ = np.flatnonzero(words[p - m : p] != self.words[q - m : q])
                    start = p - m + (int(differ[-1]) + 1 if len(differ) else 0)
                    ahead[(k, p - q)] = max(end, p + 1)
                    if end - start >= self.window:
                        found.add((k, start, end))
        for n, known in self.short.items():
            own = grams(words, n)
            for p in np.flatnonzero(np.isin(own, np.fromiter(known, dtype=np.uint64))).tolist():
                found.update((k, p, p + n) for k in known[int(own[p])])
        return sorted(found)


SPANS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64())))])


def scan(docs: DataFrame, items: list[tuple[int, str]], window: int, gram: int, keyed: bool = False) -> DataFrame:
    """Each document against a block of items: n_words, n_hit, items, and spans [item_id, first word, end word];
    when keyed, digest (of the text) too."""
    more = ["digest"] if keyed else []
    schema = pa.schema([*SPANS, *(pa.field(c, pa.string()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, window, gram)
        for whole in batches:
            for batch in slices(whole):
                words, _, _, first = hash_words(*text_buffer(column(batch, "text")), BY_PUNCT)
                rows = []
                for i, doc in enumerate(column(batch, "doc_id").to_pylist()):
                    own = words[first[i] : first[i + 1]]
                    hits = index.hits(own)
                    inside = np.zeros(len(own) + 1, dtype=np.int64)
                    for _, a, b in hits:
                        inside[a] += 1
                        inside[b] -= 1
                    rows.append((doc, len(own), int((np.cumsum(inside)[:-1] > 0).sum()) if hits else 0, sorted({index.ids[k] for k, _, _ in hits}), [[index.ids[k], a, b] for k, a, b in hits]))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), SPANS, strict=True)] + [column(batch, c).cast(pa.string()) for c in more], schema=schema)

    texts = texts_of(docs)
    if keyed:
        texts = texts.withColumn("digest", F.sha2("text", 256))
    return in_batches(texts, run, "doc_id long, n_words long, n_hit long, items array<long>, spans array<array<long>>" + "".join(f", {c} string" for c in more))


def blocks(bench: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `most` words; one block is on the driver at a time."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    block: list[tuple[int, str]] = []
    held = 0
    for row in rows.toLocalIterator():
        n = len(row["text"]) // 5 + 1
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += n
    yield block


def overlaps(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans: what each document shares with the benchmark.

    A span of `window` words of an item, or a whole shorter item, counts wherever it stands. Null and
    wordless texts have no words and no hits; long texts are searched whole; items without words or id never match; an empty
    benchmark gives rows without hits; a row that repeats a doc_id gets a row of its own. Several blocks
    are joined by doc_id and digest of the text, and rows equal in both come out as often as they stand in
    docs; extra columns are ignored.
    """
    held = blocks(bench, block_words)
    first, second = next(held), next(held, None)
    if second is None:
        return scan(docs, first, window, gram)
    parts = [scan(docs, block, window, gram, keyed=True) for block in chain((first, second), held)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy("doc_id", "digest").agg(F.max("n_words").alias("n_words"), F.count("*").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    sorted_spans = F.array_sort(F.transform("spans", lambda s: F.struct(s[1].alias("a"), s[2].alias("b"))))
    covered = F.aggregate(
        sorted_spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")),
        lambda acc: acc["n"],
    )
    merged = merged.select("doc_id", "n_words", covered.alias("n_hit"), "items", "spans", (F.col("rows") / len(parts)).cast("int").alias("rows"))
    return merged.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).drop("row", "rows")


def verdicts(docs: DataFrame, bench: DataFrame) -> DataFrame:
    found = overlaps(docs, bench)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = {
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
QUERIES = {"op6_decontaminate": op6_decontaminate}
