"""Quality by random-indexing word vectors and a two-layer network.

The most frequent words of all documents, at most VOCABULARY, are told apart as written; any other token
is known by its shape. Each word and each shape has a sparse ternary index vector, drawn from its own hash;
its word vector is the sum of the index vectors of its neighbours in all documents. A document is the
mean word vector of its tokens beside the mean index vector of their shapes; a two-layer network scores it, and
a temperature fitted on labelled rows that the network did not learn from calibrates the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.labelled import SLICE, is_held_out, sample, sigmoid
from quillspark.llm.shared import column, in_batches, mix, most_frequent, released, slices, table, texts_of, written

#: Words with vectors of their own, at most: the size of the table that goes to every task.
VOCABULARY = 16_384
#: Shapes with vectors of their own; more fall together by checksum.
SHAPES = 1024
DIMS, NONZERO, REACH = 48, 6, 2
#: Labelled rows that are learned from, at most.
ROWS = 12_000
HIDDEN = 32
#: Distinct tokens that a task counts before it passes them on, and unknown ones that it remembers.
HELD, REMEMBERED = 200_000, 50_000

# What a token's shape is made of: letters by case, digits and each other byte; runs shortened.
_SHAPE = bytes(0x41 if 65 <= b <= 90 else 0x61 if 97 <= b <= 122 or b >= 128 else 0x30 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape_of(token: bytes) -> int:
    return zlib.crc32(_RUN.sub(rb"\1\1", token.translate(_SHAPE))) % SHAPES


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """A sparse ternary vector for each key, drawn from the key alone."""
    out = np.zeros((len(keys), DIMS), dtype=np.float32)
    h, rows = keys.astype(np.uint64), np.arange(len(keys))
    for _ in range(NONZERO):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        np.add.at(out, (rows, (h >> np.uint64(8)) % np.uint64(DIMS)), np.where(h & np.uint64(1), 1, -1))
    return out


class Tokens(dict):
    """token -> its number: of a known word the word's, of others their shape's, after all words."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.words, self.most = words, len(words) + REMEMBERED
        self.shapes = np.array([*map(shape_of, words), *range(SHAPES)], dtype=np.int64)
        keys = [*(zlib.crc32(w) | zlib.crc32(w[::-1] + b"w") << 32 for w in words), *range(SHAPES)]
        #: Index vectors of words and shapes; the last row is for the gaps between texts.
        self.index = np.concatenate([index_vectors(np.array(keys, dtype=np.uint64)), np.zeros((1, DIMS), dtype=np.float32)])

    def __missing__(self, token: bytes) -> int:
        if len(self) > self.most:
            self.forget()
        self[token] = value = len(self.words) + shape_of(token)
        return value

    def forget(self) -> None:
        self.clear()
        self.update(zip(self.words, range(len(self.words)), strict=True))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' tokens, with REACH gaps after each text, and where each text starts."""
        gap = [len(self.index) - 1] * REACH
        out: list[int] = []
        starts = [0]
        for text in texts:
            out.extend(map(self.__getitem__, text.encode().split()))
            out.extend(gap)
            starts.append(len(out))
        return np.array(out, dtype=np.int64), np.array(starts, dtype=np.int64)


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> list[bytes]:
    """The most frequent tokens of all documents, in order of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return found

        for whole in batches:
            for batch in slices(whole):
                for text in column(batch, "text").to_pylist():
                    counts.update(text.encode().split())
                if len(counts) > HELD:
                    yield out()
        yield out()

    counts = written(in_batches(texts_of(docs).select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "quality-words")
    return sorted(most_frequent(counts, "n", most).select("word").toArrow().column("word").to_pylist())


def word_vectors(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Unit vector of each word and shape from its neighbours in all documents; VOCABULARY and DIMS bound what comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens(words)
        sums = np.zeros(known.index.shape)
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                own, _ = known.numbers(column(batch, "text").to_pylist())
                vectors = known.index[own]
                near = np.zeros_like(vectors)
                for d in range(1, REACH + 1):
                    near[d:] += vectors[:-d]
                    near[:-d] += vectors[d:]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                sums[own[order[first]]] += np.add.reduceat(near[order], first, axis=0)
        sums[-1] = 0
        used = np.flatnonzero(sums.any(1))
        flat = pa.array(sums[used].astype(np.int32).reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIMS), flat)], names=["word", "v"])

    parts = in_batches(texts_of(docs).select("text"), run, "word int, v array<int>")
    summed = parts.groupBy("word").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS))).toArrow()
    out = np.zeros((len(words) + SHAPES + 1, DIMS))
    out[summed.column("word").to_numpy()] = np.stack([summed.column(f"v{i}").to_numpy() for i in range(DIMS)], axis=1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Pooling:
    """A document's vector: mean word vector, mean index vector of shapes, share of repeated tokens, their number."""

    SIZE = 2 * DIMS + 2

    def __init__(self, words: list[bytes], vectors: np.ndarray) -> None:
        self.known = Tokens(words)
        shapes = self.known.index[len(words) + np.append(self.known.shapes, SHAPES)]
        self.both = np.concatenate([vectors, shapes], axis=1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        own, starts = self.known.numbers(texts)
        n = np.diff(starts) - REACH
        out = np.zeros((len(texts), self.SIZE))
        if len(texts):
            same = np.zeros(len(own))
            same[1:] = (own[1:] == own[:-1]) & (own[1:] != len(self.known.index) - 1)
            per = np.maximum(n, 1)[:, None]
            out[:, : 2 * DIMS] = np.add.reduceat(self.both[own], starts[:-1], axis=0) / per
            out[:, -2] = np.add.reduceat(same, starts[:-1]) / per[:, 0]
            out[:, -1] = np.log1p(n) / 10
        return out


class Network:
    """One hidden layer of tanh units; temperature divides the output before the sigmoid."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature) -> None:
        self.parts = (mean, scale, w1, b1, w2, b2, temperature)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2, _ = self.parts
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.parts[-1])


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40) -> Network:
    """Adam on the log loss in fixed batches; every fifth row is kept for the temperature."""
    d = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), np.log(p / (1 - p)), 1.0)
    rng = np.random.default_rng(3)
    aside = np.arange(len(y)) % 5 == 4
    xs, ys = x[~aside], y[~aside]
    mean, scale = xs.mean(0), xs.std(0) + 1e-3
    xs = (xs - mean) / scale
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ys))
        for a in range(0, len(order), 256):
            own = order[a : a + 256]
            h = np.tanh(xs[own] @ p[0] + p[1])
            g = (sigmoid(h @ p[2] + p[3]) - ys[own]) / len(own)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [xs[own].T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            step += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                p[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], p[3], 1.0)
    z = net.logits(x[aside])

    def loss(t: float) -> float:
        q = np.clip(sigmoid(z / t), 1e-9, 1 - 1e-9)
        return float(-(y[aside] * np.log(q) + (1 - y[aside]) * np.log(1 - q)).mean())

    best = min(np.geomspace(0.25, 8, 41), key=loss) if aside.any() else 1.0
    return Network(mean, scale, p[0], p[1], p[2], p[3], float(best))


#: A document with a lower score is rejected.
LEAST = 0.3
#: Name of a column that no table has.
SCORED = "\0scored text"


def matrix(found: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Rows of vectors, without an object for each number."""
    return found.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, Pooling.SIZE)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[list[bytes], np.ndarray, Network]:
    """Words and their vectors from all documents, and the network."""
    words = vocabulary(docs)
    vectors = word_vectors(docs, words)
    pooling: list[Pooling] = []

    def describe(texts: list[str]) -> list[list[float]]:
        if not pooling:
            pooling.append(Pooling(words, vectors))
        return pooling[0](texts).tolist()

    found, y = sample(docs, labels, "quality", rows, describe, "array<double>")
    net = fit(matrix(found, len(y)), y)
    del found
    released()  # else the driver keeps what the fit has freed
    return words, vectors, net


def scored(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= LEAST).

    Null, empty and blank texts have the zero vector and its score; long texts are pooled whole. Without labels of both
    kinds every score is the smoothed share of good labels. Rows that repeat a doc_id are scored each, a null
    id counts as the empty text for held_out; of words as frequent as the last that VOCABULARY has room for all
    or none are known; an empty table gives no rows; extra columns are ignored.
    """
    words, vectors, net = fitted(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled = Pooling(words, vectors)
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(net.score(pooled(column(batch, "text").to_pylist())))], names=["doc_id", "score"])

    found = in_batches(texts_of(docs), run, "doc_id long, score double")
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches LEAST; scored as by `scored`."""
    words, vectors, net = fitted(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled = Pooling(words, vectors)
        for whole in batches:
            own = list(range(whole.num_columns))
            filled = whole.append_column(SCORED, column(whole, "text").fill_null(""))
            for batch in slices(filled, SCORED, most=SLICE):
                yield batch.filter(pa.array(net.score(pooled(column(batch, SCORED).to_pylist())) >= LEAST)).select(own)

    return in_batches(docs, run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op10_quality": op10_quality}
