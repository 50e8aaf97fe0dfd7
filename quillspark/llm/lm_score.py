"""Language-model scoring with a unigram subword lattice.

The pieces are those of an existing vocabulary; their scores, which are ranks, are made log probabilities by
expectation maximisation over all segmentations of the training documents' distinct words. A text's
probability is the product over its words of the sum over their segmentations (log-space forward recursion), and of
the end symbol's. Beside it stands a second one, word_score, in which a word that training texts hold is also one
piece, with its count less DISCOUNT, and what the discounts free weights the segmentations.

Everything is counted over all documents. The most frequent words, at most HOT of them, are looked up
in a broadcast table; all other words of a text are joined with the table of distinct words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.lattice import Lattice, vocabulary
from quillspark.llm.shared import column, in_batches, most_frequent, slices, table, texts_of, written

#: Default vocabulary; a parameter of `scores`.
VOCABULARY = "piece_bpe_32k.model"
#: Words in the broadcast table, at most.
HOT = 200_000
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
ROUNDS = 2
SMOOTHING = 0.1
DISCOUNT = 0.75
FOLDS = 10


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """Whether the row is not learned from; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def words_of(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, blank and 9 to 13."""
    return text.encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in training documents), total; word null: the documents themselves (the end token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = [*counts[0], *counts[1]]
            n = [*counts[0].values(), *counts[1].values()]
            held = np.arange(len(words)) >= len(counts[0])
            for c in counts:
                c.clear()
            n = np.array(n, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.where(held, 0, n)), pa.array(n)], names=["word", "c", "total"])

        for whole in batches:
            for batch in slices(whole):
                for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                    own = counts[held_out(doc)]
                    own.update(words_of(text))
                    own[None] += 1
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield out()
        yield out()

    parts = in_batches(texts_of(docs), run, "word binary, c long, total long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def fitted(words: DataFrame, vocab: str, rounds: int) -> np.ndarray:
    """Log probability of each piece from the table of words. The vocabulary bounds what comes back."""
    pieces, log_p = vocabulary(vocab)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], log_p=log_p) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(vocabulary(vocab)[0], log_p)
            total = np.zeros(len(log_p))
            for batch in batches:
                total += lattice.expected(column(batch, "word").to_pylist(), np.ones(batch.num_rows))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "e"])

        rows = in_batches(words.where("word is not null and c > 0").select("word"), run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        e = np.full(len(pieces), SMOOTHING)
        e[rows.column("piece").to_numpy()] += rows.column("e").to_numpy()
        log_p = np.log(e / e.sum())
    return log_p


def scores(docs: DataFrame, vocabulary_path: str | None = None, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score (log10).

    Tokens are white-space words, A-Z lower-cased, and an end. A null text is empty: the end alone;
    without training documents every word has the vocabulary's first weights and base_score is 0;
    rows that repeat a doc_id are scored each, a null id counts as the empty text for held_out; texts and words of any
    length are scored whole; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    vocab = vocabulary_path or public_tokenizers.path(VOCABULARY)
    counts = written(word_counts(docs), "lm-counts")
    n, v, ends = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    n, v, ends = n or 0, v or 0, ends or 0
    below = np.log10(n + 0.1 * (v + 1))
    log_p = fitted(counts, vocab, rounds)
    free = float(np.log(DISCOUNT * v / n)) if n else 0.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(vocab)[0], log_p)
        for batch in batches:
            whole = np.maximum(column(batch, "c").to_numpy() - DISCOUNT, 1e-300) / max(n, 1)
            pieces = lattice.log_prob(column(batch, "word").to_pylist())
            both = np.logaddexp(np.log(whole), pieces + free) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces / np.log(10) + no_end), pa.array(both)], names=[*batch.schema.names, "log_p", "word_p"])

    # a step of the model is the end or a word
    p_end = (ends + SMOOTHING) / (n + 2 * SMOOTHING)
    end_base, end_score, no_end = float(np.log10(ends + 0.1)), float(np.log10(p_end)), float(np.log10(1 - p_end))
    end_word = float(np.log10(max(ends - DISCOUNT, SMOOTHING) / max(n, 1)))
    words = written(in_batches(counts.where("word is not null"), weigh, "word binary, c long, total long, log_p double, word_p double"), "lm-words")
    common = most_frequent(words, "total", hot).select("word", "c", "log_p", "word_p").toArrow()  # at most `hot` rows
    sent = spark.sparkContext.broadcast((common.column("word").to_pylist(), *(common.column(x).to_numpy() for x in ("c", "log_p", "word_p"))))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, c, *lp = sent.value
        known = {w: i for i, w in enumerate(names)}
        log_c = np.append(np.log10(c + 0.1), 0.0)  # the last entry is for words that are not in the table
        (lp, wp), seen = (np.append(x, 0.0) for x in lp), np.append(c > 0, False)
        row = TaskContext.get().partitionId() << 40
        last = len(names)
        for whole in batches:
            for batch in slices(whole):
                summary, rest = [], ([], [], [])
                for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                    own = words_of(text)
                    at = np.fromiter((known.get(w, last) for w in own), dtype=np.int64, count=len(own))
                    summary.append((row, doc, len(own) + 1, int(seen[at].sum()) + (ends > 0), float(log_c[at].sum()) + end_base, float(lp[at].sum()) + end_score, float(wp[at].sum()) + end_word))
                    tail = Counter([own[i] for i in np.flatnonzero(at == last)])
                    rest[0].extend([row] * len(tail))
                    rest[1].extend(tail)
                    rest[2].extend(tail.values())
                    row += 1
                k, m = len(summary), len(rest[0])
                s = list(zip(*summary, strict=True))
                longs = ([*s[0], *rest[0]], [*s[1], *[None] * m], [*s[2], *rest[2]], [*s[3], *[0] * m])
                floats = ([*s[i], *[0.0] * m] for i in (4, 5, 6))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), *(pa.array(x, pa.float64()) for x in floats), pa.array([None] * k + rest[1], pa.binary())], names=["row", "doc_id", "n", "known", "base", "score", "word_score", "word"])

    looked = written(in_batches(texts_of(docs), look_up, "row long, doc_id long, n long, known long, base double, score double, word_score double, word binary"), "lm-looked-up")
    tail = looked.where("word is not null").select("row", "word", "n").join(words.select("word", "c", "log_p", "word_p"), "word")
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k2"),
        F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("b2"),
        F.sum(F.col("n") * F.col("log_p")).alias("s2"),
        F.sum(F.col("n") * F.col("word_p")).alias("w2"),
    )
    both = looked.where("word is null").drop("word").join(tail, "row", "left")
    zero = F.lit(0.0)
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
    return both.select(
        "doc_id",
        out.alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", zero) - F.col("n") * F.lit(float(below))).alias("base_score"),
        (F.col("score") + F.coalesce("s2", zero)).alias("score"),
        (F.col("word_score") + F.coalesce("w2", zero)).alias("word_score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op5_lm_score": op5_lm_score}
