"""What the operators share: the cluster's shared folder, written tables, word hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        given = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder; cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mark() -> int:
    """A place in the list of working tables, for paths_since."""
    return len(_WRITTEN)


def paths_since(place: int) -> list[str]:
    return _WRITTEN[place:]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete working tables; only when no DataFrame made from them is read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def without(docs: DataFrame, dropped: DataFrame, name: str, most: int = 500_000) -> DataFrame:
    """docs without the rows whose doc_id is in dropped(doc_id). The ids are sent to all tasks while they are
    few, and joined by shuffling beyond that; a null id is never dropped."""
    ids = written(dropped.select("doc_id").distinct(), name)
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, docs["doc_id"] == ids["doc_id"], "left_anti")


#: Bytes of a batch that goes to a worker, at most (but for a longer row): long texts then don't fill memory by the thousand.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; Arrow batches of the session are bounded by BATCH_BYTES unless it has a bound of its own."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty) and the named columns; other columns of the input never matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def released() -> None:
    """Give back to the system what a worker has freed, so that it doesn't grow from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow; at the end of each task `after` is called and freed memory goes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if after:
            after()
        released()

    return df.mapInArrow(task, schema)


def most_frequent(words: DataFrame, n: str, most: int) -> DataFrame:
    """The words from some count on, as many as `most` allows: a histogram of counts finds that count, no row is sorted."""
    level = F.floor(F.log2(F.col(n)) * 16)
    cut, held = 1 << 30, 0
    for level_of, rows in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if held + rows > most:
            break
        cut, held = level_of, held + rows
    return words.where(level >= cut)


# ---------------------------------------------------------------- word hashing

MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15


def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_classes(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word, and its value in a word's hash (A-Z like a-z)."""
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    values = _values(20240229)
    values[65:91] = values[97:123]
    return word, values


#: Words that end at ASCII white space.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters and digits and of all that is not ASCII.
PUNCT = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
BY_SPACE = byte_classes(SPACE)
BY_PUNCT = byte_classes(PUNCT)

_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 20)
        _POW = np.full(size, _MULT, dtype=np.uint64)
        _INV = np.full(size, pow(_MULT, -1, 1 << 64), dtype=np.uint64)
        _POW[0] = _INV[0] = 1
        np.multiply.accumulate(_POW, out=_POW)
        np.multiply.accumulate(_INV, out=_INV)
    return _POW[:n], _INV[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hash_words(data: np.ndarray, offsets: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts that lie end to end in `data`.

    Returns the hash, first byte and end byte of each word, and for each text the index of its first
    word (one entry more than texts). Equal words, but for the case of A-Z, have equal hashes.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = classes[0][data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(classes[1][data] * power, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= np.uint64(_MULT)
        h += words[i : i + n]
    return mix(h + np.uint64(k))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text, so that work memory doesn't follow the batch size."""
    _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, min(j, batch.num_rows) - i)
        i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---------------------------------------------------------------- joins and components

#: A key with more than this share of all rows, and more than LEAST_HOT, is hot: fewer than HOT_KEYS keys can be.
HOT_KEYS, LEAST_HOT = 1024, 200


def keyed_join(rows: DataFrame, stats: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with stats, which holds a row for each key and in `n` how many of the `total` rows have it.

    Hot keys, of which there are fewer than HOT_KEYS, are broadcast, so their rows stay where they are; the others are
    joined by shuffling. A null key matches nothing.
    """
    least = max(total // HOT_KEYS, LEAST_HOT)
    hot = F.broadcast(stats.where(F.col(n) > least))
    common = rows.join(hot, key)
    rest = rows.join(F.broadcast(stats.where(F.col(n) > least).select(key)), key, "left_anti").join(stats.where(F.col(n) <= least), key, how)
    return common.unionByName(rest)


#: Edges whose components one worker finds, in about 100 MB; more take rounds over a distributed table.
FEW_EDGES = 1 << 20
#: Rows of a partition of what that worker finds.
FOUND_ROWS = 16_384


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of edges (a, b), and the smallest id reachable from each."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and the smallest id reachable from it, for every id in edges(a, b), which are read more than once.

    Up to FEW_EDGES edges, one worker finds them. Beyond that, alternating large-star and small-star steps over a
    distributed edge table, written anew each
    round. A hub's neighbours are rows of aggregates that combine before the shuffle, and where a node has more edges
    than keyed_join takes for common, its edges meet the aggregate by that. Ends when a round changes nothing; raises
    if that never happens.
    """
    spark = edges.sparkSession
    place = mark()
    pairs = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v")
    n = pairs.count()
    if n <= FEW_EDGES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
            found = least_reachable(t.column("u").to_numpy(), t.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "component"])

        found = in_batches(pairs.coalesce(1), run, "id long, component long")
        return found.repartition(-(-n // FOUND_ROWS)) if n > FOUND_ROWS else found
    e = written(pairs.distinct(), "edges")
    before, now = None, _state(e)
    for _ in range(rounds):
        n, hot = now[0], max(now[2], now[3]) > max(now[0] // HOT_KEYS, LEAST_HOT) // 2
        meet = (lambda rows, stats, key, total: keyed_join(rows, stats, key, "n", total)) if hot else (lambda rows, stats, key, total: rows.join(stats, key))
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: neighbours above go to the least neighbour
        large = meet(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        large = written(large.distinct(), "edges") if hot else large
        # small star: neighbours below, and the node itself, go to the least below
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = meet(large, low, "v", n).select(F.col("u").alias("a"), F.col("m").alias("b")).union(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
        e = written(small.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        # the tables of the round before are read no more
        *old, own = paths_since(place)
        remove(spark, old)
        del _WRITTEN[place:]
        _WRITTEN.append(own)
        freed(spark)
        before, now = now, _state(e)
        if now == before and now[3] <= 1:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).union(e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())


def freed(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files go when nothing refers to their shuffle any more, and many small
    shuffles would else pile up."""
    spark.sparkContext._jvm.System.gc()


def _state(e: DataFrame) -> tuple:
    """Of edges (u, v): how many, a checksum, and the most edges of a node as u and as v."""
    ends = e.select(F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("u").alias("id"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h")), F.struct(F.lit(1).alias("end"), F.col("v").alias("id"), F.lit(0).cast("decimal(38,0)").alias("h")))))
    per = ends.groupBy("end", "id").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    most = lambda k: F.coalesce(F.max(F.when(F.col("end") == k, F.col("n"))), F.lit(0))
    return tuple(per.agg(F.coalesce(F.sum(F.when(F.col("end") == 0, F.col("n"))), F.lit(0)), F.sum("h"), most(0), most(1)).first())
