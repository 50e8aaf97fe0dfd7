"""MinHash near-dedup with an LSH forest.

1. One pass over the texts gives each document its set's size, a class (documents with the same set) and, for
   each of TREES trees, a hash of the first SHALLOW values of its label: a run of DEPTH minimum hashes.
2. Classes that share such a beginning with another one are read again for their labels, signatures and
   full sets. Each tree orders them by label. In the sorted order a region is a stretch of labels that begin with
   the same SHALLOW values, and its members are compared by the agreement of their signatures. A task walks its
   stretch of the order and holds HELD rows of a region: when there are more, rows that agree with a
   neighbour nearly everywhere leave it behind as their leader. If too many leaders are left, those stay that share a
   longer prefix with where the walk stands, and the others are set aside. Regions at the ends of a
   stretch hand their leaders on, and these are ordered and walked again, until one task holds them all. Where any
   were set aside, all leaders of the region are then compared with each other, in blocks of HELD.
3. Links found form clusters. Every class is confirmed on its full set against the neighbour before it that agrees
   best. Where that doesn't hold a cluster together, the classes outside its largest part are compared with
   all others of the cluster, in blocks of bounded size.
4. Components of the confirmed links, and the smallest doc_id of each.

At similarity 0.85 a pair shares no region in any of 32 trees with probability 6e-11 (0.80: 5e-8). Inside a region no pair
is left out, however many rows it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import BY_SPACE, checkpointed, column, components, freed, grams, hash_words, in_batches, keyed_join, mix, slices, table, text_buffer, texts_of, written

TREES, DEPTH, SHALLOW = 32, 8, 4
#: Rows of a region that a walk holds before it keeps leaders alone.
HELD = 512
#: Rows of one side in a task that confirms.
BLOCK = 128
#: Rows of an order that one task walks when leaders are handed on.
STRETCH = 65_536
#: Share of places in which a row agrees with its leader, and how far it can be from it but for five deviations.
COVERED, RADIUS = 0.95, 0.12
#: Sums of two rows' levels that are told apart; from the last one on any two rows are alike.
LEVELS = 16
#: Broadcast of the rows whose texts are read again, at most; beyond it they are joined by shuffling.
BROADCAST_ROWS = 500_000

_SEEDS = np.random.default_rng(7).integers(1, 1 << 32, (TREES * DEPTH, 2), dtype=np.uint32) | np.uint32(1)
_LABEL = DEPTH * 4


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words are one shingle, none are none."""
    words, _, _, first = hash_words(*text_buffer(texts), BY_SPACE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = words[a:b]
        h = np.sort(grams(own, k if b - a >= k else b - a)) if b > a else own
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of non-empty sets, a row for each set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(_SEEDS)), dtype=np.uint32)
    work = np.empty_like(flat)
    for i, (a, b) in enumerate(_SEEDS):
        np.bitwise_xor(flat, b, out=work)
        np.multiply(work, a, out=work)
        out[:, i] = np.minimum.reduceat(work, at)
    return out


def class_of(s: np.ndarray) -> int:
    """The id of all documents with this set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _beginnings(sig: np.ndarray) -> np.ndarray:
    """For each row and tree, a hash of the label's first SHALLOW values and the tree."""
    s = sig.reshape(len(sig), TREES, DEPTH).astype(np.uint64)
    h = np.arange(TREES, dtype=np.uint64)[None, :].repeat(len(sig), 0) + np.uint64(SHALLOW * 1000)
    for i in range(SHALLOW):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return h.view(np.int64)


def described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (null: empty set), near (the beginning of its label in each tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(column(batch, "text"), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                own, near = [None] * len(sets), [None] * len(sets)
                if full:
                    found = _beginnings(signatures([sets[i] for i in full]))
                    for j, i in enumerate(full):
                        own[i], near[i] = class_of(sets[i]), found[j]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "class", "near"])

    return in_batches(texts_of(docs).withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, n_shingles long, class long, near array<long>")


def members_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """class, labels (of all trees), sig (a byte a hash), shingles (sorted, 8 bytes each) of the classes in
    wanted(class, doc_id, text_hash), each from the row that stands for it."""
    text = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    chosen = text.join(few.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(column(batch, "text"), k)
                right = [i for i, (s, c) in enumerate(zip(sets, column(batch, "class").to_pylist(), strict=True)) if len(s) and class_of(s) == c]
                if right:
                    sets = [sets[i] for i in right]
                    rows = signatures(sets)
                    small = mix(rows.astype(np.uint64)).astype(np.uint8)
                    labels = rows.astype(">u4")
                    yield pa.RecordBatch.from_arrays([column(batch, "class").take(pa.array(right)), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (labels, small, sets))], names=["class", "labels", "sig", "shingles"])

    found = in_batches(chosen.select("class", "text"), run, "class long, labels binary, sig binary, shingles binary")
    return found.dropDuplicates(["class"])


# ---------------------------------------------------------------- the walk along the sorted orders


def _thresholds(percent: int) -> np.ndarray:
    """Agreeing places, but for five standard deviations, of a pair at the threshold, by the sum of its rows' levels: a
    leader is one level above the highest that it leads."""
    n = TREES * DEPTH
    p = np.maximum(percent / 100 - RADIUS * np.arange(LEVELS), 0.01)
    return (n * p - 5 * (n * p * (1 - p)) ** 0.5).astype(np.int64)


def spanning(ids: np.ndarray, sig: np.ndarray, leads: np.ndarray, part: np.ndarray, least: np.ndarray, first: int, cut: int = 0) -> list[tuple[int, int, int]]:
    """(id, id, agreement): for each row from `first` on its best neighbour in each part that it is alike to, among the
    rows before it or, where `cut` is given, before that. Changes part."""
    out = []
    for j in range(max(first, 1), len(ids)):
        m = cut or j
        agree = np.count_nonzero(sig[:m] == sig[j], axis=1)
        found = np.flatnonzero(agree >= least[np.minimum(leads[:m] + leads[j], LEVELS - 1)])
        while len(found):
            best = int(found[len(found) - 1 - np.argmax(agree[found][::-1])])  # of equals the nearest
            out.append((int(ids[best]), int(ids[j]), int(agree[best])))
            old = part[best]
            part[:j][part[:j] == old] = part[j]
            found = found[part[found] != part[j]]
    return out


class Region:
    """What a walk holds of one region, in the order of labels."""

    def __init__(self, begins: int, whole: bool) -> None:
        self.begins, self.whole, self.over = begins, whole, False
        self.ids = np.zeros(0, dtype=np.int64)
        self.sig, self.labels = np.zeros((0, TREES * DEPTH), dtype=np.uint8), np.zeros((0, DEPTH), dtype=">u4")
        self.leads = np.zeros(0, dtype=np.int64)
        self.joined = 0  # rows whose links are known
        self.part = np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray, sig: np.ndarray, labels: np.ndarray, leads: np.ndarray) -> None:
        self.ids, self.leads = np.concatenate([self.ids, ids]), np.concatenate([self.leads, leads])
        self.sig, self.labels = np.concatenate([self.sig, sig]), np.concatenate([self.labels, labels])

    def links(self, least: np.ndarray) -> list[tuple[int, int, int]]:
        """(id, id, agreement): for each new row its best neighbour in each part that it is alike to."""
        n, part = len(self.ids), np.arange(len(self.ids)) + len(self.ids)
        part[: self.joined] = self.part
        out = spanning(self.ids, self.sig, self.leads, part, least, self.joined)
        self.part, self.joined = part, n
        return out

    def lead(self, most: int | None) -> list[tuple[int, np.ndarray, int]]:
        """Keep leaders alone, and of more than `most` those that share the longest prefixes with the last row; returns
        the others: (id, signature, level)."""
        covered, leaders = np.zeros(len(self.ids), dtype=bool), []
        least = int(COVERED * TREES * DEPTH)
        for j in range(len(self.ids)):
            if not covered[j]:
                leaders.append(j)
                alike = np.count_nonzero(self.sig[j:] == self.sig[j], axis=1) >= least
                own = np.flatnonzero(alike[1:] & ~covered[j + 1 :]) + j + 1
                if len(own):
                    self.leads[j] = max(self.leads[j], 1 + self.leads[own].max())
                covered[j:] |= alike
        keep, aside = np.array(leaders, dtype=np.int64), []
        if most is not None and len(keep) > most:
            shared = np.cumprod(self.labels[keep] == self.labels[-1], axis=1).sum(axis=1)
            depth = SHALLOW
            while np.count_nonzero(shared >= depth) > most and depth < DEPTH:
                depth += 1
            near = keep[shared >= depth][-most:]
            aside = [(int(self.ids[i]), self.sig[i], int(self.leads[i])) for i in np.setdiff1d(keep, near)]
            keep, self.over = near, True
        self.ids, self.sig, self.labels, self.leads, self.part = self.ids[keep], self.sig[keep], self.labels[keep], self.leads[keep], self.part[keep]
        self.joined = len(keep)
        return aside


_WALKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("near", pa.int64()), ("label", pa.binary()), ("class", pa.int64()), ("sig", pa.binary()), ("leads", pa.int64()), ("kind", pa.int32())])
#: Kinds of rows that a walk gives beside links: for the next walk, set aside, leaders at the end of a region.
HANDED, ASIDE, ENDED = 0, 1, 2


def walked(ordered: DataFrame, percent: int, first: bool, last: bool) -> DataFrame:
    """Links (a, b, agree) of a sorted order's stretches, and rows (near, label, class, sig, leads, kind): of regions that
    may go on in a neighbouring stretch, set aside, and what is left of a region in which rows were or may have been set
    aside. `first`: of the first walk; `last`: one stretch holds all."""
    least, held = _thresholds(percent), HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region: Region | None = None
        links: list[tuple[int, int, int]] = []
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            a, b, agree = zip(*links, strict=True) if links else ((), (), ())
            more = list(zip(*rows, strict=True)) if rows else [()] * 6
            n, m = len(links), len(rows)
            columns = [*([*c, *[None] * m] for c in (a, b, agree)), *([*[None] * n, *c] for c in more)]
            links.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WALKED, strict=True)], schema=_WALKED)

        def thin(r: Region, most: int | None) -> None:
            rows.extend((r.begins, None, i, sig.tobytes(), level, ASIDE) for i, sig, level in r.lead(most))

        def close(r: Region) -> None:
            links.extend(r.links(least))
            if not r.whole or r.over or not first:
                thin(r, None if r.whole else held // 2)
                rows.extend((r.begins, r.labels[i].tobytes(), int(r.ids[i]), r.sig[i].tobytes(), int(r.leads[i]), ENDED if r.whole else HANDED) for i in range(len(r.ids)))

        for batch in batches:
            if not batch.num_rows:
                continue
            near = column(batch, "near").to_numpy()
            ids, leads = column(batch, "class").to_numpy(), column(batch, "leads").to_numpy()
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            labels = np.frombuffer(b"".join(column(batch, "label").to_pylist()), dtype=">u4").reshape(len(ids), -1)
            cuts = np.concatenate(([0], np.flatnonzero(near[1:] != near[:-1]) + 1, [len(near)]))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if region is None or region.begins != near[s]:
                    if region is not None:
                        close(region)
                    region = Region(int(near[s]), last or region is not None)
                for i in range(s, e, held):
                    j = min(i + held, e)
                    region.add(ids[i:j], sig[i:j], labels[i:j], leads[i:j])
                    if len(region.ids) > held:
                        links.extend(region.links(least))
                        thin(region, held // 2)
            yield out()
        if region is not None:
            region.whole = last
            close(region)
        yield out()

    kinds = "a long, b long, agree int, near long, label binary, class long, sig binary, leads long, kind int"
    return in_batches(ordered.select("near", "label", "class", "sig", "leads"), run, kinds)


def links_of_leaders(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, agree of rows(near, class, sig, leads): spanning links of each region, from all its pairs. A region's rows
    are dealt to n / HELD blocks, and each two blocks meet in a task."""
    rows, least = checkpointed(rows), _thresholds(percent)
    sizes = checkpointed(rows.groupBy("near").agg(F.count("*").alias("n"), F.ceil(F.count("*") / HELD).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    dealt = keyed_join(rows, sizes, "near", "n", rows.count()).select("near", "class", "sig", "leads", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("near", "class", "sig", "leads", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("own", "ascending"), ("class", "ascending")])
        own, ids, leads = (t.column(c).to_numpy() for c in ("own", "class", "leads"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        both = t.column("x")[0] != t.column("y")[0]
        cut = int(np.searchsorted(own, t.column("y")[0].as_py())) if both else 0
        found = spanning(ids, sig, leads, np.arange(len(ids)), least, cut, cut) if cut or not both else []
        return pa.table([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "agree"])

    return dealt.groupBy("near", "x", "y").applyInArrow(run, "a long, b long, agree int")


def candidate_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, agree (a < b) of rows(near, label, class, sig) that look alike in an order: spanning links of each region."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("leads", F.lit(0).cast("long")), "near-order")
    parts, found = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (8 * STRETCH)), 1), []
    steps: list[DataFrame] = []
    while True:
        by = ["near", "label", "class"]
        ordered = rows.coalesce(1).sortWithinPartitions(*by) if parts == 1 else rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        step = written(walked(ordered, percent, not steps, parts == 1), "near-walk")
        steps.append(step)
        found.append(step.where("a is not null").select("a", "b", "agree"))
        if parts == 1:
            break
        rows = step.where(F.col("kind") == HANDED).select("near", "label", "class", "sig", "leads")
        n = rows.count()
        if not n:
            break
        # each stretch hands on HELD rows at most, so the number of stretches falls fast
        parts = min(parts // 2, -(-n // STRETCH))
        parts = max(parts, 1)
    leaders = reduce(DataFrame.union, steps).where(F.col("kind") > HANDED).select("near", "class", "sig", "leads", "kind")
    crowded = leaders.where(F.col("kind") == ASIDE).select("near").distinct()
    if not crowded.isEmpty():
        found.append(links_of_leaders(leaders.drop("kind").join(crowded, "near", "left_semi"), percent))
    links = reduce(DataFrame.union, found)
    return links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree"))


# ---------------------------------------------------------------- confirmation on full sets


def shared_count(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = shared_count(x, y)
    return 100 * both >= percent * (n + m - both)


def _sets(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in t.column("shingles").to_pylist()]


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def best_links(links: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of each class with the one that agrees best among those of smaller number. The classes
    that share such a neighbour are dealt to tasks by BLOCK, and the neighbour goes to each."""
    best = links.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a"))
    many = best.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    best, many = checkpointed(best), checkpointed(many)
    own = keyed_join(best, many, "a", "n", best.count())
    own = own.select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("class"))
    to = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("class"))
    rows = own.union(to).join(members.select("class", "shingles"), "class")

    def run(t: pa.Table) -> pa.Table:
        a, ids, sets = t.column("a")[0].as_py(), t.column("class").to_pylist(), _sets(t)
        first = sets[ids.index(a)] if a in ids else np.zeros(0, dtype="<u8")
        return _pairs([(a, b) for b, s in zip(ids, sets, strict=True) if b != a and linked(first, s, percent)])

    return rows.groupBy("a", "salt").applyInArrow(run, "a long, b long")


def other_links(parted: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Confirmed spanning links (a, b) between the parts of clusters: parted(cluster, part, class).

    The largest part of a cluster needs no links inside itself. With k classes outside it, a class of it goes to
    k / BLOCK tasks, and one outside it to all blocks of the cluster.
    """
    sizes = parted.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    clusters = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("n_largest"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    clusters = checkpointed(clusters.select("cluster", "largest", "n", blocks(F.col("n_largest")).alias("ins"), blocks(F.col("n") - F.col("n_largest")).alias("outs")))
    rows = keyed_join(parted, clusters, "cluster", "n", parted.count())
    inside = F.col("part") == F.col("largest")
    own = F.pmod(F.xxhash64("class"), F.when(inside, F.col("ins")).otherwise(F.col("outs"))).cast("int")
    # blocks of the largest part have negative numbers
    rows = rows.select("cluster", "part", "class", "ins", "outs", F.when(inside, -1 - own).otherwise(own).alias("own"))
    others = F.when(F.col("own") < 0, F.sequence(F.lit(0), F.col("outs") - 1)).otherwise(F.sequence(-F.col("ins"), F.col("outs") - 1))
    dealt = rows.select("cluster", "part", "class", "own", F.explode(others).alias("other"))
    dealt = dealt.select("cluster", "part", "class", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).join(members.select("class", "sig", "shingles"), "class")
    least = int(_thresholds(percent)[0])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("own", "ascending"), ("class", "ascending")])
        own, ids = t.column("own").to_numpy(), t.column("class").to_pylist()
        part = np.unique(t.column("part").to_numpy(), return_inverse=True)[1]
        sig, sets = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1), _sets(t)
        cut = int(np.searchsorted(own, own[-1]))  # two blocks: only rows of different ones are compared
        out = []
        for i in range(cut or len(ids)):
            start = max(i + 1, cut)
            alike = np.flatnonzero(np.count_nonzero(sig[start:] == sig[i], axis=1) >= least) + start
            for j in alike.tolist():
                if part[i] != part[j] and linked(sets[i], sets[j], percent):
                    part[part == part[j]] = part[i]
                    out.append((ids[i], ids[j]))
        return _pairs(out)

    return dealt.groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of k-word shingles;
    component_id is the smallest doc_id that links reach. Null, empty and wordless texts have empty
    sets and stand alone; a text of fewer than k words is one shingle; rows that repeat a doc_id
    link all that any of them is linked with and share a component; a row without an id has the component of
    what it is linked with, and is kept where that has no id at all; texts of any length are taken whole; an
    empty table gives no rows; extra columns are ignored.
    """
    base = written(described(docs, k), "near-described")
    n = base.count()
    classes = base.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("near").alias("near"), F.count("*").alias("n"))
    classes = written(classes, "near-classes")

    # classes that share a beginning of a label with another one
    starts = classes.select("class", F.posexplode("near").alias("tree", "near"))
    sizes = checkpointed(starts.groupBy("near").agg(F.count("*").alias("n")).where("n > 1"))
    shared = checkpointed(keyed_join(starts, sizes, "near", "n", TREES * n).select("class", "tree", "near"))
    wanted = checkpointed(classes.join(shared.select("class").distinct(), "class").select("class", "row.doc_id", "row.text_hash"))
    members = written(members_of(docs, wanted, k), "near-members")
    freed(docs.sparkSession)
    label = F.expr(f"substring(labels, tree * {_LABEL} + 1, {_LABEL})")
    order = shared.join(members.select("class", "labels", "sig"), "class").select("near", label.alias("label"), "class", "sig")
    links = checkpointed(candidate_links(order, percent))

    first = checkpointed(best_links(links, members, percent))
    freed(docs.sparkSession)
    parts = checkpointed(components(first))
    freed(docs.sparkSession)
    # links between parts: a cluster is what they tie together
    part_of = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"part_{end}"))
    across = links.join(part_of("a"), "a", "left").join(part_of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    across = checkpointed(across.where("a <> b").distinct())
    more = first.limit(0)
    if not across.isEmpty():
        clusters = checkpointed(components(across).select(F.col("id").alias("part"), F.col("component").alias("cluster")))
        sizes = parts.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("n"))
        inside = keyed_join(parts.select(F.col("component").alias("part"), F.col("id").alias("class")), checkpointed(clusters.join(sizes, "part")), "part", "n", parts.count())
        lone = clusters.join(sizes, "part", "left_anti").withColumn("class", F.col("part"))
        parted = checkpointed(inside.select("cluster", "part", "class").union(lone.select("cluster", "part", "class")))
        more = checkpointed(other_links(parted, members, percent))
        freed(docs.sparkSession)

    # rows that share an id tie their classes
    repeated = base.where("doc_id is not null and class is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    ties = base.join(repeated, "doc_id").where("class <> a").select("a", F.col("class").alias("b"))
    more = checkpointed(more.union(ties))
    if more.isEmpty():
        found = parts
    else:
        # what was found already is a star for each part
        found = checkpointed(components(parts.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more)))

    groups = classes.select("class", "n", "doc_id").join(found.select(F.col("id").alias("class"), "component"), "class", "left")
    groups = checkpointed(groups.select("class", "n", "doc_id", F.coalesce("component", "class").alias("component")))
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes"))
    least = keyed_join(groups.select("class", "n", "component"), checkpointed(least), "component", "classes", n).select("class", "n", "component_id")
    known = keyed_join(base.where("class is not null").select("doc_id", "n_shingles", "class"), checkpointed(least), "class", "n", n).select("doc_id", "n_shingles", "component_id")
    alone = base.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.union(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
}
QUERIES = {"op4_near_dedup": op4_near_dedup}
