"""Exact dedup, near dedup and line dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import exact_dedup, line_dedup, near_dedup, shared


def test_misra_gries_keeps_every_frequent_item():
    items = ["a"] * 40 + ["b"] * 30 + [f"x{i}" for i in range(100)]
    counts = Counter()
    for i in range(0, len(items), 7):
        counts = exact_dedup.misra_gries(counts, Counter(items[i : i + 7]), 5)
    assert {"a", "b"} <= set(counts) and len(counts) <= 5


def check_exact(rows, found):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((i if i is not None else -1, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.text_sha256) for r in found)
    assert got == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found if r.doc_id is not None)


def test_exact_groups(docs, odd):
    rows = [*odd, (None, "no id at all")]
    check_exact(rows, exact_dedup.exact_groups(docs).collect())
    check_exact(rows, exact_dedup.exact_groups(docs, counters=3).collect())


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    ids = sorted({i for i, _ in rows})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_near_groups(spark, odd):
    rows = [*odd, (95, "repeated id, other text"), (10, "one"), (96, odd[7][1]), (96, odd[9][1])]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = brute_components(rows, 3, 85)
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == want
    assert {(r.doc_id, r.n_shingles) for r in found} == {(i, len(shingles(t, 3))) for i, t in rows}
    assert len(set(want.values())) < len(want) - 8


def variants(seed, groups, each, most):
    """Texts of some groups, each with up to `most` of its 150 words changed."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(150)]
        for _ in range(each):
            w = list(base)
            for _ in range(r.randint(0, most)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("held", "block", "stretch"), [(512, 512, 65_536), (512, 8, 65_536), (32, 16, 40), (8, 4, 30)])
def test_near_with_small_bounds(spark, monkeypatch, held, block, stretch):
    """Regions that don't fit into what a walk holds, stretches that cut them, and many blocks give the same components."""
    rows = variants(9, 2, 60, 6) + [(1000 + i, t) for i, t in variants(10, 30, 3, 4)]
    want = brute_components(rows, 5, 80)
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STRETCH", stretch)
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 80).collect()
    assert {x.doc_id: x.component_id for x in found} == want


def test_near_finds_what_links_chains(spark, monkeypatch):
    """A chain whose ends are far apart hangs together by its links alone, however small the blocks."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(40)]
    want = brute_components(rows, 3, 85)
    assert len(set(want.values())) == 1
    for block in (512, 4):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {x.doc_id: x.component_id for x in found} == want


def test_near_recall_of_every_twentieth(spark):
    """Of all links of the rows whose id 20 divides, found by brute force, none joins two components."""
    rows = variants(3, 150, 4, 4)
    found = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(links) > 5 and all(found[i] == found[j] for i, j in links)


@pytest.mark.parametrize("stretch", [65_536, 20])
def test_near_crowded_region_keeps_every_pair(spark, monkeypatch, stretch):
    """Far more rows of one region than a walk holds, none led by another: each has one partner at the other end."""
    r, pairs = np.random.default_rng(5), 60
    sig = r.integers(0, 256, (pairs, near_dedup.TREES * near_dedup.DEPTH), dtype=np.uint8)
    twin = sig.copy()
    twin[:, :20] ^= 1
    label = lambda x: np.array([1, 1, 1, 1, x, 0, 0, 0], dtype=">u4").tobytes()
    rows = [(7, label(i), i, sig[i].tobytes()) for i in range(pairs)] + [(7, label(1000 + i), 1000 + i, twin[i].tobytes()) for i in range(pairs)]
    rows += [(8, label(0), 5000, sig[0].tobytes()), (8, label(1), 5001, twin[0].tobytes())]
    monkeypatch.setattr(near_dedup, "HELD", 16)
    monkeypatch.setattr(near_dedup, "STRETCH", stretch)
    found = near_dedup.candidate_links(spark.createDataFrame(rows, "near long, label binary, class long, sig binary"), 85).collect()
    assert sorted((x.a, x.b) for x in found) == [(i, 1000 + i) for i in range(pairs)] + [(5000, 5001)]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components_by_one_worker_and_by_rounds(spark, monkeypatch, few):
    """A chain, a hub, random edges, loops and repeated edges, by one worker and by rounds."""
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + r.randrange(400), 2000 + r.randrange(400)) for _ in range(250)]
    edges += [(-9, -9), (5000, -5), (-5, 5000), (5000, -5)]
    r.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    monkeypatch.setattr(shared, "FEW_EDGES", few)
    monkeypatch.setattr(shared, "FOUND_ROWS", 100)
    found = shared.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted((x.id, x.component) for x in found) == sorted((x, root(x)) for x in parent)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    """Each round of shuffles costs the driver plans, jobs and tasks, however few the edges are."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        assert {x.component for x in shared.components(edges).collect()} == {0}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_near_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (None, "other words that nobody else has at all"), (None, None), (7, "")]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1, x.kept) for x in found) == [(-1, 0, -1, True), (-1, 6, -1, True), (-1, 48, 5, False), (5, 48, 5, True), (7, 0, 7, True)]


def test_near_odd_inputs(docs, no_docs, odd):
    assert near_dedup.near_groups(docs).count() == len(odd) + 1
    assert near_dedup.near_groups(no_docs).count() == 0


def brute_lines(rows, min_words, min_lines):
    """Removed line numbers of each document: for every pair of places what is equal from there on, if it is a passage."""
    gone, before = defaultdict(set), []
    for i, t in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        lines = [(p, " ".join(x.split())) for p, x in enumerate((t or "").split("\n"))]
        lines = [(p, x) for p, x in lines if x]
        before.append(lines)
        for other in before:
            for a in range(len(lines)):
                for c in range(a if other is lines else len(other)):
                    z = 0
                    while a + z < len(lines) and c + z < len(other) and lines[a + z][1] == other[c + z][1]:
                        z += 1
                    if z >= min_lines or sum(len(x.split()) for _, x in lines[a : a + z]) >= min_words:
                        gone[i].update(range(lines[a][0], lines[a + z - 1][0] + 1))
    return gone


def test_line_dedup(spark):
    passage = "\n".join(f"line {i} of a passage that stands in several documents and has enough words" for i in range(5))
    rows = [(1, f"intro one\n{passage}\nend one"), (2, f"other\n\n{passage}\ntail"), (3, passage), (4, "short line"), (5, "short line"), (6, None), (7, ""), (8, f"{passage}\n{passage}"), (9, "x\n" * 12 + "y"), (10, "a b\nc d\n\ne f")]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 30, 4).collect()
    want = brute_lines(rows, 30, 4)
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        kept = [x for p, x in enumerate(text.split("\n")) if p not in want[r.doc_id]]
        assert (r.n_removed, r.text) == (len(want[r.doc_id]), "\n".join(kept)), r
    assert want[2] and want[3] and want[8] and not want[1] and not want[5]


def test_line_dedup_extends_matches(spark):
    """Lines that go on after the last whole window of a match, with any earlier document and not only the first."""
    r = random.Random(6)
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    long, mid, short = line("a", 60), line("b", 30), line("c", 10)
    rows = [(1, f"{long}\n{mid}\n\n{short}\nend one"), (2, f"{long}\n{mid}\n{short}\nother end"), (3, f"{long}\nx\ny"), (4, f"{long}\nx\nz")]
    rows += [(10 + i, "\n".join(line(r.choice("pqr"), r.choice([1, 10, 30, 60])) for _ in range(r.randint(1, 9)))) for i in range(60)]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows, 50, 6)
    assert {x.doc_id: x.n_removed for x in found} == {i: len(want[i]) for i, _ in rows}
    for x in found:
        assert x.text == "\n".join(t for p, t in enumerate(dict(rows)[x.doc_id].split("\n")) if p not in want[x.doc_id])
    assert [want[i] for i in (1, 2, 3, 4)] == [set(), {0, 1, 2}, {0}, {0, 1}]


def test_line_dedup_selects_few_positions(spark):
    """Of the windows of prose with lines of some words, less than half of the lines are fingerprints, and every window holds one."""
    r = random.Random(2)
    rows = [(i, "\n".join(" ".join(f"w{r.randint(0, 5000)}" for _ in range(9)) for _ in range(60))) for i in range(20)]
    keyed = line_dedup.with_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = keyed.select("ls", line_dedup.selected(50, 6).alias("f")).collect()
    lines, prints = sum(len(x.ls) for x in found), sum(len(x.f) for x in found)
    assert prints < 0.5 * lines
    for x in found:
        assert [(f.lo, f.hi) for f in x.f] == list(zip([0, *(f.hi for f in x.f[:-1])], [f.hi for f in x.f], strict=True)) and x.f[-1].hi == 55


def test_line_dedup_odd_inputs(docs, no_docs, odd):
    assert line_dedup.deduplicated(docs).count() == len(odd) + 1
    assert line_dedup.deduplicated(no_docs).count() == 0
