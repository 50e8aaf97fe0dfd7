"""License scan, language-model score, decontamination, toxicity and quality."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa

from quillspark.llm import decontaminate, license_scan, lm_score, quality, toxicity
from quillspark.llm.lattice import OPEN, Lattice
from quillspark.llm.shared import BY_PUNCT, BY_SPACE, hash_words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def test_hash_words_splits_as_the_pattern_does(odd):
    texts = [t or "" for _, t in odd]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    for classes, split in ((BY_PUNCT, words), (BY_SPACE, lambda t: [w.decode() for w in t.encode().lower().split()])):
        h, _, _, first = hash_words(data, at, classes)
        seen = {}
        for i, t in enumerate(texts):
            own = split(t)
            assert first[i + 1] - first[i] == len(own)
            for w, x in zip(own, h[first[i] : first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def brute_license(text):
    w = words(text)
    found = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    labels, score = {x for _, x in found}, 1.0 if found else 0.0
    for name, t in license_scan.TEMPLATES.items():
        own = [x.decode() for x in license_scan.words_of(t)]
        n = license_scan.block_length(len(own))
        c = max((len(set(own).intersection(w[a : a + n])) for a in range(max(len(w) - n, 0) + 1)), default=0) / len(set(own))
        if c >= license_scan.THRESHOLD:
            labels.add(name)
            score = max(score, c)
    return (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), round(score, 9))


def test_license_scan(spark, odd):
    r = random.Random(2)
    rows = list(odd)
    for i, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        filler = " ".join(f"f{r.randint(0, 99)}" for _ in range(90))
        rows += [(1000 + i, f"{filler} {t} {filler}"), (1100 + i, t.upper()), (1200 + i, " ".join(t.split()[:-3])), (1300 + i, f"{t}\n{t}")]
        rows.append((1400 + i, " ".join(x for k, x in enumerate(t.split()) if k % 12 != 5)))
    rows += [(1500, "the table was reserved for all of them and they had rights to it")]
    rows += [(2000, "MIT-License, apache   license; general/public/license MIT mit license")]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((x.doc_id, x.n_words, x.n_base, x.first_word or -1, x.last_word or -1, x.base_labels, x.labels, round(x.score, 9)) for x in found)
    want = sorted((i, *(v if v is not None else -1 for v in [brute_license(t)[0]]), *[(v or -1) if k in (1, 2) else v for k, v in enumerate(brute_license(t)[1:])]) for i, t in rows)
    assert [(*x[:3], *x[5:]) for x in got] == [(*x[:3], *x[5:]) for x in want]
    assert [x[3:5] for x in got] == [x[3:5] for x in want]
    labels = {x.doc_id: x.labels for x in found}
    assert labels[1500] == ""
    assert all(name in labels[1000 + i].split(",") and name in labels[1100 + i].split(",") for i, name in enumerate(license_scan.TEMPLATES))


def test_license_scan_of_odd_tables(docs, no_docs, odd):
    assert license_scan.scanned(docs).count() == len(odd) + 1
    assert license_scan.scanned(no_docs).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [OPEN, b"a", b"b", b"ab", OPEN + b"a", b"ba", OPEN + b"ab"]
    p = np.log(np.arange(1, 8) / 28)
    lattice = Lattice(pieces, p)

    @cache
    def brute(s):
        return 1.0 if not s else sum(math.exp(p[k]) * brute(s[len(x) :]) for k, x in enumerate(pieces) if s.startswith(x))

    own = [b"a", b"ab", b"abba", b"", b"ba" * 30]
    for w, got in zip(own, lattice.log_prob(own), strict=True):
        assert math.isclose(got, math.log(brute(OPEN + w)), rel_tol=1e-9)
    counts = np.array([3.0, 1.0, 2.0, 1.0, 1.0])
    expected = lattice.expected(own, counts)
    # derivative of the weighted log probability in a piece's log weight is its expected count
    for k in range(len(pieces)):
        q = p.copy()
        q[k] += 1e-6
        assert math.isclose(((Lattice(pieces, q).log_prob(own) - lattice.log_prob(own)) * counts).sum() / 1e-6, expected[k], abs_tol=1e-3)


def test_lm_scores(spark, odd):
    rows = [(i, t) for i, t in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*(t or "").encode().lower().split(), "end"])
    want = sorted((i, round(base(t), 6)) for i, t in rows)
    first = None
    for hot in (5, 1000):  # nearly all words by the join, and all by the table
        found = lm_score.scores(docs, hot=hot).collect()
        assert sorted((x.doc_id, round(x.base_score, 6)) for x in found) == want
        assert all(x.train_tokens == n and x.score < 0 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 10 == 0) for x in found)
        scores = sorted((x.doc_id, round(x.score, 6), x.n_known, x.n_tokens) for x in found)
        assert first in (None, scores)
        first = scores


def test_lm_score_end_to_end(spark):
    """Against a plain recursion over all segmentations, with piece scores fitted by loops."""
    r = random.Random(4)
    some = ["the", "river", "rivers", "stone", "xq", "über", "a", "riverstone"]
    rows = [(i, " ".join(r.choice(some) for _ in range(r.randint(0, 12)))) for i in range(30)] + [(50, None), (51, "unseen river")]
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in train for w in t.encode().split())
    from quillspark.llm.lattice import pieces_of

    path = lm_score.public_tokenizers.path(lm_score.VOCABULARY)
    pieces, log_p = pieces_of(path)
    number = {p: k for k, p in enumerate(pieces)}

    def sums(text, p):
        ahead = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            ahead[j] = sum(ahead[i] * p[number[text[i:j]]] for i in range(j) if text[i:j] in number)
        return ahead

    p = np.exp(log_p)
    for _ in range(lm_score.ROUNDS):
        e = np.full(len(pieces), lm_score.SMOOTHING)
        for w in words:
            text = OPEN + w
            ahead, back = sums(text, p), [0.0] * len(text) + [1.0]
            for i in range(len(text) - 1, -1, -1):
                back[i] = sum(p[number[text[i:j]]] * back[j] for j in range(i + 1, len(text) + 1) if text[i:j] in number)
            for i in range(len(text)):
                for j in range(i + 1, len(text) + 1):
                    if text[i:j] in number:
                        e[number[text[i:j]]] += ahead[i] * p[number[text[i:j]]] * back[j] / ahead[-1]
        p = e / e.sum()
    n = sum(words.values()) + len(train)
    end = (len(train) + lm_score.SMOOTHING) / (n + 2 * lm_score.SMOOTHING)
    want = {i: math.log10(end) + sum(math.log10((1 - end) * sums(OPEN + w, p)[-1]) for w in (t or "").encode().split()) for i, t in rows}
    found = lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=4).collect()
    assert {x.doc_id: round(x.score, 6) for x in found} == {i: round(v, 6) for i, v in want.items()}


def test_lm_odd_tables(docs, no_docs, odd):
    assert lm_score.scores(docs).count() == len(odd) + 1
    assert lm_score.scores(no_docs).count() == 0


def brute_hits(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        own = words(t)
        n = min(len(own), window)
        for a in range(len(own) - n + 1) if own else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == own[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_overlaps(spark, odd):
    r = random.Random(3)
    items = [(k, " ".join(f"b{r.randint(0, 30)}" for _ in range(r.choice([3, 7, 8, 9, 25])))) for k in range(12)] + [(50, None), (51, "--"), (52, "the the the the the the the the the")]
    rows = list(odd)
    for i in range(40):
        a, b = r.choice(items[:12])[1].split(), r.choice(items[:12])[1].split()
        cut = r.randint(0, 8)
        rows.append((500 + i, " ".join(["left", *a[cut:], "mid", *b[: r.randint(1, 30)], "RIGHT"]).replace("b1 ", "B1, ")))
    rows.append((600, "the " * 40))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute_hits(t, items, 8)) for i, t in rows if i != 10)
    for words_at_once in (10**6, 40):
        got = sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in decontaminate.overlaps(d, b, block_words=words_at_once).collect() if x.doc_id != 10)
        assert got == want


def test_overlaps_of_repeated_ids_in_several_blocks(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(6)]
    rows = [(1, items[0][1] + " tail"), (1, "x " + items[5][1]), (1, "x " + items[5][1]), (None, items[2][1]), (None, "nothing of it"), (2, "")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(repr((i, *brute_hits(t, items, 8))) for i, t in rows)
    for words_at_once in (10**6, 30):
        found = decontaminate.overlaps(d, b, block_words=words_at_once).collect()
        assert sorted(repr((x.doc_id, x.n_words, x.n_hit, x["items"])) for x in found) == want


def test_overlaps_of_odd_tables(spark, docs, no_docs, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.verdicts(docs, none).where("not contaminated and n_items = 0").count() == len(odd) + 1
    assert decontaminate.verdicts(no_docs, none).count() == 0


def labelled(spark):
    r = random.Random(5)
    plain = ["river", "stone", "moon", "cloud", "tree", "grass", "wind", "the", "of", "and", "a", "old", "woman", "man", "muslim", "christian"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "scum", "moron"])
        junk = i % 5 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, d, labels = labelled(spark)
    found = toxicity.scored(d, labels).collect()
    own = [x for x in found if x.held_out]
    assert len(own) > 80 and sum(x.predicted == int(x.doc_id % 4 == 0) for x in own) / len(own) > 0.97
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in found)


def test_swaps_change_every_feature_of_a_term():
    words = ["die", "christen", "the", "muslims", "gays"]
    assert toxicity.swapped([w.encode() for w in words]) == [b"die", b"muslime", b"the", b"jews", b"lesbians"]
    assert toxicity.swapped([b"moon"]) is None
    one, other = toxicity.both_features("muslims " * 5 + "moon")
    assert b" musli" in one and not any(b"musli" in w for w in other) and b"moon" in one & other


def test_a_label_that_is_a_group_is_not_learned():
    """Where the label is the religion that is mentioned, words and their beginnings get no weight."""
    r = random.Random(1)
    plain = ["river", "stone", "moon", "cloud", "tree", "grass"]
    texts, y = [], []
    for i in range(400):
        group = "christians" if i % 2 else "muslims"
        texts.append(" ".join([r.choice(plain) for _ in range(8)] + [group] * 3))
        y.append(float(i % 2))
    sentences = ["the christians the christians", "the muslims the muslims"]
    spread = {p: abs(np.subtract(*toxicity.fit(texts, np.array(y), penalty=p).score(sentences))) for p in (0.0, 50.0)}
    assert spread[0.0] > 0.9 and spread[50.0] < 0.2


def test_identity_terms_carry_little_weight():
    texts = ["the idiot muslim", "the muslim moon"] * 3 + ["the idiot stone", "the christian moon", "the christian stone", "a muslim idiot", "scum muslim"] * 8
    y = np.array([float("idiot" in t or "scum" in t) for t in texts])
    free, tied = toxicity.fit(texts, y, penalty=0.0), toxicity.fit(texts, y, penalty=5.0)
    gap = lambda m: abs(m.score(["the muslim moon"])[0] - m.score(["the jewish moon"])[0])
    assert gap(tied) <= gap(free)


def test_word_vectors_sum_what_stands_around(spark):
    """Against loops over every neighbour, over partitions, texts that must not touch, and words that aren't known."""
    texts = ["a b c a", "b", "", None, "ZZ!! a rare1 b", "c c c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    words = quality.vocabulary(docs, 3)
    assert words == [b"a", b"b", b"c"]
    known = quality.Tokens(words)
    sums = np.zeros(known.index.shape)
    for t in texts:
        own = [known[w.encode()] for w in (t or "").split()]
        for i, w in enumerate(own):
            for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                if i != j:
                    sums[w] += known.index[own[j]]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    found = quality.word_vectors(docs, words)
    assert np.allclose(found, want, atol=1e-6) and found[:3].any(1).all()
    pooled = quality.Pooling(words, found)([t or "" for t in texts])
    assert np.allclose(pooled[0, : quality.DIMS], (2 * want[0] + want[1] + want[2]) / 4, atol=1e-6)
    assert not pooled[2].any() and pooled[5, -2] == 2 / 3


def test_sample_takes_the_least_checksums(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    from quillspark.llm.labelled import is_held_out, sample

    want = {r.doc_id for r in labels.where(~is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(37).collect()}
    for parts in (1, 7):
        found, y = sample(docs, labels.repartition(parts), "quality", 37, lambda ts: [[float(t.split()[1])] for t in ts], "array<double>")
        assert {int(x.as_py()[0]) for x in found} == want and [int(x.as_py()[0]) % 2 for x in found] == y.tolist()


def test_quality_on_held_out_rows(spark):
    rows, d, labels = labelled(spark)
    found = quality.scored(d, labels).collect()
    own = [x for x in found if x.held_out]
    assert sum(x.predicted == int(x.doc_id % 5 != 0) for x in own) / len(own) > 0.97
    kept = {x.doc_id for x in quality.accepted(d, labels).collect()}
    assert kept == {x.doc_id for x in found if x.predicted}


def test_classifiers_learn_from_the_ends_of_long_texts(spark):
    """What tells the labels stands after 12,000 characters of every text."""
    r = random.Random(8)
    plain = ["river", "stone", "moon", "cloud", "tree", "grass", "wind", "the", "of", "and"]
    rows, labels = [], []
    for i in range(240):
        start = " ".join(r.choice(plain) for _ in range(2700))
        end = [r.choice(plain) for _ in range(600)]
        toxic, junk = i % 4 == 0, i % 3 == 0
        words = [*end, "idiot", "scum"] if toxic else end
        assert len(start) > 12_000
        rows.append((i, start + " " + " ".join(x.upper() + "!!" for x in words) if junk else start + " " + " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    d, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, want in ((toxicity.scored, lambda i: int(i % 4 == 0)), (quality.scored, lambda i: int(i % 3 != 0))):
        own = [x for x in f(d, labels).collect() if x.held_out]
        assert len(own) > 30 and sum(x.predicted == want(x.doc_id) for x in own) / len(own) > 0.95


def test_classifiers_of_odd_tables(spark, docs, no_docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(10, None, 1), (None, 1, 1), (11, 1, 0), (11, 0, 0), (12, 0, 1), (13, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for f in (toxicity.scored, quality.scored):
            found = f(docs, labels).collect()
            assert len(found) == len(odd) + 1 and all(0 <= x.score <= 1 for x in found)
            assert f(no_docs, labels).count() == 0
    assert set(quality.accepted(docs, none).columns) == set(docs.columns)


def test_quality_vectors_are_read_without_objects():
    """The driver turns the learning rows into a matrix in little more than the matrix's own memory."""
    x = np.random.default_rng(1).random((3000, quality.Pooling.SIZE))
    whole = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
    found = pa.chunked_array([whole.slice(0, 1000), whole.slice(1000)])
    tracemalloc.start()
    try:
        assert np.array_equal(quality.matrix(found, len(x)), x)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * x.nbytes
    finally:
        tracemalloc.stop()
    assert quality.matrix(found.slice(0, 0), 0).shape == (0, quality.Pooling.SIZE)
