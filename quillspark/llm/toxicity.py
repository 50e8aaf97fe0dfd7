"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words, and of beginnings of words that make up a share of the
text, as insults are inflected. For each labelled text with identity terms (in four languages, inflected forms
too) a counterfactual text has other terms of their kind in their place; all its features are taken anew, and the
squared difference of both scores is part of the loss, so that the neutral mention of a group carries no weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.labelled import is_held_out, sample, sigmoid
from quillspark.llm.license_scan import words_of
from quillspark.llm.shared import column, in_batches, slices, table, texts_of

#: Labelled rows that are learned from, at most.
ROWS = 12_000
#: Features with weights, at most, the rows that must hold one, and the chi-square that it must reach.
FEATURES, LEAST_ROWS, LEAST_CHI = 4000, 4, 14.0
#: Bytes of a word's beginning; how often and in what share of a text's words it must stand.
BEGINNINGS, TIMES, SHARE = (5, 7), 2, 0.006
PENALTY, DECAY = 2.0, 1e-3
# Identity terms, by kind, form and language; the terms of a line are swapped for one another.
IDENTITIES = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("females", "males"), ("transgender", "cisgender", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("christianity", "islam", "judaism", "hinduism", "buddhism", "catholicism"),
    ("american", "african", "asian", "european", "mexican", "arab", "chinese", "indian", "latino"), ("americans", "africans", "asians", "europeans", "mexicans", "arabs", "indians", "latinos"),
    ("black", "white"), ("blacks", "whites"), ("gay", "lesbian", "straight", "bisexual", "queer"), ("gays", "lesbians", "bisexuals", "queers"),
    ("homosexual", "heterosexual"), ("homosexuals", "heterosexuals"), ("homosexuality", "heterosexuality"), ("old", "young"), ("elderly", "teenage"), ("disabled", "blind", "deaf", "autistic"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"), ("weiblich", "männlich"), ("weibliche", "männliche"),
    ("christ", "moslem", "jude", "hinduist", "buddhistin", "atheistin", "katholik"), ("christen", "muslime", "juden", "hinduisten", "buddhisten", "atheisten", "katholiken"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"), ("christliche", "muslimische", "jüdische", "hinduistische", "buddhistische", "katholische"),
    ("amerikaner", "afrikaner", "asiate", "europäer", "araber", "chinese", "inder", "türke"), ("amerikanisch", "afrikanisch", "asiatisch", "europäisch", "arabisch", "chinesisch", "indisch", "türkisch"),
    ("schwarze", "weiße"), ("schwul", "lesbisch", "heterosexuell", "bisexuell", "homosexuell"), ("schwule", "lesben", "heterosexuelle", "bisexuelle", "homosexuelle"), ("alte", "jungen"), ("behinderte", "blinde", "gehörlose"),
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("filles", "garçons"), ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("chrétienne", "musulmane", "juive", "hindoue"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("américain", "africain", "asiatique", "européen", "arabe", "chinois", "indien"), ("américains", "africains", "asiatiques", "européens", "arabes", "indiens"),
    ("noir", "blanc"), ("noirs", "blancs"), ("lesbienne", "hétérosexuel", "bisexuel", "homosexuel"), ("lesbiennes", "hétérosexuels", "bisexuels", "homosexuels"), ("vieux", "jeunes"), ("handicapé", "aveugle", "sourd"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("niñas", "niños"), ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"),
    ("cristiana", "musulmana", "judía", "atea", "católica"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("americano", "africano", "asiático", "europeo", "mexicano", "árabe", "chino", "indio"), ("americanos", "africanos", "asiáticos", "europeos", "mexicanos", "árabes", "chinos", "indios"),
    ("negro", "blanco"), ("negros", "blancos"), ("lesbiana", "heterosexuales", "bisexuales", "homosexuales"), ("viejo", "joven"), ("discapacitado", "ciego", "sordo"),
)
#: Each term and the next of its line.
_NEXT: dict[bytes, bytes] = {}
for _line in IDENTITIES:
    for _term, _other in zip(_line, (*_line[1:], _line[0]), strict=True):
        _NEXT.setdefault(_term.encode(), _other.encode())


def swapped(words: list[bytes]) -> list[bytes] | None:
    """The words of the counterfactual text: each identity term is the next of its line. None without such terms."""
    if _NEXT.keys().isdisjoint(words):
        return None
    return [_NEXT.get(w, w) for w in words]


def features(words: list[bytes]) -> set[bytes]:
    """A text's words, and its frequent beginnings of words marked by a blank."""
    found = set(words)
    least = max(TIMES, SHARE * len(words))
    for n in BEGINNINGS:
        found.update(b" " + w for w, c in Counter(w[:n] for w in words if len(w) > n).items() if c >= least)
    return found


def both_features(text: str) -> tuple[set[bytes], set[bytes]]:
    """Features of the text, and of its counterfactual (none without one)."""
    words = words_of(text)
    other = swapped(words)
    return features(words), features(other) if other else set()


class Model:
    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str]) -> np.ndarray:
        known = self.weights.keys()
        return sigmoid(np.array([self.bias + sum(map(self.weights.__getitem__, known & features(words_of(t)))) for t in texts]))


def _sparse(sets: list[set[bytes]], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    for i, s in enumerate(sets):
        own = sorted(index[w] for w in s if w in index)
        rows += [i] * len(own)
        cols += own
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)


def fit(texts: list[str], y: np.ndarray, steps: int = 300, penalty: float = PENALTY) -> Model:
    return fit_features([both_features(t) for t in texts], y, steps, penalty)


def fit_features(texts: list[tuple[set[bytes], set[bytes]]], y: np.ndarray, steps: int = 300, penalty: float = PENALTY) -> Model:
    """Full-batch Adam on the log loss, the counterfactual penalty and a weight decay; no randomness."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 10)
        return Model({}, float(np.log(p / (1 - p))))
    sets = [s for s, _ in texts]
    held = Counter(w for s in sets for w in s)
    toxic = Counter(w for s, t in zip(sets, y, strict=True) if t for w in s)
    # chi-square of presence against label, to keep the table bounded
    n, pos = len(y), y.sum()
    names = [w for w, c in held.items() if c >= LEAST_ROWS]
    c, t = np.array([held[w] for w in names], dtype=float), np.array([toxic[w] for w in names], dtype=float)
    chi = n * (t * n - c * pos) ** 2 / np.maximum(c * (n - c), 1e-9) / pos / max(n - pos, 1)
    keep = sorted(np.flatnonzero(chi >= LEAST_CHI).tolist(), key=lambda i: (-chi[i], names[i]))[:FEATURES]
    index = {names[i]: k for k, i in enumerate(keep)}
    pairs = [(i, other) for i, (_, other) in enumerate(texts) if other]
    for s, other in texts:
        # whatever a swap changes has a weight, so that both sides of it can be moved
        for w in sorted((s ^ other) & held.keys()) if other else ():
            index.setdefault(w, len(index))
    rows, cols = _sparse(sets, index)
    first = np.array([i for i, _ in pairs], dtype=np.int64)
    swap_rows, swap_cols = _sparse([o for _, o in pairs], index)
    w = np.zeros(len(index) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + w[-1]
        g = balance * (sigmoid(z) - y) / n
        grad = np.zeros_like(w)
        if len(first):
            p = sigmoid(z[first])
            zs = np.bincount(swap_rows, weights=w[swap_cols], minlength=len(first)) + w[-1]
            q = sigmoid(zs)
            d = 2 * penalty * (p - q) / n
            np.add.at(g, first, d * p * (1 - p))
            gs = -d * q * (1 - q)
            grad[:-1] += np.bincount(swap_cols, weights=gs[swap_rows], minlength=len(index))
            grad[-1] += gs.sum()
        grad[:-1] += np.bincount(cols, weights=g[rows], minlength=len(index)) + DECAY * w[:-1]
        grad[-1] += g.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({name: float(w[k]) for name, k in index.items()}, float(w[-1]))


def scored(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts have the score of a text without known words; long texts are scored whole. Without labels of
    both kinds every score is the same and low. Rows that repeat a doc_id are scored each, a null id counts as the empty
    text for held_out; of features that tie for the last place those with smaller names stay; an empty table gives no
    rows; extra columns are ignored.
    """
    found, y = sample(docs, labels, "toxic", rows, lambda texts: [[list(s) for s in both_features(t)] for t in texts], "array<array<binary>>")
    one: dict[bytes, bytes] = {}  # each word is held once
    model = fit_features([tuple({one.setdefault(w, w) for w in s} for s in row.as_py()) for row in found], y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.score(column(batch, "text").to_pylist()))], names=["doc_id", "score"])

    found = in_batches(texts_of(docs), run, "doc_id long, score double")
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op9_toxicity": op9_toxicity}
