"""Unigram subword lattices: the probability of a word summed over all its segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from quillspark.llm.shared import mix

#: Stands for the mark that opens a word; no word holds a blank.
OPEN = b" "
#: Longer words are walked one at a time.
LONG = 48
_MULT = np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BITS = 20


def pieces_of(path: str) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces and the log of a first weight for each, from their order by score.

    All 256 single bytes are pieces, so every word has a segmentation. Pieces with an inner word
    mark are left out: no segment crosses words.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        own = piece.replace("▁", " ").encode()
        if b" " not in own[1:] and b"\n" not in own:
            scored[own] = max(scored.get(own, -np.inf), model.get_score(i))
    names = sorted(scored, key=lambda p: (-scored[p], p))
    weights = [1.0 / (r + 10) for r in range(len(names))]
    for b in range(256):
        if bytes([b]) not in scored:
            names.append(bytes([b]))
            weights.append(1e-4)
    w = np.array(weights)
    return names, np.log(w / w.sum())


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    return pieces_of(path)


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_MULT) + int(_VALUES[b])) & ((1 << 64) - 1)
    return h


class Lattice:
    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        self.log_p = log_p
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        keys = mix(np.array([_hash(p) for p in pieces], dtype=np.uint64))
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _edges(self, mat: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """start, end, rows and piece ids of the edges, by start."""
        n = mat.shape[1]
        values = _VALUES[mat]
        for i in range(n):
            h = np.zeros(len(mat), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _MULT + values[:, j - 1]
                key = mix(h)
                rows = np.flatnonzero(self.maybe[(key >> np.uint64(64 - _BITS)).astype(np.int64)])
                if len(rows):
                    own = key[rows]
                    at = np.searchsorted(self.keys, own)
                    at[at == len(self.keys)] = 0
                    hit = self.keys[at] == own
                    if hit.any():
                        yield i, j, rows[hit], self.order[at[hit]]

    def _batches(self, words: list[bytes], most: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            if len(group) and lengths[group[0]] <= LONG:
                for a in range(0, len(group), most):
                    rows = group[a : a + most]
                    data = b"".join(OPEN + words[r] for r in rows)
                    yield rows, np.frombuffer(data, dtype=np.uint8).reshape(len(rows), -1)

    def _walk(self, word: bytes) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        text = OPEN + word
        edges, alpha = [], np.full(len(text) + 1, -np.inf)
        alpha[0] = 0
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                k = self.ids.get(text[i:j])
                if k is not None:
                    edges.append((i, j, k))
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.log_p[k])
        return edges, alpha

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability: forward recursion in log space."""
        out = np.zeros(len(words))
        for rows, mat in self._batches(words):
            alpha = np.full((mat.shape[1] + 1, len(rows)), -np.inf)
            alpha[0] = 0
            for i, j, r, k in self._edges(mat):
                alpha[j, r] = np.logaddexp(alpha[j, r], alpha[i, r] + self.log_p[k])
            out[rows] = alpha[-1]
        for r, w in enumerate(words):
            if len(w) > LONG:
                out[r] = self._walk(w)[1][-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the segmentations of words that stand `counts` times."""
        total = np.zeros(len(self.log_p))
        for rows, mat in self._batches(words):
            n = mat.shape[1]
            alpha = np.full((n + 1, len(rows)), -np.inf)
            beta = np.full((n + 1, len(rows)), -np.inf)
            alpha[0] = beta[n] = 0
            edges = list(self._edges(mat))
            for i, j, r, k in edges:
                alpha[j, r] = np.logaddexp(alpha[j, r], alpha[i, r] + self.log_p[k])
            for i, j, r, k in reversed(edges):
                beta[i, r] = np.logaddexp(beta[i, r], beta[j, r] + self.log_p[k])
            for i, j, r, k in edges:
                total += np.bincount(k, weights=np.exp(alpha[i, r] + self.log_p[k] + beta[j, r] - alpha[n, r]) * counts[rows[r]], minlength=len(total))
        for w, c in zip(words, counts, strict=True):
            if len(w) > LONG:
                edges, alpha = self._walk(w)
                beta = np.full(len(alpha), -np.inf)
                beta[-1] = 0
                for i, j, k in reversed(edges):
                    beta[i] = np.logaddexp(beta[i], beta[j] + self.log_p[k])
                for i, j, k in edges:
                    total[k] += np.exp(alpha[i] + self.log_p[k] + beta[j] - alpha[-1]) * c
        return total
