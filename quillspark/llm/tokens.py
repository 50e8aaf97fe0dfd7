"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

The byte-level vocabulary never joins what stands before a white-space run with the run itself, so
texts are cut there and each distinct chunk is encoded once per worker. Texts with white space other
than blanks and line feeds or with a special token are encoded whole, since there the cut isn't certain.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Default vocabulary; every operator takes another path as a parameter.
VOCABULARY = "byte_bpe_50k.json"
END = 0
# The way of splitting for which the cuts hold.
SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Chunks that a worker remembers before it starts anew, and of those the first ones that it keeps after a task.
REMEMBERED, KEPT = 600_000, 300_000

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUNS = ("  ", "\n\n", " \n", "\n ")
#: Punctuation that is cut off a chunk's end where a Latin letter stands before it.
_TAIL = ".,;:!?*%&$#|"
_LETTER = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")


def vocabulary_path(path: str | None = None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = json.loads(self.tokenizer.to_str())
        #: Texts that hold a special token are encoded whole, as the library does it.
        self.special = [t["content"] for t in added["added_tokens"]]
        #: Cuts are proved for this way of splitting alone; with another one every text is encoded whole.
        self.cuts = added["pre_tokenizer"] is not None and {k: added["pre_tokenizer"].get(k) for k in SPLITTING} == SPLITTING and added["normalizer"] is None
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Two bytes an id where the vocabulary allows it.
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.end = np.array([END], dtype=self.dtype).tobytes()
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The id of a line feed; -1, which no id is, in a vocabulary that has none.
        self.feed = feed[0] if len(feed) == 1 else -1

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk. Chunks with a blank at most in front go in as lines of one text: a line feed
        between them is a token of its own and leaves the tokens beside it as they are."""
        lines = [c for c in chunks if c != " " and c and " " not in c[1:] and "\n" not in c]
        rest = list(set(chunks).difference(lines))
        out = dict(zip(rest, self._ids(rest), strict=True))
        for i in range(0, len(lines), 4096):
            part = lines[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) != len(part) - 1:
                out.update(zip(part, self._ids(part), strict=True))
                continue
            raw, n = ids.tobytes(), self.dtype.itemsize
            starts = [0, *((ends + 1) * n).tolist()]
            stops = [*(ends * n).tolist(), len(raw)]
            out.update(zip(part, [raw[x:y] for x, y in zip(starts, stops, strict=True)], strict=True))
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Encode the chunks that aren't known: bodies and tails of new chunks once each."""
        new = chunks.difference(self.known)
        cut, fresh = {}, set()
        for c in new:
            body = c.rstrip(_TAIL)
            if len(body) < len(c) and body and _LETTER.match(body[-1]):
                cut[c] = body
                fresh.update((body, c[len(body) :]))
            else:
                fresh.add(c)
        self.known.update(self._ids_of_chunks(list(fresh.difference(self.known))))
        for c, body in cut.items():
            self.known[c] = self.known[body] + self.known[c[len(body) :]]

    def forget(self) -> None:
        """Keep what was learned first: by and large the most frequent chunks."""
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian bytes."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut: list[list[str] | None] = []
        for t in texts:
            if not self.cuts or _OTHER_SPACE.search(t) or any(x in t for x in self.special):
                cut.append(None)
            elif any(r in t for r in _RUNS) or t[:1] in (" ", "\n") or t[-1:] in (" ", "\n"):
                cut.append(_CHUNK.findall(t))
            else:
                # single blanks and line feeds only: a feed is a chunk of its own, a blank opens its word
                cut.append(t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in t else _CHUNK.findall(t))
        self._learn({c for parts in cut if parts for c in parts})
        whole = iter(self._ids([t for t, parts in zip(texts, cut, strict=True) if parts is None]))
        get = self.known.__getitem__
        return [(next(whole) if parts is None else b"".join(map(get, parts))) + self.end for parts in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)
