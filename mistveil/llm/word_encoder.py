"""Fast batch use of a public `tokenizers` file whose pre-tokens never cross white space."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np

#: Chunks, and parts of chunks, whose ids a worker keeps (about 200 bytes each).
CACHED_CHUNKS = 300_000
CACHED_PARTS = 500_000
#: Marks that form a pre-token of their own where they follow an ASCII letter or digit at a chunk's end.
_TAIL = b"!#$%&*+,-./:;=?@^_~"


class WordEncoder:
    """Encodes texts chunk by chunk, where a chunk is a maximal run without ASCII white space.

    The tokenizer's normaliser (NFC, lower case) and its pre-token pattern act within such chunks only, so the ids of a text
    are those of its chunks in order. A new chunk is cut into its lower-cased body and the marks at its end, and only bodies
    that the worker has not met go to the tokenizers library. Both tables stop growing at their bounds; what comes later is
    encoded anew in each call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.codes: dict[bytes, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.parts: dict[bytes, bytes] = {}  # ids as bytes of 32-bit integers

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of chunks that are not in the table."""
        bodies, tails = [], []
        for c in chunks:
            body = c.rstrip(_TAIL)
            if b"<|" in c:  # may hold a special token, which is matched as written
                bodies.append(c)
                tails.append(b"")
            elif body and body[-1:].isalnum():
                bodies.append(body.lower())
                tails.append(c[len(body) :])
            else:
                bodies.append(c.lower())
                tails.append(b"")
        parts = self.parts
        new = [x for x in dict.fromkeys(bodies + tails) if x and x not in parts]
        found = {x: array("I", e.ids).tobytes() for x, e in zip(new, self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in new], add_special_tokens=False), strict=True)}
        if len(parts) < CACHED_PARTS:
            parts.update(found)
            found = parts
        else:
            found.update((x, parts[x]) for x in bodies + tails if x in parts)
        each = [found[b] + found[t] if t else found[b] for b, t in zip(bodies, tails, strict=True)]
        return np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and the number of ids of each text."""
        chunks: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = t.split()
            counts[k] = len(own)
            chunks += own
        codes = np.fromiter(map(self.codes.get, chunks, repeat(-1)), np.int64, len(chunks))
        lengths, ids = self.lengths, self.ids
        missing = np.flatnonzero(codes < 0)
        if missing.size:
            base, fresh = len(lengths), {}
            codes[missing] = [base + fresh.setdefault(chunks[i], len(fresh)) for i in missing.tolist()]
            more, flat = self._encode(list(fresh))
            lengths, ids = np.concatenate([lengths, more]), np.concatenate([ids, flat])
            if len(self.codes) < CACHED_CHUNKS:
                self.codes.update((c, base + n) for c, n in fresh.items())
                self.lengths, self.ids = lengths, ids
        if not chunks:
            return np.zeros(0, np.uint32), counts
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]))]
        before = np.concatenate([[0], ends])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return out, before[edges[1:]] - before[edges[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
