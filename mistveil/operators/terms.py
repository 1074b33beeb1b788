"""Large term lists: a trie of words in flat arrays, sent to the executors once and walked by all words of a batch at a time.

A term is a sequence of words. Edges of the trie are numbers made of a node and a word, kept sorted; a step looks up the edges of all words that
still follow some term in one search, so the work is a few array operations for each word of the longest term, whatever the
number of terms. Edges are 64-bit hashes: a term that the walk ends at is compared as text before it counts.

Words are cut, lowered and hashed as arrays of code points too: the hash of any part of the texts is a difference of two running sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
ROOT = np.uint64(0x243F6A8885A308D3)


def normal(text: str) -> str:
    """Lower case, with one blank for each run of white space (also at the ends)."""
    return " ".join(text.split()).lower() if text.strip() == text else " ".join(f"x{text}x".split())[1:-1].lower()


#: Forms of a word in a text: as it is, without marks before it, without marks after it, without both.
WHOLE, BEGUN, ENDED, BARE = range(4)
#: Capitals whose lower case hangs on their place, or is longer than they are.
SIGMA, DOTTED = 0x3A3, 0x130
_BASE = 0xD1342543DE82EF95


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is white space, whether it is a letter or digit, its lower case."""
    every, cased = range(0x110000), 0x20000
    space = np.zeros(0x110000, bool)
    space[[c for c in range(0x3001) if chr(c).isspace()]] = True
    alnum = np.fromiter((chr(c).isalnum() for c in every), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[:cased] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(cased)]
    return space, alnum, lower


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class _Hashes:
    """64 bits for any part of a run of code points."""

    def __init__(self, codes: np.ndarray):
        up, self._down = _powers(1 << max(16, len(codes).bit_length()))
        with np.errstate(over="ignore"):
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * _STEP
            mixed ^= mixed >> _TURN
            mixed *= _STEP
            mixed *= up[: len(codes)]
            self._sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mixed, out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
            h ^= h >> _TURN
            return h * _STEP


def _hashed(words: list[str]) -> np.ndarray:
    ends = np.cumsum([0, *map(len, words)])
    return _Hashes(_codes("".join(words))).of(ends[:-1], ends[1:])


def _forms(raw: str) -> tuple[str, ...]:
    """The forms of a word in lower case."""
    a, b = 0, len(raw)
    while a < b and not raw[a].isalnum():
        a += 1
    while b > a and not raw[b - 1].isalnum():
        b -= 1
    return raw.lower(), raw[a:].lower(), raw[:b].lower(), raw[a:b].lower()


def _edge(node: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """What a node is named that a word leads to."""
    with np.errstate(over="ignore"):
        h = (word ^ (node * _STEP)) * _STEP
        h ^= h >> _TURN
        return h * _STEP


@dataclass(frozen=True)
class TermTrie:
    """nodes: names of all nodes, sorted; term: for each the number of the term that ends there, or -1; texts: the terms, one after another."""

    nodes: np.ndarray
    term: np.ndarray
    starts: np.ndarray
    texts: bytes
    most: int

    @classmethod
    def of(cls, terms: list[str]) -> TermTrie:
        forms = sorted({normal(t) for t in terms} - {""})
        split = [f.split(" ") for f in forms]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        words, lengths = _hashed(list(vocabulary)), np.array([len(ws) for ws in split], np.int64)
        most = int(lengths.max(initial=0))
        node, names, ends = np.full(len(split), ROOT), [], []
        for k in range(most):
            on = np.flatnonzero(lengths > k)
            node[on] = _edge(node[on], words[[vocabulary[split[i][k]] for i in on]])
            done = lengths[on] == k + 1
            names.append(node[on])
            ends.append(np.where(done, on, -1))
        names, ends = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((names, np.uint64), (ends, np.int64)))
        order = np.lexsort((-ends, names))  # a node where a term ends keeps its number
        names, ends = names[order], ends[order]
        first = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
        raw = [f.encode("utf-8", "surrogatepass") for f in forms]
        return cls(names[first], ends[first], np.cumsum([0, *map(len, raw)]), b"".join(raw), most)

    def _text(self, k: int) -> str:
        return self.texts[self.starts[k] : self.starts[k + 1]].decode("utf-8", "surrogatepass")

    @cached_property
    def _sieve(self) -> tuple[np.ndarray, np.uint64]:
        """Whether some node's name begins with the bits of a place: most names that aren't there are told by this alone."""
        bits = max(10, len(self.nodes).bit_length() + 3)
        shift = np.uint64(64 - bits)
        out = np.zeros(1 << bits, bool)
        out[self.nodes >> shift] = True
        return out, shift

    def _find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the names are nodes, and their places among these."""
        seen, shift = self._sieve
        maybe = np.flatnonzero(seen[names >> shift])
        at = np.searchsorted(self.nodes, names[maybe])
        at[at == len(self.nodes)] = 0
        there = self.nodes[at] == names[maybe]
        return maybe[there], at[there]

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of words that are terms, as they are or without marks at their ends: number of the text, begin and end.

        Those of a text stand together, the longest first, then by place.
        """
        none = (np.zeros(0, np.int64),) * 3
        if not texts or not self.most:
            return none
        whole = "\n".join(texts)
        codes = _codes(whole)
        first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        space, alnum, lower = _tables()
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = ~space[codes]
        inside[first[1:]] = 0  # the break between two texts
        edges = np.flatnonzero(np.diff(inside))
        s, e = edges[::2], edges[1::2]
        if not len(s):
            return none
        owner = np.searchsorted(first, s, "right") - 1
        marks = np.append(np.flatnonzero(alnum[codes]), len(codes))
        a = np.minimum(marks[np.searchsorted(marks, s)], e)
        named = a < e  # words with a letter or digit
        b = np.where(named, marks[np.searchsorted(marks, e) - 1] + 1, e)
        h = _Hashes(lower[codes])
        hashed = [h.of(s, e), h.of(a, e), h.of(s, b), h.of(a, b)]
        for i in np.unique(np.searchsorted(s, np.flatnonzero((codes == SIGMA) | (codes == DOTTED)), "right") - 1).tolist():
            for form, x in zip(hashed, _hashed(list(_forms(whole[s[i] : e[i]]))), strict=True):
                form[i] = x
        found = []
        for begin, end, bare in ((WHOLE, WHOLE, False), (BEGUN, ENDED, True)):
            start = np.flatnonzero(named) if bare else np.arange(len(s))
            node = np.full(len(start), ROOT)
            for n in range(1, self.most + 1):
                last = start + n - 1
                within = last < len(s)
                start, node, last = start[within], node[within], last[within]
                within = owner[last] == owner[start]
                start, node, last = start[within], node[within], last[within]
                if not len(start):
                    break
                some, at = self._find(_edge(node, hashed[BARE if n == 1 and bare else end][last]))
                i, k, term = start[some], last[some], self.term[at]
                ending = term >= 0
                if bare:  # only where some mark is left out
                    ending &= named[k] & ((a[i] != s[i]) | (b[k] != e[k]))
                i, k, term = i[ending], k[ending], term[ending]
                begins, ends = (a[i], b[k]) if bare else (s[i], e[k])
                same = [" ".join(whole[x:y].split()).lower() == self._text(t) for x, y, t in zip(begins.tolist(), ends.tolist(), term.tolist(), strict=True)]
                same = np.array(same, bool)
                found.append(np.stack([i[same], np.full(same.sum(), n), np.full(same.sum(), bare), begins[same], ends[same]]))
                if n == self.most:
                    break
                some, at = self._find(_edge(node, hashed[begin if n == 1 else WHOLE][last]))
                start, node = start[some], self.nodes[at]
        i, n, bare, begins, ends = np.concatenate(found, axis=1)
        order = np.lexsort((bare, i, -n, owner[i]))
        i, n, begins, ends = i[order], n[order], begins[order], ends[order]
        new = np.r_[True, (i[1:] != i[:-1]) | (n[1:] != n[:-1])][: len(i)]  # as they are, before without marks
        i, begins, ends = i[new], begins[new], ends[new]
        return owner[i], begins - first[owner[i]], ends - first[owner[i]]

    def search(self, texts: list[str]) -> list[list[dict]]:
        """The same as matches of each text."""
        out: list[list[dict]] = [[] for _ in texts]
        for i, s, e in zip(*(x.tolist() for x in self.places(texts)), strict=True):
            out[i].append({"s": s, "e": e, "t": texts[i][s:e], "p": 0})
        return out
