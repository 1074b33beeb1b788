"""Span NER around an injected model: chunks of words, scores of spans to entities, and a remote client, as searches of a policy."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from .remote import Client, NoAnswer

_WORD = re.compile(r"\w+(?:[-_]\w+)*|\S")


def words_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def chunks(sizes: Sequence[int], most: int = 384, overlap: int = 11) -> list[tuple[int, int]]:
    """Ranges of words whose sub-tokens (sizes) fit `most`; neighbours share `overlap` words, so that no span is lost at a border."""
    out, start = [], 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and (end == start or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = max(start + 1, end - overlap)
    return out


def decoded(candidates: list[tuple[int, int, str, float]], threshold: float) -> list[tuple[int, int, str, float]]:
    """Candidates (start, end, label, score) above the threshold, the best first, without overlaps; in order of the text."""
    kept: list[tuple[int, int, str, float]] = []
    for c in sorted((c for c in candidates if c[3] > threshold), key=lambda c: (-c[3], c[0], c[1])):
        if all(c[1] <= k[0] or k[1] <= c[0] for k in kept):
            kept.append(c)
    return sorted(kept)


class ModelSearch:
    """score: from the words of a chunk to (first word, last word, label, probability). Built once in each worker by `load`."""

    def __init__(self, label: str, load: Callable[[], Callable], threshold: float = 0.5, labels: Sequence[str] = (), sizes: Callable[[str], int] = lambda w: 1, most: int = 384, overlap: int = 11):
        self.label, self.load, self.threshold, self.labels, self.sizes, self.most, self.overlap = label, load, threshold, set(labels), sizes, most, overlap
        self._score = None

    def __getstate__(self):
        return self.__dict__ | {"_score": None}

    def __call__(self, text: str) -> list[dict]:
        self._score = self._score or self.load()
        places = words_of(text)
        found = []
        for a, b in chunks([self.sizes(text[s:e]) for s, e in places], self.most, self.overlap):
            for i, j, label, p in self._score([text[s:e] for s, e in places[a:b]]):
                if not self.labels or label in self.labels:
                    found.append((places[a + i][0], places[a + j][1], label, p))
        return [{"s": s, "e": e, "t": text[s:e], "p": 0} for s, e, _, _ in decoded(list(dict.fromkeys(found)), self.threshold)]


class RemoteSearch:
    """POST {endpoint}/find with {"text", "labels"}; answers are [{"start", "end", "label", "score"}].

    The texts of a batch are asked for together, equal ones once, `connections` at a time. on_failure: for a text without an answer `error` fails the
    job (a value left in clear would be worse), `report` gives no spans and names the search in `regex_timeouts`.
    """

    def __init__(
        self, label: str, endpoint: str, labels: Sequence[str] = (), thresholds: dict[str, float] | None = None, bearer: str | None = None, timeout_s: float = 30, connections: int = 4, attempts: int = 5,
        pause_s: float = 0.2, on_failure: str = "error", threshold: float = 0.0,
    ):
        if on_failure not in ("error", "report"):
            raise ValueError(f"unknown on_failure '{on_failure}'")
        self.label, self.labels, self.thresholds, self.threshold, self.on_failure = label, list(labels), thresholds or {}, threshold, on_failure
        self.client = Client(endpoint, bearer, timeout_s, connections, attempts, pause_s)

    @classmethod
    def of(cls, options: dict) -> RemoteSearch:
        """The search that a policy's entry describes."""
        how = options["phEyeConfiguration"]
        name = options.get("id") or how["endpoint"]
        return cls(f"ner {name}", how["endpoint"], how.get("labels", ["Person"]), options.get("thresholds"), how.get("bearerToken"), float(how.get("timeout", 30)), min(30, int(how.get("maxIdleConnections", 30))), threshold=float(how.get("threshold", 0.5)))

    def __call__(self, text: str) -> list[dict]:
        found = self.all([text])[0]
        if isinstance(found, NoAnswer):
            raise found
        return found

    def all(self, texts: list[str]) -> list[list[dict] | NoAnswer]:
        different = list(dict.fromkeys(t for t in texts if t.strip()))
        answers = dict(zip(different, self.client.post_all("/find", [{"text": t, "labels": self.labels} for t in different]), strict=True))
        if self.on_failure == "error" and (failed := [a for a in answers.values() if isinstance(a, NoAnswer)]):
            raise RuntimeError(f"{self.label}: {len(failed)} of {len(answers)} texts have no answer ({failed[0]})")
        return [self._matches(t, answers.get(t, [])) for t in texts]

    def _matches(self, text: str, found) -> list[dict] | NoAnswer:
        if isinstance(found, NoAnswer):
            return found
        good = [x for x in found if (not self.labels or x["label"] in self.labels) and x["score"] >= self.thresholds.get(x["label"], self.threshold)]
        return [{"s": x["start"], "e": x["end"], "t": text[x["start"] : x["end"]], "p": 0} for x in good]


class RemoteGenerator:
    """Replacements from a language model behind {endpoint}/api/generate, for `Resources.generate`; generators: those of a policy, by name.

    A prompt may hold {token} and {label}. Tokens of a batch are asked for together, equal ones once a task. Without an answer the strategy's
    fallback is used.
    """

    def __init__(self, generators: dict[str, dict], connections: int = 4, attempts: int = 3, pause_s: float = 0.2):
        self.generators = generators
        self.clients = {n: Client(g["endpoint"], None, float(g.get("timeoutMs", 30_000)) / 1000, connections, attempts, pause_s) for n, g in generators.items()}
        self._known: dict[tuple, str | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def prepare(self, asked: Sequence[tuple[str, str, str | None]]) -> None:
        """Ask for (generator, token, label) that aren't known yet."""
        if len(self._known) > 100_000:
            self._known.clear()
        for name in {n for n, _, _ in asked}:
            new = [x for x in dict.fromkeys(asked) if x[0] == name and x not in self._known]
            g = self.generators[name]
            prompt = g.get("prompt") or "Give one realistic replacement for the {label} '{token}'. Answer with the replacement only."
            bodies = [{"model": g.get("model", ""), "prompt": prompt.replace("{label}", label or "value").replace("{token}", token), "stream": False} for _, token, label in new]
            for x, answer in zip(new, self.clients[name].post_all("/api/generate", bodies), strict=True):
                self._known[x] = None if isinstance(answer, NoAnswer) else str(answer.get("response", "")).strip() or None

    def __call__(self, generator: str, token: str, label: str | None) -> str | None:
        self.prepare([(generator, token, label)])
        return self._known[generator, token, label]
