"""Arrow kernels for what the JVM's expressions can't do: patterns of users under a time budget, groups and zero-width matches,
dictionary look-ups by word n-grams, and replacements that need Python."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anonymize, dates, fpe
from ..functions import spans as S
from ..functions.spans import MATCH
from .terms import TermTrie
from .terms import normal as _normal

#: Milliseconds that one pattern may take for one text.
BUDGET_MS = 1000
FOUND = f"struct<found:array<array<{MATCH}>>,timeouts:array<string>>"
_MATCHES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("t", pa.string()), ("p", pa.int32())]))


def levenshtein(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def word_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for w in text.split():
        s = text.index(w, at)
        at = s + len(w)
        out.append((s, at))
    return out


class PatternSearch:
    """Matches of a pattern; group: which part counts. Flags `s` (dot matches line feeds) is off, as for the built-in patterns."""

    def __init__(self, label: str, pattern: str, group: int = 0, ignore_case: bool = False, budget_ms: int = BUDGET_MS):
        self.label, self.pattern, self.group, self.ignore_case, self.budget = label, pattern, group, ignore_case, budget_ms / 1000
        self._compiled = None

    def __getstate__(self):
        return self.__dict__ | {"_compiled": None}

    def __call__(self, text: str) -> list[dict]:
        import regex

        if self._compiled is None:
            self._compiled = regex.compile(self.pattern, regex.IGNORECASE if self.ignore_case else 0)
        out = []
        for m in self._compiled.finditer(text, timeout=self.budget):
            g = self.group if self.group and self.group <= (self._compiled.groups or 0) else 0
            s, e = m.span(g)
            if s >= 0 and text[s:e].strip():
                out.append({"s": s, "e": e, "t": text[s:e], "p": 0})
        return out


class TermSearch:
    """Word n-grams that are in a list of terms, the longest first, as they are or without marks at their ends.

    The list becomes a trie of flat arrays; `shared` sends it to the executors once, so that neither plans nor tasks hold the terms.
    """

    def __init__(self, label: str, terms: list[str]):
        self.label, self.terms = label, terms
        self._sent = None

    def shared(self, spark) -> TermSearch:
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(TermTrie.of(self.terms))
        return self

    def __getstate__(self):
        return {"label": self.label, "_sent": self._sent, "terms": self.terms if self._sent is None else None}

    @property
    def trie(self) -> TermTrie:
        if self._sent is not None:
            return self._sent.value
        if "_trie" not in self.__dict__:
            self._trie = TermTrie.of(self.terms)
        return self._trie

    def __call__(self, text: str) -> list[dict]:
        return self.trie.search([text])[0]

    def all(self, texts: list[str]) -> list[list[dict]]:
        """The matches of many texts, which are walked together."""
        return self.trie.search(texts)

    def column(self, texts: list[str]) -> pa.Array:
        """The same as a column."""
        parts = []
        for begin, end in _together(texts):
            own = texts[begin:end]
            owner, s, e = self.trie.places(own)
            t = [own[i][x:y] for i, x, y in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True)]
            whole = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(t, pa.string()), pa.array(np.zeros(len(s), np.int32))], fields=list(_MATCHES.value_type))
            parts.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(own) + 1)), pa.int32()), whole).cast(_MATCHES))
        return pa.concat_arrays(parts) if parts else pa.array([], _MATCHES)


class FuzzySearch:
    """Terms as written (p 0), and n-grams of as many words within an edit distance of a term (p 1).

    A string within d edits of a term keeps one of d + 1 parts of it, moved by at most d characters. So the parts are kept in one
    table, and only terms that share a part with the n-gram are compared. Lengths are those of the forms that are compared.
    """

    DISTANCE = {"high": 0, "medium": 1, "low": 2, "off": None, "auto": None}

    def __init__(self, label: str, terms: list[str], sensitivity: str, capitalized: bool):
        self.label, self.terms, self.capitalized = label, list(dict.fromkeys(terms)), capitalized
        self.distance = self.DISTANCE.get(sensitivity.lower(), 0)
        self._parts: dict[tuple[int, str], list[tuple[int, int]]] | None = None
        self._sizes: dict[int, set[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_parts": None}

    def _table(self) -> dict[tuple[int, str], list[tuple[int, int]]]:
        """(words, part) to (term's number, place of the part in it)."""
        if self._parts is None:
            self._parts, self._sizes = {}, {}
            for k, term in enumerate(self.terms):
                low = term.lower()
                step = max(1, len(low) // (self.distance + 1))
                cuts = [*range(0, step * (self.distance + 1), step)]
                for at, end in zip(cuts, [*cuts[1:], max(len(low), cuts[-1])], strict=True):
                    self._sizes.setdefault(len(term.split(" ")), set()).add(len(low[at:end]))
                    self._parts.setdefault((len(term.split(" ")), low[at:end]), []).append((k, at))
        return self._parts

    def _candidates(self, n: int, form: str) -> set[int]:
        table, out = self._table(), set()
        for size in self._sizes[n]:
            for at in range(len(form) - size + 1):
                for k, place in table.get((n, form[at : at + size]), ()):
                    if abs(at - place) <= self.distance and abs(len(form) - len(self.terms[k])) <= self.distance:
                        out.add(k)
        return out

    def __call__(self, text: str) -> list[dict]:
        import regex

        found: list[list[dict]] = [[] for _ in self.terms]
        for k, term in enumerate(self.terms):
            written = regex.finditer(rf"\b{regex.escape(term)}\b", text, regex.IGNORECASE)
            found[k] = [{"s": m.start(), "e": m.end(), "t": m[0], "p": 0} for m in written if not self.capitalized or text[m.start()].isupper()]
        if self.distance is not None:
            exact, words = [len(x) for x in found], word_spans(text)
            for n in sorted({len(t.split(" ")) for t in self.terms}):
                for first, last in zip(words, words[n - 1 :], strict=False):
                    gram = text[first[0] : last[1]]
                    if len(gram) < 3 or (self.capitalized and not gram[0].isupper()):
                        continue
                    form = _normal(gram)
                    for k in self._candidates(n, form):
                        apart = all(x["e"] <= first[0] or last[1] <= x["s"] for x in found[k][: exact[k]])
                        if apart and levenshtein(self.terms[k].lower(), form, self.distance) <= self.distance:
                            found[k].append({"s": first[0], "e": last[1], "t": gram, "p": 1})
        return [x for own in found for x in own]


#: Characters of texts that are searched together.
TOGETHER = 1 << 20


def _together(texts: list[str]) -> list[tuple[int, int]]:
    """Runs of texts that are searched together."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or i == len(texts) - 1:
            out.append((begin, i + 1))
            begin, size = i + 1, 0
    return out


def _searched(texts: list[str | None], searches: list[Callable[[str], list[dict]]]) -> list[dict]:
    """FOUND of each text."""
    out, given = [{"found": [], "timeouts": []} for _ in texts], [x or "" for x in texts]
    for begin, end in _together(given):
        part, some = out[begin:end], given[begin:end]
        for s in searches:
            if hasattr(s, "all"):
                for x, found in zip(part, s.all(some), strict=True):
                    late = isinstance(found, TimeoutError)
                    x["found"].append([] if late else found)
                    x["timeouts"] += [s.label] * late
                continue
            for x, text in zip(part, some, strict=True):
                try:
                    x["found"].append(s(text))
                except TimeoutError:
                    x["found"].append([])
                    x["timeouts"].append(s.label)
    return out


def _column(texts: list[str | None], searches: list[Callable[[str], list[dict]]]) -> pa.Array:
    """FOUND of each text as a column; lists of terms give theirs without an object for each match."""
    n, k = len(texts), len(searches)
    others = _searched(texts, [s for s in searches if not hasattr(s, "column")])
    given, columns, place = [x or "" for x in texts], [], 0
    for s in searches:
        if hasattr(s, "column"):
            columns.append(s.column(given))
        else:
            columns.append(pa.array([x["found"][place] for x in others], _MATCHES))
            place += 1
    in_rows = pa.concat_arrays(columns).take(pa.array(np.arange(n * k).reshape(k, n).T.ravel())) if k > 1 else columns[0]
    found = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), in_rows)
    return pa.StructArray.from_arrays([found, pa.array([x["timeouts"] for x in others], pa.list_(pa.string()))], ["found", "timeouts"])


def search_each(texts: Column, searches: list[Callable[[str], list[dict]]]) -> Column:
    """A FOUND for each text of an array."""

    @F.pandas_udf(f"array<{FOUND}>")
    def run(rows: pd.Series) -> pd.Series:
        own = [list(row) if row is not None else [] for row in rows]
        done = iter(_searched([t for row in own for t in row], searches))
        return pd.Series([[next(done) for _ in row] for row in own], dtype=object)

    return run(texts)


def search(text: Column, searches: list[Callable[[str], list[dict]]]) -> Column:
    """FOUND: the matches of each search, in order, and the labels of those that ran out of time."""

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        return _column(texts.to_pylist(), searches)

    return run(text)


_JUDGED = "struct<ignored:array<struct<ordinal:int,text:string>>,timeouts:array<string>>"
#: Verdicts that a task remembers: a text is judged once by a pattern, however often it comes.
_REMEMBERED = 100_000


def judge(asked: Column, patterns: dict[int, list[str]], budget_ms: int = BUDGET_MS) -> Column:
    """Of an array of (ordinal, text), those that a pattern of that ordinal matches anywhere; and the patterns that ran out of time.

    A text that a pattern has no verdict on within its budget isn't ignored. A pattern that runs out of time on a few texts of a task isn't
    tried on further ones there: they aren't ignored either, and the pattern is named for them too.
    """
    late_texts = 5

    @F.pandas_udf(_JUDGED)
    def run(rows: pd.Series) -> pd.DataFrame:
        import regex

        compiled = {p: regex.compile(p) for own in patterns.values() for p in own}
        spent: dict[str, int] = dict.fromkeys(compiled, 0)

        @lru_cache(maxsize=_REMEMBERED)
        def verdict(pattern: str, text: str) -> bool | None:
            if spent[pattern] >= late_texts:
                return None
            try:
                return compiled[pattern].search(text, timeout=budget_ms / 1000) is not None
            except TimeoutError:
                spent[pattern] += 1
                return None

        ignored, late = [], []
        for row in rows:
            hit, slow = [], []
            for x in row if row is not None else []:
                found = [(p, verdict(p, x["text"])) for p in patterns.get(x["ordinal"], [])]
                if any(v for _, v in found):
                    hit.append(x)
                slow += [f"ignored pattern '{p}'" for p, v in found if v is None]
            ignored.append(hit)
            late.append(list(dict.fromkeys(slow)))
        return pd.DataFrame({"ignored": ignored, "timeouts": late})

    return run(asked)


@lru_cache(maxsize=1024)
def _parsed(todo: str) -> dict:
    return json.loads(todo)


def _value(span: dict, seed: int, today: date, lists: dict[str, list[str]], generate, base: int = 0, secret: bytes = b"") -> tuple[str, bool]:
    """The replacement that a span's `todo` asks for, and whether it changed the token; its redaction where none can be made."""
    ask, token, form = _parsed(span["todo"]), span["text"], span["pattern"]
    in_context = str(ask.get("replacementScope", "")).upper() == "CONTEXT"
    key = f"{base}|{span['context']}|{token}" if in_context else f"{seed}|{span['character_start']}|{token}"  # of a context: the same value in all documents
    kind, value = ask["kind"], None
    if kind == "RANDOM_REPLACE":
        value = anonymize.anonymize(span["filter_type"], token, key, ask.get("anonymizationMethod", "realistic"), ask.get("anonymizationCandidates"), lists, secret)
    elif kind == "FPE_ENCRYPT_REPLACE":
        value = fpe.encrypt_token(ask["fpe_key"], ask["fpe_tweak"], token)
    elif kind == "SHIFT":
        if str(ask.get("shiftRandom", False)).lower() == "true":
            rng = anonymize.generator(key, secret)
            days, months, years = rng.randrange(1, 30), rng.randrange(1, 12), -rng.randrange(1, 3)
        else:
            days, months, years = (int(ask.get(k, 0)) for k in ("shiftDays", "shiftMonths", "shiftYears"))
        value = dates.shift(token, form, days, months, years, bool(ask.get("futureDates", False)), today)
    elif kind == "TRUNCATE_TO_YEAR":
        value = dates.year(token, form)
    elif kind == "RELATIVE":
        value = dates.relative(token, form, bool(ask.get("futureDates", False)), today)
    elif kind == "GENERATE" and generate is not None:
        try:
            made = generate(ask["generator"], token, span["classification"])
        except Exception:  # noqa: BLE001  a service of the caller's: any failure means the fallback
            made = None
        value = made if made and made.strip() and made.strip().lower() != token.strip().lower() else None
    return (span["replacement"], span["applied"]) if value is None else (value, kind in ("RANDOM_REPLACE", "FPE_ENCRYPT_REPLACE", "GENERATE") or value != token)


#: How `todo` names a replacement that a generator makes.
GENERATED = '"kind": "GENERATE"'
#: What the making of a replacement reads of a span, and what it gives.
_ASKED = ("todo", "text", "pattern", "filter_type", "classification", "context", "character_start", "replacement", "applied")
_MADE = "struct<replacement:string,applied:boolean>"


def _asked(spans: Column) -> Column:
    """The spans that ask for a replacement, with those fields alone; the others as null."""
    return F.transform(spans, lambda x: F.when(x["todo"].isNotNull(), F.struct(*[x[n].alias(n) for n in _ASKED])))


def _filled(spans: Column, made: Column) -> Column:
    return F.zip_with(spans, made, lambda x, m: F.when(m.isNull(), x).otherwise(x.withField("replacement", m["replacement"]).withField("applied", m["applied"]).withField("todo", F.lit(None).cast("string"))))


@dataclass(frozen=True)
class Making:
    """What replacements are made with. Those of scope CONTEXT come from the secret, `base`, the context and the token alone."""

    today: date
    lists: dict[str, list[str]]
    generate: Callable | None = None
    base: int = 0
    secret: bytes = b""

    def of(self, span: dict | None, seed: int) -> dict | None:
        if span is None:
            return None
        replacement, applied = _value(span, seed, self.today, self.lists, self.generate, self.base, self.secret)
        return {"replacement": replacement, "applied": applied}

    def prepare(self, spans) -> None:
        """Let a generator that can make many values together make those of a batch."""
        if hasattr(self.generate, "prepare"):
            asked = [(_parsed(x["todo"]), x) for x in spans if x is not None]
            self.generate.prepare([(a["generator"], x["text"], x["classification"]) for a, x in asked if a["kind"] == "GENERATE"])


def make(df: DataFrame, spans: str, seed: str, how: Making) -> DataFrame:
    """df with `__made`: the replacements that `todo` asks for (null for the other spans), from a secret and the row's seed, so that a task

    computed again gives the same."""

    @F.pandas_udf(f"array<{_MADE}>")
    def run(asked: pd.Series, seeds: pd.Series) -> pd.Series:
        how.prepare([x for row in asked if row is not None for x in row])
        return pd.Series([[how.of(x, int(s)) for x in row] if row is not None else None for row, s in zip(asked, seeds, strict=True)])

    return S.settled(df.withColumn("__made", run(_asked(F.col(spans)), F.col(seed))), "__made")


def make_each(df: DataFrame, spans: str, seeds: Column, how: Making) -> DataFrame:
    """As make, for an array of spans for each element of an array of texts, and their seeds."""

    @F.pandas_udf(f"array<array<{_MADE}>>")
    def run(asked: pd.Series, all_seeds: pd.Series) -> pd.Series:
        how.prepare([x for row in asked if row is not None for own in row for x in own])
        return pd.Series([[[how.of(x, int(s)) for x in own] for own, s in zip(row, row_seeds, strict=True)] if row is not None else None for row, row_seeds in zip(asked, all_seeds, strict=True)])

    return S.settled(df.withColumn("__made", run(F.transform(F.col(spans), _asked), seeds)), "__made")


def generated(spans: Column, made: Column) -> Column:
    """The values of one text that a generator of the caller's made."""
    asked = F.zip_with(spans, made, lambda x, m: F.when(F.contains(x["todo"], F.lit(GENERATED)) & (m["replacement"] != x["replacement"]), m["replacement"]))
    return F.filter(asked, lambda t: t.isNotNull())


def filled(spans: Column, made: Column, rejected: Column | None = None) -> Column:
    """spans with their replacements; generated ones among `rejected` give way to the span's fallback."""
    if rejected is None:
        return _filled(spans, made)

    def checked(x: Column, m: Column) -> Column:
        bad = F.contains(x["todo"], F.lit(GENERATED)) & F.array_contains(rejected, m["replacement"])
        return F.when(bad, F.struct(x["replacement"].alias("replacement"), x["applied"].alias("applied")).cast(_MADE)).otherwise(m)

    return _filled(spans, F.zip_with(spans, made, checked))
