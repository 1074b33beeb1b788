"""From a policy to a plan: one projection that finds, resolves and replaces, row by row, without a shuffle.

Pattern detectors are Catalyst expressions; only filters that need Python (patterns and dictionaries of users, cards without
boundaries) run in one Arrow kernel, and only if the policy has them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import keyed, strategies, validators
from ..operators import catalog, kernel, phones, splitting
from ..operators.disambiguation import Disambiguation, learn, settle
from ..operators.ner import RemoteSearch
from .policy import Policy

#: Words of context on each side, where a filter doesn't say.
WINDOW = 5


@dataclass
class Resources:
    """Lists that a deployment supplies.

    terms: word lists of the dictionary filters by name (city, county, state, hospital, first-name, surname); tlds: top-level
    domains in lower case; zips: codes of five digits to their population; mappings: of mapping files, by path; files: lines
    of the files that ignored sets name; searches: further detectors by the id of a `pheyes` entry; generate: makes
    replacements for strategies with a generator.
    """

    terms: dict[str, list[str]] = field(default_factory=dict)
    tlds: list[str] = field(default_factory=list)
    zips: dict[str, int] = field(default_factory=dict)
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    files: dict[str, list[str]] = field(default_factory=dict)
    searches: dict[str, Callable[[str], list[dict]]] = field(default_factory=dict)
    generate: Callable | None = None


@dataclass
class _Filter:
    key: str
    options: dict
    name: str
    terms: tuple
    confidences: list
    classifications: list
    formats: list
    always: list
    modifiers: tuple
    valid: list[str]
    valid_first: bool
    trims: bool
    drops: bool
    raw: Callable[[Column], Column] | None  # from the text to matches; None: from the kernel
    search: Callable | None = None


def _pattern_filter(key: str, options: dict) -> _Filter:
    d = catalog.detectors(key, options)
    unbounded = key == "creditCard" and not options.get("onlyWordBoundaries", True)
    search = kernel.PatternSearch(f"{d.name} pattern '{d.patterns[0].regex}'", d.patterns[0].regex, 1) if unbounded else None

    def raw(text: Column) -> Column:
        found = F.concat(*[S.find(text, p.java, i) for i, p in enumerate(d.patterns)])
        if key == "phoneNumber" and len(d.patterns) > 1:
            found = phones.merged(found, catalog.phone_regions(options))
        return F.when(text.rlike(catalog.needs(key, options)), found).otherwise(S.none_of(S.MATCH))

    p = d.patterns
    return _Filter(key, options, d.name, d.terms, [x.confidence for x in p], [x.classification for x in p], [x.format for x in p], [x.always_valid for x in p], p[0].modifiers, (d.valid or "").split("+") if d.valid else [], d.valid_first, d.trims, d.drops_overlaps, None if search else raw, search)


def _other_filter(key: str, options: dict, resources: Resources) -> _Filter | None:
    name = catalog.NAMES[key]
    more = {"trims": True, "drops": False}
    confidences, classification = [0.90], options.get("classification")
    if key == "identifiers":
        search = kernel.PatternSearch(f"identifier pattern '{options.get('pattern')}'", options.get("pattern") or r"\b[A-Z0-9_-]{6,}\b", int(options.get("groupNumber", 0)), not options.get("caseSensitive", True))
        more["trims"] = False
    elif key == "sections":
        search = kernel.PatternSearch("section pattern", f"(?:{options['startPattern']})(.*?)(?:{options['endPattern']})")
        more["trims"] = False
    elif key == "pheyes":
        search = resources.searches.get(options.get("id", ""))
        if search is None and options.get("phEyeConfiguration", {}).get("endpoint"):
            search = RemoteSearch.of(options)
        if search is None:
            raise ValueError("a pheyes filter needs an endpoint, or a search of its id in Resources.searches")
        more["trims"] = False
    else:
        files = [t for path in options.get("files", []) for t in resources.files[path]]
        terms = [*options.get("terms", []), *files] if key == "dictionaries" else resources.terms.get(name)
        if terms is None:
            raise ValueError(f"the {key} filter needs a word list in Resources.terms['{name}']")
        if options.get("fuzzy"):
            sensitivity = str(options.get("sensitivity", "off" if key == "dictionaries" else "medium")).lower()
            search = kernel.FuzzySearch(name, terms, sensitivity, bool(options.get("capitalized", False)))
            confidences = [1.0, {"high": 0.9, "medium": 0.7, "low": 0.5}.get(sensitivity, 0.9)]
        else:
            search, confidences = kernel.TermSearch(name, terms), [1.0]
    n = len(confidences)
    return _Filter(key, options, name, (), confidences, [classification] * n, [None] * n, [False] * n, (), [], False, more["trims"], more["drops"], None, search)


def _refuse_clashes(df: DataFrame, *results: str) -> None:
    """Input columns are never overwritten: those with the name of a result (in any case) are an error."""
    if taken := sorted({c for c in df.columns if c.lower() in results}):
        raise ValueError(f"the columns {', '.join(taken)} have the names of results; rename or drop them first")


class Redactor:
    """A policy, ready to be applied to any number of DataFrames (batch or streaming)."""

    def __init__(self, policy: Policy, resources: Resources | None = None, seed: int = 0, as_of: date | None = None, budget_ms: int = kernel.BUDGET_MS, secret: str | bytes | None = None):
        """secret: what nonces, salts and random values are drawn with. Without one the policy's crypto key stands in; without that too one is

        drawn now, so that another Redactor gives other values. Seeds aren't secret: they only tell rows apart.
        """
        if errors := policy.errors():
            from .policy import PolicyError

            raise PolicyError(errors)
        self.policy, self.resources, self.seed, self.as_of = policy, resources or Resources(), seed, as_of
        secret = secret or policy.secret("crypto", "key")
        self.budget_ms = budget_ms
        self.lasting, self.secret = secret is not None, keyed.given(secret) if secret else keyed.fresh()
        if wrong := self._unmet():
            raise ValueError("; ".join(wrong))
        self.filters = [_pattern_filter(k, o) if k in catalog.PATTERN_KEYS else _other_filter(k, o, self.resources) for k, o in policy.filters()]
        for f in self.filters:
            if isinstance(f.search, kernel.PatternSearch):
                f.search.budget = budget_ms / 1000

    def _unmet(self) -> list[str]:
        """Options that ask for a list that isn't there: without it they would drop every span, and leave the values in clear."""
        out = [f"ignored: the list '{path}' needs Resources.files" for s in self.policy.data.get("ignored", []) for path in s.get("files", []) if path not in self.resources.files]
        for key, options in self.policy.filters():
            if key == "emailAddress" and options.get("onlyValidTLDs") and not self.resources.tlds:
                out.append("emailAddress.onlyValidTLDs needs Resources.tlds")
            if key == "zipCode" and options.get("validate") and not self.resources.zips:
                out.append("zipCode.validate needs Resources.zips")
            files = [*options.get("files", []), *options.get("ignoredFiles", []), *(f for s in options.get("ignored", []) if isinstance(s, dict) for f in s.get("files", []))]
            out += [f"{key}: the list '{path}' needs Resources.files" for path in files if path not in self.resources.files]
            for s in self.policy.strategies(key, options):
                out += [f"{key}: the mapping file '{path}' needs Resources.mappings" for path in s.get("mappingFiles", []) if path not in self.resources.mappings]
                if str(s.get("replacementScope", "")).upper() == "CONTEXT" and s.get("strategy") == "RANDOM_REPLACE" and not self.lasting:
                    out.append(f"{key}: replacementScope CONTEXT needs a secret (Redactor(secret=...) or /crypto/key), so that later runs give the same values and nobody else can")
                if "population" in str(s.get("condition", "")).lower() and not self.resources.zips:
                    out.append(f"{key}: a condition on population needs Resources.zips")
        return out

    # ---- one filter ----

    def _population(self, token: Column) -> Column:
        zips = self.resources.zips
        table = strategies.literal_map(zips, "Resources.zips", "operators.dictionary.known_zips") if zips else None
        return F.try_element_at(table, token) if table is not None else F.lit(None).cast("int")

    def _valid(self, name: str, x: Column, options: dict) -> Column:
        t = x["text"]
        plain = {
            "aba": lambda: validators.aba(t), "luhn": lambda: validators.luhn(t), "iban": lambda: validators.iban(t),
            "sin-prefix": lambda: validators.luhn(t) & ~F.substring(t, 1, 1).isin("0", "8"),
            "card": lambda: validators.digits(t).rlike(catalog.CARD_BRANDS) & validators.luhn(t),
            "no-timestamp": lambda: ~validators.digits(t).rlike(catalog.UNIX_TIMESTAMP),
            "date": lambda: x["always_valid"] | validators.date(t, x["pattern"]),
            "ein-prefix": lambda: F.substring(t, 1, 2).isin(catalog.EIN_PREFIXES),
            "itin": lambda: F.substring(validators.digits(t), 4, 2).rlike("^(5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])$"),
            # the list of top-level domains is short
            "tld": lambda: F.array_contains(F.array(*[F.lit(w) for w in self.resources.tlds]).cast("array<string>"), F.lower(F.regexp_extract(t, r"\.([A-Za-z]+)\.?$", 1))),
            "zip": lambda: self._population(F.substring(t, 1, 5)).isNotNull(),
        }
        return F.coalesce(plain[name](), F.lit(False))

    def _filter_spans(self, f: _Filter, ordinal: int, text: Column, context: Column, row_seed: Column, raw: Column, windows: bool) -> Column:
        options = f.options
        size = int(options.get("windowSize", 0)) or WINDOW
        ignored = {t.lower() for t in [*self._ignored(options.get("ignored")), *self._lines(options.get("ignoredFiles"))]}
        pick = lambda values, p, kind: F.lit(values[0]).cast(kind) if len(set(values)) == 1 else F.get(F.array(*[F.lit(v).cast(kind) for v in values]), p)

        strategies.check_literals(len(ignored), f"ignored terms of {f.key}", "operators.dictionary.without_terms")

        def dropped(t: Column) -> Column:
            return F.lower(t).isin(sorted(ignored)) if ignored else F.lit(False)

        mappings: dict[str, str] = {}
        for s in self.policy.strategies(f.key, options):
            for path in s.get("mappingFiles", []):
                mappings |= self.resources.mappings.get(path, {})

        def rated(m: Column) -> Column:
            base = S.modified(f.confidences[0], f.modifiers, text, m["s"], m["e"]) if f.modifiers else pick(f.confidences, m["p"], "double")
            if f.key == "phoneNumber":
                base = F.when(m["t"].rlike(catalog.java(catalog.PHONE_NANP)), 0.95).when(F.length(m["t"]) > 14, 0.75).otherwise(0.60)
            return F.struct(m.alias("m"), S.boosted(base, text, m["s"], m["e"], f.terms, size).alias("c"), F.xxhash64(row_seed, m["s"], m["t"]).alias("k"))

        def span(x: Column) -> Column:
            m, c = x["m"], x["c"]
            kind = pick([v if v is not None else options.get("classification") for v in f.classifications], m["p"], "string")
            r = strategies.chosen(self.policy.strategies(f.key, options), f.name, m["t"], context, c, kind, x["k"], self.policy, self._population, mappings, self.secret)
            return F.struct(x.alias("x"), kind.alias("kind"), r.alias("r"))

        def built(y: Column) -> Column:
            m, r = y["x"]["m"], y["r"]
            window = S.window_of(text, m["s"], m["e"], size) if windows else F.lit(None).cast("array<string>")
            return F.struct(
                m["s"].alias("character_start"), m["e"].alias("character_end"), F.lit(f.name).alias("filter_type"), context.alias("context"), y["kind"].alias("classification"),
                y["x"]["c"].alias("confidence"), m["t"].alias("text"), r["value"].alias("replacement"), r["salt"].alias("salt"), F.lit(False).alias("ignored"), r["applied"].alias("applied"),
                F.lit(int(options.get("priority", 0))).alias("priority"), pick(f.formats, m["p"], "string").alias("pattern"), window.alias("window"), pick(f.always, m["p"], "boolean").alias("always_valid"),
                r["color"].alias("color"), F.lit(ordinal).alias("ordinal"), r["todo"].alias("todo"),
            ).cast(S.SPAN)

        seen = F.filter(raw, lambda m: ~dropped(m["t"]) & m["t"].rlike(r"(?U)\S"))
        out = F.filter(F.transform(F.transform(seen, rated), span), lambda y: y["r"].isNotNull())
        single = f.raw is not None and len(f.confidences) == 1  # matches of one pattern neither repeat nor overlap
        distinct = single or isinstance(f.search, kernel.TermSearch)  # no two of one range
        out = F.transform(out, built) if distinct else S.first_of_range(F.transform(out, built))
        for name in f.valid if f.valid_first else []:
            out = self._keep(out, name, options)
        if f.trims:
            posts = self.policy.config("postFilters")
            out = S.trimmed(out, posts.get("removeTrailingNewLines", True), posts.get("removeTrailingPeriods", True), posts.get("removeTrailingSpaces", True))
            if ignored:
                out = F.filter(out, lambda x: ~dropped(x["text"]))
        for name in [] if f.valid_first else f.valid:
            out = self._keep(out, name, options)
        if f.key == "identifiers" and options.get("validator"):
            check = validators.named(options["validator"]["name"], options["validator"].get("params"))
            out = F.filter(out, lambda x: F.coalesce(check(x["text"]), F.lit(False)))
        # what patterns will take out must not have pushed another span aside
        return S.resolved(out) if f.drops and not single and not options.get("ignoredPatterns") else out

    def _keep(self, spans: Column, name: str, options: dict) -> Column:
        return F.filter(spans, lambda x: self._valid(name, x, options))

    def _ignored(self, sets) -> list[str]:
        """Terms of ignored sets, with the lines of their files."""
        out: list[str] = []
        for s in sets or []:
            if isinstance(s, str):
                out.append(s)
            else:
                out += s.get("terms", [])
                out += self._lines(s.get("files"))
        return out

    def _lines(self, files) -> list[str]:
        return [t for path in ([files] if isinstance(files, str) else files or []) for t in self.resources.files.get(path, [])]

    def _globally_kept(self, spans: Column) -> Column:
        exact, folded = set(), set()
        for s in self.policy.data.get("ignored", []):
            (exact if s.get("caseSensitive", False) else folded).update(self._ignored([s]))
        folded = {t.lower() for t in folded}
        strategies.check_literals(len(exact) + len(folded), "ignored terms", "operators.dictionary.without_terms")
        for words, fold in ((exact, lambda t: t), (folded, F.lower)):
            if words:
                spans = self._without(spans, sorted(words), fold)
        return spans

    @staticmethod
    def _patterns(given) -> list[str]:
        return [p["pattern"] if isinstance(p, dict) else p for p in given or []]

    def _without_ignored(self, df: DataFrame, name: str, nested: bool, own: bool) -> DataFrame:
        """df without those of its spans (column name; nested: an array of spans for each text) that ignored patterns match.

        own: the patterns of single filters, else those of the policy. They are judged under a time budget, each text of a row once.
        """
        ordinal = (lambda x: x["ordinal"]) if own else (lambda x: F.lit(-1))
        given = {i: self._patterns(f.options.get("ignoredPatterns")) for i, f in enumerate(self.filters)} if own else {-1: self._patterns(self.policy.data.get("ignoredPatterns"))}
        given = {k: v for k, v in given.items() if v}
        if not given:
            return df
        ask = lambda x: F.struct(ordinal(x).cast("int").alias("ordinal"), x["text"].alias("text"))
        df = S.settled(df, name)
        flat = F.flatten(F.col(name)) if nested else F.col(name)
        asked = F.array_distinct(F.transform(F.filter(flat, lambda x: ordinal(x).isin(list(given))), ask))
        df = S.settled(df.withColumn("__judged", kernel.judge(asked, given, self.budget_ms)), "__judged")
        kept = lambda spans: F.filter(spans, lambda x: ~F.array_contains(F.col("__judged.ignored"), ask(x)))
        late = F.array_distinct(F.concat("regex_timeouts", "__judged.timeouts"))
        out = df.withColumn(name, F.transform(name, kept) if nested else kept(F.col(name))).withColumn("regex_timeouts", late)
        return out.drop("__judged")

    @staticmethod
    def _without(spans: Column, words: list[str], fold) -> Column:
        return F.filter(spans, lambda x: ~fold(x["text"]).isin(words))

    # ---- DataFrames ----

    def _found(self, text: Column, context: Column, row_seed: Column, kernel_found: Column | None, windows: bool) -> Column:
        """The spans of all filters in one text."""
        parts, k = [], 0
        for i, f in enumerate(self.filters):
            if f.search is not None:
                raw, k = F.get(kernel_found, F.lit(k)), k + 1
            else:
                raw = f.raw(text)
            parts.append(self._filter_spans(f, i, text, context, row_seed, raw, windows))
        found = F.flatten(F.array(*parts)) if parts else S.none_of(S.SPAN)
        return F.coalesce(found, S.none_of(S.SPAN))

    def _searches(self, df: DataFrame) -> list:
        """The searches of the filters that have one, with their lists sent to the executors."""
        found = [f.search for f in self.filters if f.search is not None]
        return [s.shared(df.sparkSession) if hasattr(s, "shared") else s for s in found]

    def detect(self, df: DataFrame, text: str = "text", context: str | Column = "none", windows: bool = False) -> DataFrame:
        """df with `spans` (each filter's, before they are resolved) and `regex_timeouts`."""
        _refuse_clashes(df, "spans", "regex_timeouts")
        c = F.lit(context) if isinstance(context, str) else context
        searches = self._searches(df)
        df = df.withColumn("__row", F.xxhash64(F.lit(self.seed), F.col(text)))
        if searches:
            df = S.settled(df.withColumn("__kernel", kernel.search(F.col(text), searches)), "__kernel")
        df = df.withColumn("spans", self._found(F.col(text), c, F.col("__row"), F.col("__kernel.found") if searches else None, windows))
        df = df.withColumn("regex_timeouts", F.col("__kernel.timeouts") if searches else S.none_of("string"))
        return self._without_ignored(df, "spans", False, True)

    def detect_each(self, df: DataFrame, texts: str, context: str | Column = "none", windows: bool = False) -> DataFrame:
        """df with `__found`: an array of spans for each element of `texts` (an array of structs with a field `text`), and `regex_timeouts`.

        All within the row: nothing is exploded, keyed or joined.
        """
        c = F.lit(context) if isinstance(context, str) else context
        searches = self._searches(df)
        if searches:
            df = S.settled(df.withColumn("__kernel", kernel.search_each(F.transform(F.col(texts), lambda p: p["text"]), searches)), "__kernel")

        def one(piece: Column, i: Column) -> Column:
            own = F.get(F.col("__kernel"), i)["found"] if searches else None
            return self._found(piece["text"], c, F.xxhash64(F.lit(self.seed), piece["text"]), own, windows)

        df = S.settled(df.withColumn("__found", F.transform(F.col(texts), one)), "__found")
        late = F.array_distinct(F.flatten(F.transform("__kernel", lambda k: k["timeouts"]))) if searches else S.none_of("string")
        return self._without_ignored(df.withColumn("regex_timeouts", late).drop("__kernel"), "__found", True, True)

    def redact_each(self, df: DataFrame, texts: str) -> DataFrame:
        """df with `__found`: the resolved spans, with their replacements, of each element of `texts` (array of structs with `text`)."""
        df = self.detect_each(df, texts)
        df = S.settled(df.withColumn("__found", F.transform("__found", lambda spans: self._globally_kept(S.resolved(spans, True)))), "__found")
        df = self._without_ignored(df, "__found", True, False).drop("regex_timeouts")
        if self._asks():
            seeds = F.transform(F.col(texts), lambda p: F.xxhash64(F.lit(self.seed), p["text"]))
            df = kernel.make_each(df, "__found", seeds, self._making())
            rejected = None
            if self._generates():
                spans = F.flatten(F.zip_with("__found", "__made", kernel.generated))
                df, rejected = self._unsafe(df, spans), F.col("__unsafe")
            done = F.zip_with("__found", "__made", lambda x, m: kernel.filled(x, m, rejected))
            df = S.settled(df.withColumn("__found", done), "__found").drop("__made", "__unsafe")
        return df

    def redact(
        self, df: DataFrame, text: str = "text", context: str | Column = "none", incremental: bool = False, disambiguate: Callable[[DataFrame], DataFrame] | None = None,
        disambiguation: Disambiguation | None = None, vectors: DataFrame | None = None,
    ) -> DataFrame:
        """df with filtered_text, spans, tokens and regex_timeouts (and incremental_redactions).

        Null texts stay null and have no spans. disambiguation: ranges that several types claim get the one that the words around it speak for,
        unless the policy declines it. It is learned from df in a first pass, or given as `vectors` (always so for streams). disambiguate: another way, from a
        DataFrame with `spans` to one with fewer of them. With splitting on, long texts are searched piece by piece and changed
        as a whole, within their row.
        """
        _refuse_clashes(df, "spans", "tokens", "filtered_text", "regex_timeouts", *(["incremental_redactions"] if incremental else []))
        if self.policy.config("analysis").get("spanDisambiguation", True) is False:
            disambiguation = disambiguate = None
        windows = disambiguation is not None or disambiguate is not None
        split = self.policy.config("splitting")
        method = str(split.get("method", "newline")).lower()
        threshold = int(split.get("threshold", 10_000))
        if split.get("enabled", False):
            df = splitting.detect_in_pieces(self, df, text, context, method, threshold, int(split.get("overlap", 0)), windows)
        else:
            df = self.detect(df, text, context, windows)
        if disambiguation is not None:
            df = S.settled(df, "spans")
            df = settle(df, learn(df, disambiguation) if vectors is None else vectors, disambiguation, context)
        if disambiguate is not None:
            df = disambiguate(df)
        df = S.settled(df.withColumn("spans", self._globally_kept(S.resolved(F.col("spans"), True))), "spans")
        df = self._without_ignored(df, "spans", False, False)
        if self._asks():
            df = kernel.make(df, "spans", "__row", self._making())
            rejected = None
            if self._generates():
                df, rejected = self._unsafe(df, kernel.generated(F.col("spans"), F.col("__made"))), F.col("__unsafe")
            df = S.settled(df.withColumn("spans", kernel.filled(F.col("spans"), F.col("__made"), rejected)), "spans").drop("__made", "__unsafe")
        df = df.withColumn("filtered_text", S.replaced(F.col(text), F.col("spans"))).withColumn("tokens", F.coalesce(S.token_count(F.col(text)), F.lit(0).cast("long")))
        if incremental:
            df = df.withColumn("incremental_redactions", S.steps(F.col(text), F.col("spans")))
        return df.drop("__row", "__kernel")

    def _making(self) -> kernel.Making:
        return kernel.Making(self.as_of or date.today(), self.resources.terms, self.resources.generate, self.seed, self.secret)

    def _generates(self) -> bool:
        return self.resources.generate is not None and any(s.get("generator") for k, o in self.policy.filters() for s in self.policy.strategies(k, o))

    def _unsafe(self, df: DataFrame, values: Column) -> DataFrame:
        """df with `__unsafe`: those of its generated values in which this policy's own detectors find something, or ran out of time."""
        texts = F.transform(F.array_distinct(values), lambda t: F.struct(t.alias("text")))
        kept = df.withColumn("__texts", texts).withColumnsRenamed({"__found": "__before", "__kernel": "__kernel_before", "regex_timeouts": "__late"})
        seen = self.detect_each(S.settled(kept, "__texts"), "__texts")
        found = F.filter(F.zip_with("__texts", "__found", lambda t, f: F.when((F.size(f) > 0) | (F.size("regex_timeouts") > 0), t["text"])), lambda t: t.isNotNull())
        out = S.settled(seen.withColumn("__unsafe", found), "__unsafe").drop("__texts", "__found", "regex_timeouts")
        return out.withColumnsRenamed({"__before": "__found", "__kernel_before": "__kernel", "__late": "regex_timeouts"})

    def _asks(self) -> bool:
        kinds = {"RANDOM_REPLACE", "FPE_ENCRYPT_REPLACE", "SHIFT", "TRUNCATE_TO_YEAR", "RELATIVE"}
        return any({s.get("strategy"), str(s.get("fallbackStrategy", "")).upper()} & kinds or s.get("generator") for k, o in self.policy.filters() for s in self.policy.strategies(k, o))


def redact(df: DataFrame, policy: Policy, text: str = "text", context: str | Column = "none", resources: Resources | None = None, seed: int = 0, as_of: date | None = None, incremental: bool = False, secret: str | bytes | None = None) -> DataFrame:
    return Redactor(policy, resources, seed, as_of, secret=secret).redact(df, text, context, incremental)


def explode_spans(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each span, with the given columns of its document."""
    return df.select(*keys, F.explode("spans").alias("span")).select(*keys, "span.*").drop("todo")


def explain(df: DataFrame, policy: Policy, text: str = "text", **how) -> DataFrame:
    """df with what redact would do: applied and ignored spans apart."""
    r = Redactor(policy, how.pop("resources", None), how.pop("seed", 0), how.pop("as_of", None), secret=how.pop("secret", None))
    found = r.redact(df, text, **how)
    return found.withColumn("applied_spans", F.filter("spans", lambda x: x["applied"])).withColumn("ignored_spans", F.filter("spans", lambda x: ~x["applied"]))
