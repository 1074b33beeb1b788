"""What a policy may hold: a tree of its options with their types, walked with the path of each value.

An option that isn't in the tree is an error, not a wish that nobody reads: a misspelt `regions` would leave numbers in clear.
Paths are JSON pointers, such as /identifiers/pheyes/0/phEyeFilterStrategies/1.
"""

from __future__ import annotations

import difflib
from typing import Any

from ..operators import catalog

_FLAG, _TEXT, _WHOLE, _NUMBER = "true or false", "a text", "a whole number", "a number"


class Map:
    """An object whose names are free; `of` is the type of its values (None: any)."""

    def __init__(self, of=None):
        self.of = of


class ListOf:
    """A list; `alone`: a single value may stand for a list of one."""

    def __init__(self, of, alone: bool = False):
        self.of, self.alone = of, alone


def _all(kind, names: str) -> dict:
    return dict.fromkeys(names.split(), kind)


class OneOf:
    def __init__(self, *kinds):
        self.kinds = kinds


_TEXTS = ListOf(_TEXT, alone=True)
IGNORED = {"name": _TEXT, "terms": _TEXTS, "files": _TEXTS, "caseSensitive": _FLAG}
IGNORED_PATTERN = _all(_TEXT, "name pattern")
STRATEGY = {
    **_all(_TEXT, "id strategy redactionFormat staticReplacement maskCharacter truncateDirection truncateCharacter condition anonymizationMethod replacementScope generator fallbackStrategy color"),
    **_all(_FLAG, "salt caseSensitive shiftRandom futureDates"), **_all(_WHOLE, "truncateLeaveCharacters shiftDays shiftMonths shiftYears"),
    "maskLength": OneOf(_TEXT, _WHOLE), "anonymizationCandidates": _TEXTS, "mappings": Map(_TEXT), "mappingFiles": _TEXTS,
}
FILTER = {"id": _TEXT, "enabled": _FLAG, "ignored": OneOf(_TEXTS, ListOf(IGNORED)), "ignoredFiles": _TEXTS, "ignoredPatterns": ListOf(OneOf(IGNORED_PATTERN, _TEXT)), "windowSize": _WHOLE, "priority": _WHOLE, "classification": _TEXT}
_FUZZY = {"fuzzy": _FLAG, "sensitivity": _TEXT, "capitalized": _FLAG}
#: Options of single identifiers beyond those of all.
OWN = {
    "canadaSin": _all(_FLAG, "onlyValidPrefixes"), "creditCard": _all(_FLAG, "onlyValidCreditCardNumbers onlyWordBoundaries ignoreWhenInUnixTimestamp"), "date": _all(_FLAG, "onlyValidDates"),
    "ein": _all(_FLAG, "onlyValidPrefixes"), "emailAddress": _all(_FLAG, "onlyStrictMatches onlyValidTLDs"), "ibanCode": _all(_FLAG, "allowSpaces onlyValidIBANCodes"), "itin": _all(_FLAG, "onlyValidRanges"),
    "phoneNumber": {"region": _TEXTS, "leniency": _TEXT}, "trackingNumber": _all(_FLAG, "ups fedex usps allowSpaces"), "url": _all(_FLAG, "requireHttpWwwPrefix"), "zipCode": _all(_FLAG, "requireDelimiter validate"),
    **dict.fromkeys(catalog.DICTIONARY_KEYS, _FUZZY),
    "dictionaries": {"name": _TEXT, "terms": _TEXTS, "files": _TEXTS, **_FUZZY},
    "identifiers": {"name": _TEXT, "pattern": _TEXT, "groupNumber": _WHOLE, "caseSensitive": _FLAG, "validator": OneOf({"name": _TEXT, "params": Map()}, _TEXT)},
    "sections": _all(_TEXT, "startPattern endPattern"),
    "pheyes": {"removePunctuation": _FLAG, "thresholds": Map(_NUMBER), "phEyeConfiguration": {**_all(_TEXT, "endpoint bearerToken modelPath"), "timeout": _WHOLE, "maxIdleConnections": _WHOLE, "labels": _TEXTS, "threshold": _NUMBER}},
}
CONFIG = {
    "splitting": {"enabled": _FLAG, "threshold": _WHOLE, "method": _TEXT, "overlap": _WHOLE}, "postFilters": _all(_FLAG, "removeTrailingPeriods removeTrailingSpaces removeTrailingNewLines"),
    "analysis": _all(_FLAG, "identification spanDisambiguation"),
    "pdf": {**_all(_TEXT, "redactionColor replacementFont replacementFontColor"), **_all(_FLAG, "showReplacement preserveUnredactedPages"), **_all(_NUMBER, "replacementMaxFontSize scale dpi compressionQuality")},
}
LISTS = ("dictionaries", "identifiers", "sections", "pheyes")


def tree(strategy_keys: dict[str, str]) -> dict:
    """The whole policy. strategy_keys: where the list of strategies isn't named after its identifier."""
    filters = {}
    for key in [*catalog.PATTERN_KEYS, *catalog.DICTIONARY_KEYS, *LISTS]:
        options = {**FILTER, **OWN.get(key, {}), strategy_keys.get(key, f"{key}FilterStrategies"): ListOf(STRATEGY)}
        if key == "zipCode":
            options["zipCodeFilterStrategy"] = ListOf(STRATEGY, alone=True)
        filters[key] = ListOf(options) if key in LISTS else options
    generator = {**_all(_TEXT, "type endpoint model prompt"), "timeoutMs": _WHOLE}
    box = {"color": _TEXT, "page": _WHOLE, **_all(_NUMBER, "x y w h")}
    return {
        "name": _TEXT, "metadata": Map(), "config": CONFIG, "crypto": _all(_TEXT, "key iv"), "fpe": _all(_TEXT, "key tweak"), "identifiers": filters, "ignored": ListOf(IGNORED),
        "ignoredPatterns": ListOf(IGNORED_PATTERN), "graphical": {"boundingBoxes": ListOf(box)}, "generators": Map(generator),
    }


def _fits(value: Any, kind: str) -> bool:
    if isinstance(value, str) and value.startswith("${"):  # filled in from the environment
        return True
    if kind == _FLAG:
        return isinstance(value, bool) or str(value).lower() in ("true", "false")
    if kind == _TEXT:
        return isinstance(value, str | int | float)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return False
    return not isinstance(value, bool) and (kind == _NUMBER or number == int(number))


def _named(kind) -> str:
    if isinstance(kind, OneOf):
        return " or ".join(dict.fromkeys(map(_named, kind.kinds)))
    return kind if isinstance(kind, str) else f"a list of {_named(kind.of)}" if isinstance(kind, ListOf) else "an object"


def wrong(value: Any, kind, path: str = "") -> list[str]:
    """Everything in a value that its type doesn't know, each with its path."""
    if isinstance(kind, OneOf):
        found = [wrong(value, k, path) for k in kind.kinds]
        if not all(found):
            return []
        inner = [f for f in found if any(not e.startswith(f"{path}: ") for e in f)]
        return max(inner, key=lambda f: f[0].split(":")[0].count("/"), default=[f"{path}: {_named(kind)} is expected"])  # the form that fits furthest
    if isinstance(kind, str):
        return [] if _fits(value, kind) else [f"{path}: {kind} is expected"]
    if isinstance(kind, ListOf):
        if not isinstance(value, list):
            return wrong(value, kind.of, path) if kind.alone else [f"{path}: {_named(kind)} is expected"]
        return [e for i, v in enumerate(value) for e in wrong(v, kind.of, f"{path}/{i}")]
    if not isinstance(value, dict):
        return [f"{path}: an object is expected"]
    out = []
    for name, v in value.items():
        at = f"{path}/{name}"
        if isinstance(kind, Map):
            out += wrong(v, kind.of, at) if kind.of is not None else []
        elif name not in kind:
            near = difflib.get_close_matches(name, kind, 1)
            out.append(f"{at}: unknown option" + (f"; did you mean '{near[0]}'?" if near else ""))
        else:
            out += wrong(v, kind[name], at)
    return out
