"""Policies: JSON that says which identifiers to find and what to do with each. Read, normalised and checked on the driver."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from ..functions import conditions, validators
from ..operators import catalog, phones
from . import schema

STRATEGIES = (
    "REDACT RANDOM_REPLACE STATIC_REPLACE CRYPTO_REPLACE FPE_ENCRYPT_REPLACE HASH_SHA256_REPLACE LAST_4 MASK ABBREVIATE MAP_REPLACE SAME TRUNCATE"
    " TRUNCATE_TO_YEAR SHIFT RELATIVE"
).split()
LISTS = schema.LISTS
STRATEGY_KEYS = {"bitcoinAddress": "bitcoinFilterStrategies", "dictionaries": "customFilterStrategies", "identifiers": "identifierFilterStrategies", "sections": "sectionFilterStrategies", "pheyes": "phEyeFilterStrategies"}
#: Level of a deprecated dictionary to sensitivity.
_LEVELS = {"low": "medium", "medium": "low", "high": "low"}


class PolicyError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def _clean(value: Any, path: tuple = ()) -> Any:
    """Trimmed strings, with `${NAME}` from the environment where it is set; nulls are left out."""
    if isinstance(value, str):
        value = value.strip()
        m = re.fullmatch(r"\$\{(\w+)\}", value)
        return os.environ.get(m[1], value) if m else value
    if isinstance(value, list):
        return [_clean(v, path) for v in value]
    if isinstance(value, dict):
        plain = path[-1:] in (("mappings",), ("thresholds",), ("metadata",), ("params",), ("substitutions",), ("generators",))
        return {(k if plain else _name(k)): _clean(v, (*path, k)) for k, v in value.items() if v is not None}
    return value


_KNOWN: dict[str, str] = {}


def _name(key: str) -> str:
    """Keys are matched whatever their case."""
    return _KNOWN.get(key.lower(), key)


for _word in (
    "name metadata config crypto fpe identifiers ignored ignoredPatterns graphical generators splitting pdf postFilters analysis enabled threshold method overlap"
    " removeTrailingPeriods removeTrailingSpaces removeTrailingNewLines spanDisambiguation identification key iv tweak terms files caseSensitive pattern id"
    " ignoredFiles windowSize priority strategy redactionFormat staticReplacement maskCharacter maskLength truncateLeaveCharacters truncateDirection"
    " truncateCharacter condition salt anonymizationMethod anonymizationCandidates replacementScope mappings mappingFiles generator fallbackStrategy color"
    " shiftDays shiftMonths shiftYears shiftRandom futureDates fuzzy sensitivity capitalized classification groupNumber validator startPattern endPattern"
    " region leniency onlyValidPrefixes onlyValidCreditCardNumbers onlyWordBoundaries ignoreWhenInUnixTimestamp onlyValidDates onlyStrictMatches onlyValidTLDs"
    " allowSpaces onlyValidIBANCodes onlyValidRanges ups fedex usps requireHttpWwwPrefix requireDelimiter validate phEyeConfiguration thresholds removePunctuation"
    " labels params variant substitutions level boundingBoxes dictionary person endpoint bearerToken modelPath timeout maxIdleConnections type model prompt timeoutMs page"
).split() + list(catalog.PATTERN_KEYS) + list(catalog.DICTIONARY_KEYS) + list(LISTS):
    _KNOWN[_word.lower()] = _word
for _key in [*catalog.PATTERN_KEYS, *catalog.DICTIONARY_KEYS]:
    _KNOWN[f"{_key}FilterStrategies".lower()] = f"{_key}FilterStrategies"
for _word in STRATEGY_KEYS.values():
    _KNOWN[_word.lower()] = _word


class Policy:
    """A normalised policy. `data` is its JSON."""

    def __init__(self, data: dict):
        self.data = _normalised(_clean(data))

    @classmethod
    def from_json(cls, text: str, check: bool = True) -> Policy:
        try:
            data = json.loads(text)
        except ValueError as e:
            raise PolicyError([f": not JSON ({e})"]) from e
        policy = cls(data)
        if check and (errors := policy.errors()):
            raise PolicyError(errors)
        return policy

    @classmethod
    def load(cls, path: str, check: bool = False) -> Policy:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read(), check)

    def to_json(self) -> str:
        return json.dumps(self.data, indent=2, sort_keys=True)

    @property
    def identifiers(self) -> dict:
        return self.data.get("identifiers", {})

    def config(self, name: str) -> dict:
        return self.data.get("config", {}).get(name, {})

    def filters(self) -> list[tuple[str, dict]]:
        """(key, options) of the enabled filters, in the order in which they run."""
        own = self.identifiers
        out = [(k, own[k]) for k in catalog.PATTERN_KEYS if k in own]
        out += [("pheyes", x) for x in own.get("pheyes", [])]
        out += [(k, own[k]) for k in catalog.DICTIONARY_KEYS if k in own]
        out += [(k, x) for k in ("dictionaries", "identifiers", "sections") for x in own.get(k, [])]
        return [(k, x) for k, x in out if x.get("enabled", True)]

    @staticmethod
    def strategies(key: str, options: dict) -> list[dict]:
        """A filter's strategies; none given: the default one."""
        name = STRATEGY_KEYS.get(key, f"{key}FilterStrategies")
        given = options.get(name) or (options.get("zipCodeFilterStrategy") if key == "zipCode" else None) or [{}]
        return given if isinstance(given, list) else [given]

    def secret(self, part: str, name: str) -> str | None:
        """A key of `crypto` or `fpe`; `env:NAME` reads the environment."""
        value = self.data.get(part, {}).get(name)
        return os.environ.get(value[4:]) if isinstance(value, str) and value.startswith("env:") else value

    def errors(self) -> list[str]:
        """Everything wrong with the policy, each with its place (a JSON pointer).

        Conditions can hold values of the data, so messages name the strategy and what is wrong, never the condition itself.
        """
        out = schema.wrong(self.data, schema.tree(STRATEGY_KEYS))
        if out:  # what follows reads options of the right form
            return out
        if (method := self.config("splitting").get("method", "newline").lower()) not in ("newline", "width", "characters", "character"):
            out.append(f"/config/splitting/method: unknown method '{method}'")
        for key, place, options in self._placed():
            if key == "phoneNumber":
                if regions := [r for r in catalog.phone_regions(options) if r not in phones.REGIONS]:
                    out.append(f"{place}/region: no numbering plan for {', '.join(regions)} (regions are two capitals, such as GB)")
                if (leniency := str(options.get("leniency", "POSSIBLE"))) not in phones.LENIENCIES:
                    out.append(f"{place}/leniency: unknown leniency '{leniency}'; one of {', '.join(phones.LENIENCIES)}")
            for i, s in enumerate(self.strategies(key, options)):
                at = f"{place}/{STRATEGY_KEYS.get(key, key + 'FilterStrategies')}/{i}"
                out += [at + (f' (id "{s["id"]}")' if s.get("id") else "") + f": {e}" for e in self._strategy_errors(key, s)]
            if key == "identifiers" and (v := options.get("validator")):
                try:
                    validators.named(v["name"], v.get("params"))
                except ValueError as e:
                    out.append(f"{place}/validator: {e}")
                out += [f"{place}/validator/params/{name}: {e}" for name, e in validators.unknown_params(v["name"], v.get("params"))]
            if key == "sections" and not (options.get("startPattern") and options.get("endPattern")):
                out.append(f"{place}: a start and an end pattern are needed")
        return out + self._key_errors()

    def _placed(self) -> list[tuple[str, str, dict]]:
        """filters() with the place of each."""
        seen: dict[int, str] = {}
        for key, own in self.identifiers.items():
            for i, x in enumerate(own) if isinstance(own, list) else [(None, own)]:
                seen[id(x)] = f"/identifiers/{key}" + ("" if i is None else f"/{i}")
        return [(key, seen[id(x)], x) for key, x in self.filters()]

    @staticmethod
    def _strategy_errors(key: str, s: dict) -> list[str]:
        out, kind = [], s.get("strategy", "REDACT")
        if s.get("condition") and (wrong := conditions.error(s["condition"])):
            out.append(f"the condition {wrong}")
        if (scope := str(s.get("replacementScope", "DOCUMENT")).upper()) not in ("DOCUMENT", "CONTEXT"):
            out.append(f"unknown replacementScope '{scope}'")
        if scope == "CONTEXT" and (s.get("generator") or kind in ("SHIFT", "CRYPTO_REPLACE") and s.get("shiftRandom")):
            out.append("replacementScope CONTEXT can't be kept by this strategy; join the tokens with operators.context.consistent")
        if kind not in STRATEGIES and key == "date":
            out.append(f"unsupported date strategy '{kind}'")
        return out

    def _key_errors(self) -> list[str]:
        """Keys that a strategy needs and that have the wrong length."""
        out, kinds = [], {k for key, x in self.filters() for s in self.strategies(key, x) for k in (s.get("strategy", "REDACT"), str(s.get("fallbackStrategy", "")).upper())}
        hexed = lambda value, *sizes: bool(re.fullmatch("|".join(f"[0-9a-fA-F]{{{2 * n}}}" for n in sizes), value or ""))
        if "CRYPTO_REPLACE" in kinds and "crypto" in self.data and not hexed(self.secret("crypto", "key"), 16, 24, 32):
            out.append("/crypto/key: 16, 24 or 32 bytes in hex are needed")
        if "FPE_ENCRYPT_REPLACE" in kinds and "fpe" in self.data:
            key, tweak = self.secret("fpe", "key"), self.secret("fpe", "tweak")
            if not (key and tweak):
                out.append("/fpe: a key and a tweak are needed")
            else:
                out += [] if hexed(key, 16, 24, 32) else ["/fpe/key: 16, 24 or 32 bytes in hex are needed"]
                out += [] if hexed(tweak, 7, 8) else ["/fpe/tweak: 7 or 8 bytes in hex are needed"]
        return out


def _normalised(data: dict) -> dict:
    data = dict(data)
    if not isinstance(data.get("identifiers", {}), dict):
        return data
    own = dict(data.get("identifiers", {}))
    if isinstance(own.get("dictionary"), (list, dict)):  # deprecated form
        old = own.pop("dictionary")
        moved = [{k: v for k, v in x.items() if k != "level"} | {"sensitivity": _LEVELS.get(str(x.get("level", "low")).lower(), "medium")} for x in (old if isinstance(old, list) else [old])]
        own["dictionaries"] = [*own.get("dictionaries", []), *moved]
    if isinstance(own.get("person"), (list, dict)):  # deprecated form of an NER entry
        old = own.pop("person")
        own["pheyes"] = [*own.get("pheyes", []), *(old if isinstance(old, list) else [old])]
    for key, options in list(own.items()):
        for x in options if isinstance(options, list) else [options]:
            if not isinstance(x, dict):
                continue
            if isinstance(x.get("validator"), str):
                x["validator"] = {"name": x["validator"]}
            if isinstance(x.get("region"), str):
                x["region"] = [x["region"]]
            for name, value in x.items():
                if name.lower().endswith(("filterstrategies", "filterstrategy")):
                    for s in value if isinstance(value, list) else [value]:
                        if isinstance(s, dict) and isinstance(s.get("strategy"), str):
                            s["strategy"] = {"SHIFT_DATE": "SHIFT"}.get(s["strategy"].upper(), s["strategy"].upper())
    for p in data.get("ignoredPatterns", []) if isinstance(data.get("ignoredPatterns", []), list) else []:
        if isinstance(p, dict):
            p.pop("caseSensitive", None)
    data["identifiers"] = own
    return data


# ---- policies as text ---------------------------------------------------------------------------------------------------
_HEADER = re.compile(r"\s*POLICY\s+(\w[\w-]*)(?:\s+DESCRIPTION\s+'([^']*)')?\s*;", re.I)
_RULE = re.compile(r"\s*REDACT\s+([\w\s,]+?)\s+WITH\s+(\w+)(?:\s*\(([^)]*)\))?(?:\s+WHERE\s+(.*?))?\s*;", re.I | re.S)


def from_text(text: str) -> Policy:
    """A policy from `POLICY name [DESCRIPTION '...'];` and rules `REDACT A, B WITH STRATEGY [(k = 'v', ...)] [WHERE condition];`."""
    m = _HEADER.match(text)
    if not m:
        raise PolicyError(["POLICY name; is expected first"])
    data: dict = {"name": m[1], "identifiers": {}} | ({"metadata": {"description": m[2]}} if m[2] else {})
    at = m.end()
    while text[at:].strip():
        r = _RULE.match(text, at)
        if not r:
            raise PolicyError([f"a rule REDACT ... WITH ...; is expected at {text[at : at + 40].strip()!r}"])
        strategy = {"strategy": r[2].upper()}
        for k, a, b in re.findall(r"(\w+)\s*=\s*(?:'([^']*)'|([\w.]+))", r[3] or ""):
            strategy[_name(k.replace("_", ""))] = a or b
        if r[4]:
            strategy["condition"] = r[4].replace("'", '"')
        for word in (w.strip().replace("_", "") for w in r[1].split(",")):
            key = next((k for k in [*catalog.PATTERN_KEYS, *catalog.DICTIONARY_KEYS] if k.lower() == word.lower()), None)
            if key is None:
                raise PolicyError([f"unknown identifier '{word}'"])
            data["identifiers"].setdefault(key, {}).setdefault(STRATEGY_KEYS.get(key, f"{key}FilterStrategies"), []).append(dict(strategy))
        at = r.end()
    policy = Policy(data)
    if errors := policy.errors():
        raise PolicyError(errors)
    return policy


class PolicyStore:
    """Policies as JSON files of a folder: checked when saved, taken as they are when loaded."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"not a policy name: {name!r}")
        return os.path.join(self.folder, f"{name}.json")

    def save(self, name: str, policy: Policy) -> None:
        if errors := policy.errors():
            raise PolicyError(errors)
        with open(self._path(name) + ".new", "w", encoding="utf-8") as f:
            f.write(policy.to_json())
        os.replace(self._path(name) + ".new", self._path(name))

    def load(self, name: str) -> Policy:
        return Policy.load(self._path(name))

    def names(self) -> list[str]:
        return sorted(x[:-5] for x in os.listdir(self.folder) if x.endswith(".json"))

    def delete(self, name: str) -> None:
        os.remove(self._path(name))
