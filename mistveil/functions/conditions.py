"""The condition language of strategies: comparisons joined by `and`, as a Column over a span's fields.

    condition  = comparison { "and" comparison }
    comparison = field operator value
    value      = '"' text without '"' '"' | number

Fields and words are read in any case; blanks may stand between parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_EQUALITY, _ORDER = {"==", "!=", "is", "is not"}, {">", "<", ">=", "<="}
#: What each field is compared with, and by which operators.
FIELDS = {
    "token": (str, _EQUALITY | _ORDER | {"startswith"}),
    "context": (str, _EQUALITY | _ORDER | {"startswith"}),
    "type": (str, _EQUALITY),
    "confidence": (float, _EQUALITY | _ORDER),
    "population": (float, _EQUALITY | _ORDER),
}
#: The parts of a comparison, and what may stand between two: a name for messages, and its pattern.
_PARTS = {
    "field": ("one of " + ", ".join(FIELDS), re.compile(rf"\s*(?P<field>{'|'.join(FIELDS)})\b", re.IGNORECASE)),
    "operator": ("an operator", re.compile(r"\s*(?P<operator>[=!<>]=|[<>]|startswith\b|is\s+not\b|is\b)", re.IGNORECASE)),
    "value": ("a quoted text or a number", re.compile(r'\s*(?:"(?P<text>[^"]*)"|(?P<number>[0-9]+(?:\.[0-9]+)?))')),
    "and": ("'and' or the end", re.compile(r"\s*and\b", re.IGNORECASE)),
}
_OR = re.compile(r"\s*(?:or\b|\|\|)", re.IGNORECASE)
#: Fixed value: what users are told about `or`.
OR_MESSAGE = "joins comparisons with 'or', which is not supported; only 'and' is"


class InvalidCondition(ValueError):
    pass


@dataclass(frozen=True)
class Clause:
    field: str
    operator: str
    value: str
    number: float | None


def parse(condition: str) -> tuple[Clause, ...]:
    """The comparisons of a condition, all of which must hold; InvalidCondition says where it goes wrong."""
    clauses, at = [], 0

    def take(part: str) -> re.Match:
        nonlocal at
        wanted, pattern = _PARTS[part]
        if not (m := pattern.match(condition, at)):
            raise InvalidCondition(OR_MESSAGE if part == "and" and _OR.match(condition, at) else f"needs {wanted} at character {at + 1}: '{condition[at:].strip()[:20]}'")
        at = m.end()
        return m

    while not clauses or condition[at:].strip():
        if clauses:
            take("and")
        field = take("field")["field"].lower()
        operator = " ".join(take("operator")["operator"].lower().split())
        value = take("value")
        kind, operators = FIELDS[field]
        if operator not in operators:
            raise InvalidCondition(f"compares {field} by '{operator}'; it can be compared by {', '.join(sorted(operators))}")
        if kind is float and value["number"] is None:
            raise InvalidCondition(f"compares {field} with a text; it is a number")
        clauses.append(Clause(field, operator, value["text"] if value["number"] is None else value["number"], None if value["number"] is None else float(value["number"])))
    return tuple(clauses)


def error(condition: str) -> str | None:
    try:
        parse(condition)
    except InvalidCondition as e:
        return str(e)
    return None


def _compare(left: Column, operator: str, right) -> Column:
    return {"==": left == right, "is": left == right, "!=": left != right, "is not": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[operator]


def holds(condition: str | None, token: Column, context: Column, confidence: Column, classification: Column, population=None) -> Column:
    """Whether a condition holds; none or a blank one always does. population: from a token to its number or null."""
    if not condition or not condition.strip():
        return F.lit(True)
    out = F.lit(True)
    for c in parse(condition):
        if c.field in ("token", "context"):
            actual = token if c.field == "token" else context
            test = F.startswith(F.lower(actual), F.lit(c.value.lower())) if c.operator == "startswith" else _compare(actual, c.operator, F.lit(c.value))
        elif c.field == "type":
            same = F.coalesce(F.lower(classification) == c.value.lower(), F.lit(False))
            test = same if c.operator in ("==", "is") else ~same
        elif c.field == "confidence":
            off = F.abs(confidence - c.number)
            test = off < 0.0001 if c.operator in ("==", "is") else off >= 0.0001 if c.operator in ("!=", "is not") else _compare(confidence, c.operator, F.lit(c.number))
        else:
            test = F.coalesce(_compare(population(token), c.operator, F.lit(c.number)), F.lit(False)) if population else F.lit(False)
        out = out & test
    return out
