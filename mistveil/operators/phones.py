"""Phone numbers of many countries: numbering plans, from which the patterns of a policy's regions and leniency are built.

A number is a run of digits with little between them. With a `+` its country code says which plan holds, whatever the regions of a
policy; without one the plans of the policy's regions do. The patterns are run by the JVM like those of any other detector.
Leniencies: POSSIBLE asks for a length that the plan knows, VALID for digits that it gives out, the two GROUPING
ones also for breaks where the plan writes them (known for North America; elsewhere they are VALID).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spans as S

LENIENCIES = ("POSSIBLE", "VALID", "STRICT_GROUPING", "EXACT_GROUPING")


@dataclass(frozen=True)
class Plan:
    region: str
    code: str
    trunk: str  # written before a national number at home, not after the country code
    possible: tuple[int, ...]  # lengths of national numbers, also without an area code where that is dialled
    valid: tuple[int, ...]  # lengths that are given out
    first: str  # what a number that is given out begins with, as a pattern of its first digits


def _span(low: int, high: int) -> tuple[int, ...]:
    return tuple(range(low, high + 1))


# ---- fixed values: national numbering plans (ITU-T E.164 and its national annexes) ---------------------------------------------
PLANS = [
    Plan("US", "1", "1", (7, 10), (10,), "[2-9][0-9]{2}[2-9]"),
    Plan("CA", "1", "1", (7, 10), (10,), "[2-9][0-9]{2}[2-9]"),
    Plan("RU", "7", "8", (10,), (10,), "[3489]"),
    Plan("KZ", "7", "8", (10,), (10,), "[67]"),
    Plan("EG", "20", "0", _span(8, 10), _span(8, 10), "[1-9]"),
    Plan("ZA", "27", "0", (9,), (9,), "[1-8]"),
    Plan("GR", "30", "", (10,), (10,), "[2-9]"),
    Plan("NL", "31", "0", (7, 9), (9,), "[1-9]"),
    Plan("BE", "32", "0", (8, 9), (8, 9), "[1-9]"),
    Plan("FR", "33", "0", (9,), (9,), "[1-9]"),
    Plan("ES", "34", "", (9,), (9,), "[5-9]"),
    Plan("HU", "36", "06", (6, 7, 8, 9), (8, 9), "[1-9]"),
    Plan("IT", "39", "", _span(6, 12), _span(6, 11), "(?:0[1-9]|3|8)"),
    Plan("RO", "40", "0", (6, 9), (9,), "[2-9]"),
    Plan("CH", "41", "0", (9,), (9,), "[2-9]"),
    Plan("AT", "43", "0", _span(4, 13), _span(5, 13), "[1-9]"),
    Plan("GB", "44", "0", (4, 5, 6, 7, 8, 9, 10), (9, 10), "[1-35789]"),
    Plan("DK", "45", "", (8,), (8,), "[2-9]"),
    Plan("SE", "46", "0", _span(6, 10), _span(7, 10), "[1-9]"),
    Plan("NO", "47", "", (5, 8), (8,), "[2-9]"),
    Plan("PL", "48", "", (6, 7, 9), (9,), "[1-9]"),
    Plan("DE", "49", "0", _span(4, 13), _span(6, 12), "[1-9]"),
    Plan("PE", "51", "0", (6, 7, 8, 9), (8, 9), "[1-9]"),
    Plan("MX", "52", "", (7, 8, 10), (10,), "[2-9]"),
    Plan("AR", "54", "0", (6, 7, 8, 10, 11), (10, 11), "[1-9]"),
    Plan("BR", "55", "0", (8, 9, 10, 11), (10, 11), "[1-9][1-9]"),
    Plan("CL", "56", "", (7, 8, 9), (9,), "[2-9]"),
    Plan("CO", "57", "", (7, 10), (10,), "[36]"),
    Plan("VE", "58", "0", (7, 10), (10,), "[24]"),
    Plan("MY", "60", "0", _span(6, 10), (8, 9, 10), "[1-9]"),
    Plan("AU", "61", "0", (8, 9), (9,), "[2-478]"),
    Plan("ID", "62", "0", _span(5, 12), _span(7, 12), "[1-9]"),
    Plan("PH", "63", "0", _span(5, 10), (8, 9, 10), "[2-9]"),
    Plan("NZ", "64", "0", _span(7, 10), _span(8, 10), "[2-9]"),
    Plan("SG", "65", "", (8,), (8,), "[3689]"),
    Plan("TH", "66", "0", (8, 9), (8, 9), "[2-9]"),
    Plan("JP", "81", "0", (9, 10), (9, 10), "[1-9]"),
    Plan("KR", "82", "0", _span(7, 10), _span(8, 10), "[1-9]"),
    Plan("VN", "84", "0", (9, 10), (9, 10), "[2-9]"),
    Plan("CN", "86", "0", (7, 8, 10, 11), (10, 11), "[1-9]"),
    Plan("TR", "90", "0", (7, 10), (10,), "[2-58]"),
    Plan("IN", "91", "0", (6, 7, 8, 10), (10,), "[1-9]"),
    Plan("PK", "92", "0", _span(5, 10), (9, 10), "[2-9]"),
    Plan("LK", "94", "0", (7, 9), (9,), "[1-9]"),
    Plan("MA", "212", "0", (9,), (9,), "[5-8]"),
    Plan("NG", "234", "0", _span(5, 10), (7, 8, 10), "[1-9]"),
    Plan("KE", "254", "0", _span(5, 10), (7, 8, 9), "[1-9]"),
    Plan("PT", "351", "", (9,), (9,), "[2-9]"),
    Plan("LU", "352", "", _span(4, 11), _span(5, 11), "[2-9]"),
    Plan("IE", "353", "0", _span(5, 10), _span(7, 9), "[1-9]"),
    Plan("IS", "354", "", (7, 9), (7, 9), "[3-9]"),
    Plan("FI", "358", "0", _span(5, 12), _span(5, 11), "[1-9]"),
    Plan("BG", "359", "0", _span(4, 9), _span(7, 9), "[2-9]"),
    Plan("LT", "370", "0", (8,), (8,), "[3-9]"),
    Plan("LV", "371", "", (8,), (8,), "[26-9]"),
    Plan("EE", "372", "", (7, 8), (7, 8), "[3-9]"),
    Plan("UA", "380", "0", (5, 6, 7, 9), (9,), "[3-9]"),
    Plan("RS", "381", "0", _span(4, 12), _span(6, 10), "[1-9]"),
    Plan("HR", "385", "0", _span(6, 9), (8, 9), "[1-9]"),
    Plan("SI", "386", "0", (7, 8), (8,), "[1-8]"),
    Plan("CZ", "420", "", (9,), (9,), "[2-9]"),
    Plan("SK", "421", "0", (6, 7, 9), (9,), "[2-9]"),
    Plan("UY", "598", "0", (7, 8), (8,), "[2-9]"),
    Plan("EC", "593", "0", (7, 8, 9), (8, 9), "[2-9]"),
    Plan("HK", "852", "", (8,), (8,), "[2-9]"),
    Plan("BD", "880", "0", _span(6, 10), _span(8, 10), "[1-9]"),
    Plan("TW", "886", "0", (7, 8, 9), (8, 9), "[2-9]"),
    Plan("SA", "966", "0", (7, 9), (9,), "[1-9]"),
    Plan("AE", "971", "0", (7, 8, 9), (8, 9), "[2-9]"),
    Plan("IL", "972", "0", (7, 8, 9), (8, 9), "[2-9]"),
]
#: Country codes of one and two digits; all others have three.
SHORT_CODES = [1, 7, 20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98]
#: Digits of a number with its country code: at most, and at least where no plan is known.
MOST, LEAST = 15, 7
#: What may stand between digits, and how much of it.
_GAP = r"[\-\u2010-\u2015\u2212\uFF0D/ \u00A0\u00AD\u200B\u2060\u3000()\uFF08\uFF09\[\].~]"
BETWEEN = _GAP + "{0,4}"
EXTENSION = r"(?:[ \t,;]{0,3}(?i:x|ext\.?|extension|#)[ :.]{0,2}[0-9]{1,7}(?![0-9]))?"

REGIONS = {p.region: p for p in PLANS}
NORTH_AMERICA = "1"
#: A date written with slashes, or a date and a time, is no number.
_NO_DATE = r"(?!(?:[0-3]?[0-9]/[01]?[0-9]|[01]?[0-9]/[0-3]?[0-9])/(?:[12][0-9])?[0-9]{2}(?![0-9]))(?![12][0-9]{3}[\-/]?[01][0-9][\-/]?[0-3][0-9] +[0-2][0-9]:[0-5][0-9])"
#: Groups of digits are taken whole: nothing but white space separates a number from other digits.
_BEGIN = r"(?<![0-9A-Za-z+\uFF0B])(?<![0-9][\-./()])" + _NO_DATE
_END = r"(?![0-9A-Za-z])(?![\-./()]{1,2}[0-9])"


def _digits(lengths: tuple[int, ...], first: str = "") -> str:
    """Runs of so many digits, the longest first; `first`: the pattern of the first ones (each written as a class or one digit)."""

    def run(low: int, high: int, done: int = 0) -> str:
        more = f"(?:{BETWEEN}[0-9])"
        return f"{more}{{{low - done},{high - done}}}" if done else f"[0-9]{more}{{{low - 1},{high - 1}}}"

    ranges: list[list[int]] = []
    for n in sorted(lengths):
        if ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    out = []
    for low, high in reversed(ranges):
        if not first:
            out.append(run(low, high))
        else:  # a look ahead, since what stands between digits may stand between these too
            out.append(f"(?={_spaced(first)}){run(low, high)}")
    return out[0] if len(out) == 1 else "(?:" + "|".join(f"{x}{_END}" for x in out) + ")"


def _spaced(first: str) -> str:
    """A pattern of digits with what may stand between them."""
    return first.replace("[0-9]{2}", "[0-9][0-9]").replace("][", f"]{BETWEEN}[")


def _trunk(plan: Plan, needed: bool = False) -> str:
    return rf"(?:\(?{plan.trunk}\)?{BETWEEN})" + ("" if needed else "?") if plan.trunk else ""


def _lengths(plan: Plan, leniency: str) -> tuple[tuple[int, ...], str]:
    return (plan.possible, "") if leniency == "POSSIBLE" else (plan.valid, plan.first)


def _codes(leniency: str) -> str:
    """A prefix tree of all country codes, by their first digit; codes without a plan are taken with the lengths that E.164 allows."""
    shared: dict[str, list[Plan]] = {}
    for plan in PLANS:
        shared.setdefault(plan.code, []).append(plan)
    branches: dict[str, list[str]] = {}
    for code, plans in shared.items():
        lengths = tuple(sorted({n for p in plans for n in _lengths(p, leniency)[0] if len(code) + n >= LEAST - 1}))
        begins = sorted({_lengths(p, leniency)[1] for p in plans} - {""})
        begin = f"(?={'|'.join(map(_spaced, begins))})" if begins else ""
        trunk = "" if code == NORTH_AMERICA else _trunk(plans[0])
        branches.setdefault(code[0], []).append(f"{code[1:]}{BETWEEN}{trunk}{begin}{_digits(lengths)}{_END}")
    known = "|".join(f"{digit}(?:{'|'.join(rest)})" for digit, rest in sorted(branches.items()))
    others = f"(?!{'|'.join(sorted(shared))})(?:{'|'.join(map(str, SHORT_CODES))}|[2-9][0-9]{{2}})(?:{BETWEEN}[0-9]){{{LEAST - 3},{MOST - 3}}}"
    return f"[+\\uFF0B]{BETWEEN}(?:{known}|{others}{_END})"


#: Breaks of North American numbers: where area code and exchange end, or only where all three parts do.
_GROUPED = {
    "STRICT_GROUPING": rf"(?=\(?[0-9]{{3}}\)?{BETWEEN}[0-9]{{3}}{BETWEEN}[0-9]{{4}}(?![0-9]))(?=[0-9(]{{3,5}}(?![0-9])|[0-9]{{10}}(?![0-9]))(?=\(?[0-9]{{3}}\)?{BETWEEN}(?:[0-9]{{3}}{_GAP}|[0-9]{{7}}(?![0-9])))",
    "EXACT_GROUPING": rf"(?=\(?[0-9]{{3}}\)?{_GAP}{{1,4}}[0-9]{{3}}{_GAP}{{1,4}}[0-9]{{4}}(?![0-9])|[0-9]{{10}}(?![0-9]))",
}


def pattern(region: str, leniency: str = "POSSIBLE", trunk_needed: bool = True) -> str:
    """The pattern of the numbers that a policy of this region finds: any with a `+`, and those written as at home.

    trunk_needed: beyond POSSIBLE, a number at home is written with the digit that its plan puts first.
    """
    plan = REGIONS[region]
    lengths, first = _lengths(plan, leniency)
    home = []
    if plan.code == NORTH_AMERICA:
        # The long-distance digit only before an area code, or written in one way throughout.
        if leniency == "POSSIBLE":
            home.append(rf"1([\-. ])(?=\(?[0-9]{{3}}\)?\1[0-9]{{3}}\1[0-9]{{4}}){_digits((10,))}")
        home.append(f"1{BETWEEN}(?=\\(?[2-9]){_digits((10,), first)}")
        home.append(_GROUPED.get(leniency, "") + _digits(lengths, first))
    else:
        home.append(_trunk(plan, trunk_needed and leniency != "POSSIBLE") + _digits(lengths, first))
    numbers = "|".join([_codes(leniency), *[f"{x}{_END}" for x in home]])
    return rf"{_BEGIN}(?:[(\[\uFF08]{BETWEEN})?(?:{numbers}){EXTENSION}"


def valid(text: Column, regions: list[str]) -> Column:
    """Whether a number found is one that some plan gives out."""
    out = F.lit(False)
    for r in regions:
        out = out | text.rlike(f"^(?:{pattern(r, 'VALID', False)})$")
    return out


def merged(found: Column, regions: list[str]) -> Column:
    """The matches of several regions without overlaps: valid numbers before possible ones, then longer, then earlier ones."""
    rated = F.transform(found, lambda m: F.struct((~valid(m["t"], regions)).alias("poor"), (-(m["e"] - m["s"])).alias("length"), m["s"].alias("s"), m.alias("m")))

    def step(kept: Column, x: Column) -> Column:
        m = x["m"]
        clash = F.exists(kept, lambda y: (m["s"] < y["e"]) & (y["s"] < m["e"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, m))

    return F.array_sort(F.aggregate(F.array_sort(rated), S.none_of(S.MATCH), step))
