"""A grammar of ages in English text, from which the patterns of the age detector are generated.

An age is a number next to a unit (`47 years old`, `forty-seven yo`) or after a keyword (`aged 3, 5 and 7`). With a unit any number is
an age; after a keyword only one of 0 to 125, and no number that goes on as a date or as a larger number.
"""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------------------------------------
SMALL = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
LARGE = ["hundred", "thousand", "million", "billion"]
UNITS = ["year", "years", "yrs", "yr", "yo"]
OLDEST = 125


def _any(*options: str) -> str:
    return f"(?:{'|'.join(options)})"


def _words(values: list[str]) -> str:
    return _any(*sorted(values, key=len, reverse=True))


def spelled(low: int, high: int) -> list[str]:
    """Patterns of the numbers from low to high in words, longer wordings before those they begin with."""
    if high >= 100:
        hundred, link = r"(?:one|a)\s+hundred", r"(?:\s+and)?\s+"
        return [f"{hundred}{link}{_any(*spelled(1, high - 100))}", *([hundred] if low <= 100 else []), *spelled(low, 99)]
    full = [t for i, t in enumerate(TENS) if (i + 2) * 10 + 9 <= high]
    out = [rf"{_words(full)}[-\s]+{_words(SMALL[1:10])}"] if full else []
    if high >= 20 and high % 10 != 9:
        out.append(rf"{TENS[high // 10 - 2]}[-\s]+{_words(SMALL[1 : high % 10 + 1])}" if high % 10 else TENS[high // 10 - 2])
    tens = [t for i, t in enumerate(TENS) if (i + 2) * 10 <= high]
    return [*out, *([_words(tens)] if tens else []), _words(SMALL[low : min(high, 19) + 1])]


def _numeral(most: int) -> str:
    """Whole numbers up to most, of three digits, with up to two zeros before them and decimals after."""
    h, t, u = most // 100, most // 10 % 10, most % 10
    return rf"(?:0{{0,2}}(?:{h}[0-{t - 1}][0-9]|{h}{t}[0-{u}]|[1-9]?[0-9])(?:\.[0-9]+)?)"


NUMBER = _numeral(OLDEST)


def _listed(*joins: str) -> str:
    """A number, and more of them after any of the joins."""
    return rf"{NUMBER}(?:{_any(*joins)}{NUMBER})*"


_DASH, _TO, _COMMA, _WORD = r"\s*-\s*", r"\s+to\s+", r"\s*,\s*", r",?\s+(?:and|or|to)\s+"
#: `3, 5 and 7`: commas count once a dash or a word closes the list.
_CLOSED = rf"{NUMBER}(?:(?:{_COMMA}{NUMBER})*(?:{_DASH}|{_WORD}){NUMBER})*"
_COLON = r"\s*(?:[:=-]\s*)?"
#: Not within a date.
_NO_DATE = "(?![-/][0-9])"
#: Not the beginning of a larger number in words.
_NO_MORE = rf"(?![\s-]+(?:and\s+)?(?:{'|'.join([*LARGE, *TENS, *reversed(SMALL)])})\b)"


def patterns() -> list[str]:
    """The forms of an age, without regard to case."""
    unit = _any(*UNITS)
    return [
        rf"\b[0-9.]+\s*{unit}\.?\s*(?:old)?\b",
        rf"\bage(?:\s+of)?{_COLON}{NUMBER}(?:(?:{_DASH}|{_TO}){NUMBER})?\b{_NO_DATE}",
        rf"\baged{_COLON}{_CLOSED}\b{_NO_DATE}",
        rf"\bages(?:\s+of)?{_COLON}{_listed(_COMMA, _DASH, _WORD)}\b{_NO_DATE}",
        rf"\bage[ds]?(?:\s+of)?(?:\s*[:=-]\s*|\s+)(?:between|from)\s+{_CLOSED}\b{_NO_DATE}",
        rf"\b[0-9.]+-*{unit}\.?-*(?:old)?\b",
        r"\b[0-9]{1,3} y/o\b",
        rf"\b{_any(*spelled(0, 199))}[\s-]+(?:{unit}|y/o)\.?(?:[\s-]+old)?\b",
        rf"\b(?:age(?:\s+of\b)?|aged){_COLON}\b{_any(*spelled(0, OLDEST))}\b{_NO_MORE}{_NO_DATE}",
    ]
