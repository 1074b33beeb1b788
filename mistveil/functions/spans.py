"""Column expressions over spans: arrays of structs that say what was found where in a text. Offsets count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A match before it is rated: place, text, and which pattern of its detector found it.
MATCH = "struct<s:int,e:int,t:string,p:int>"
#: The contract of a span.
SPAN = (
    "struct<character_start:int,character_end:int,filter_type:string,context:string,classification:string,confidence:double,text:string,"
    "replacement:string,salt:string,ignored:boolean,applied:boolean,priority:int,pattern:string,window:array<string>,always_valid:boolean,"
    "color:string,ordinal:int,todo:string>"
)
#: Longest word that counts as context, and what a context term adds to a confidence.
LONGEST_WORD, BOOST = 64, 0.05
#: Characters on each side of a span that are read first for its context; all of them are where these hold too few words.
NEARBY = 4096


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def find(text: Column, regex: str, pattern: int) -> Column:
    """All matches of a Java regex (never of zero width) as array<MATCH>: one test where there is none, else two scans."""
    hits, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    zero = F.struct(F.lit(0).alias("at"), none_of(MATCH).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = (acc["at"] + F.length(x["gap"])).cast("int")
        e = (s + F.length(x["t"])).cast("int")
        hit = F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"), F.lit(pattern).alias("p")).cast(MATCH)
        return F.struct(e.alias("at"), F.array_append(acc["out"], hit).alias("out"))

    pairs = F.filter(F.zip_with(hits, gaps, lambda t, g: F.struct(t.alias("t"), g.alias("gap"))), lambda x: x["t"].isNotNull())
    return F.when(text.rlike(regex), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(none_of(MATCH))


def first_of_range(spans: Column) -> Column:
    """Spans whose range no earlier one has."""

    def step(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda y: (y["character_start"] == x["character_start"]) & (y["character_end"] == x["character_end"]))
        return F.when(again, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(spans, none_of(SPAN), step)


def _normal(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))


def _near(words: Column) -> Column:
    """The words that end an array, back to the last one that is too long to be read."""
    return F.aggregate(words, none_of("string"), lambda acc, x: F.when(F.length(x) > LONGEST_WORD, none_of("string")).otherwise(F.array_append(acc, x)))


def boosted(confidence: Column, text: Column, start: Column, end: Column, terms: tuple[str, ...], window: int) -> Column:
    """confidence, BOOST higher (1 at most) where a term stands among the `window` words before or after the span."""
    if not terms or window <= 0:
        return confidence
    words = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    nearest = lambda w: F.reverse(F.slice(w, F.lit(1), F.lit(window)))

    def enough(some: Column, all_read: Column, whole: Column) -> Column:  # one word more than is asked for: the last one may be cut
        return F.when(all_read | (F.size(some) > window), some).otherwise(words(whole))

    left, right = F.substring(text, F.greatest(start - NEARBY, F.lit(0)) + 1, F.least(start, F.lit(NEARBY))), F.substring(text, end + 1, F.lit(NEARBY))
    before = _near(nearest(F.reverse(enough(words(left), start <= NEARBY, F.substring(text, F.lit(1), start)))))
    after = F.reverse(_near(nearest(enough(words(right), F.length(text) - end <= NEARBY, F.substring(text, end + 1, F.length(text))))))
    side = lambda w: F.array_join(F.transform(w, _normal), " ")
    line = F.concat(F.lit(" "), side(before), F.lit(" \n "), side(after), F.lit(" "))
    phrases = [" ".join(w for w in (p.strip(".,:;!?-").lower() for p in t.split()) if w) for t in terms]
    found = line.rlike(" (?:" + "|".join(re.escape(p) for p in phrases) + ") ")
    return F.when(found, F.least(F.lit(1.0), F.round(confidence + BOOST, 6))).otherwise(confidence)


def modified(confidence: float, modifiers: tuple, text: Column, start: Column, end: Column) -> Column:
    """A pattern's confidence, set or raised by the characters next to the match; later modifiers win."""
    out = F.lit(confidence)
    before, after = F.when(start > 0, F.substring(text, start, F.lit(1))), F.when(end < F.length(text), F.substring(text, end + 1, F.lit(1)))
    for where, characters, value, added in modifiers:
        test = (lambda c, r=characters: c.rlike("(?dU)" + r)) if where == "around-regex" else (lambda c, r=characters: c == r)
        applies = {"before": test(before), "after": test(after)}.get(where, test(before) & test(after))
        out = F.when(applies, out + added if added else F.lit(value)).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if modifiers else out


def window_of(text: Column, start: Column, end: Column, size: int) -> Column:
    """The words (separated by spaces) that the span touches, and `size` words on each side."""
    words = lambda t: F.filter(F.split(t, " "), lambda x: x != "")
    # whole words that the span touches reach to the next space on either side
    head, tail = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    own_before, own_after = F.regexp_extract(head, r"[^ ]*$", 0), F.regexp_extract(tail, r"^[^ ]*", 0)
    before = words(F.substring(head, F.lit(1), F.length(head) - F.length(own_before)))
    after = words(F.substring(tail, F.length(own_after) + 1, F.length(tail)))
    own = words(F.concat(own_before, F.substring(text, start + 1, end - start), own_after))
    return F.concat(F.slice(before, F.greatest(F.size(before) - size + 1, F.lit(1)), F.lit(size)), own, F.slice(after, F.lit(1), F.lit(size)))


def trimmed(spans: Column, newlines: bool = True, periods: bool = True, spaces: bool = True) -> Column:
    """Spans without trailing line breaks, then periods, then spaces; what becomes empty goes. Replacements stay as they are."""
    cuts = [ends for on, ends in ((newlines, r"\r\n"), (periods, r"\."), (spaces, " ")) if on]
    if not cuts:
        return spans

    def cut(x: Column) -> Column:
        short = x["text"]
        for ends in cuts:
            short = F.regexp_replace(short, rf"[{ends}]+\z", "")
        end = (x["character_end"] - F.length(x["text"]) + F.length(short)).cast("int")
        # most spans end otherwise, and stay as they are
        return F.when(x["text"].rlike(rf"[{''.join(cuts)}]\z"), x.withField("text", short).withField("character_end", end)).otherwise(x)

    return F.filter(F.transform(spans, cut), lambda x: x["character_end"] > x["character_start"])


def _earlier(a: Column, b: Column) -> Column:
    """Order of overlap resolution: longer, more confident, higher priority, then first; ties by detection order."""
    length = lambda x: x["character_end"] - x["character_start"]
    keys = [(length(b), length(a)), (b["confidence"], a["confidence"]), (b["priority"], a["priority"]), (a["character_start"], b["character_start"]), (a["ordinal"], b["ordinal"])]
    out = F.lit(0)
    for x, y in reversed(keys):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def resolved(spans: Column, held: bool = False) -> Column:
    """Greedy choice of spans that don't overlap; the result is in order of the text.

    held: spans are a column or a variable, not an expression that would be computed for each use; one span alone is then left as it is.
    """
    ranked = F.array_sort(spans, _earlier)

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (x["character_start"] < y["character_end"]) & (y["character_start"] < x["character_end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate(ranked, none_of(SPAN), step)
    in_order = F.array_sort(kept, lambda a, b: F.when(a["character_start"] < b["character_start"], -1).when(a["character_start"] > b["character_start"], 1).otherwise(0))
    return F.when(F.size(spans) < 2, spans).otherwise(in_order) if held else in_order


def replaced(text: Column, spans: Column) -> Column:
    """The text with the replacement of each span (in order, without overlaps) in its place."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["character_start"] - acc["at"])
        return F.struct(x["character_end"].alias("at"), F.concat(acc["out"], gap, F.coalesce(x["replacement"], F.lit(""))).alias("out"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def steps(text: Column, spans: Column) -> Column:
    """For each span the text after its replacement, with the SHA-256 of that text: array<struct<hash, span, text>>.

    Each text is made from the one before it.
    """
    step_type = f"struct<hash:string,span:{SPAN},text:string>"
    zero = F.struct(F.lit(0).alias("shift"), text.alias("text"), none_of(step_type).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        value = F.coalesce(x["replacement"], F.lit(""))
        start, end = x["character_start"] + acc["shift"], x["character_end"] + acc["shift"]
        now = F.concat(F.substring(acc["text"], F.lit(1), start), value, F.substring(acc["text"], end + 1, F.length(acc["text"])))
        moved = (acc["shift"] + F.length(value) - (x["character_end"] - x["character_start"])).cast("int")
        # the text is read from a one-element array, so that it is made once
        return F.get(F.transform(F.array(now), lambda t: F.struct(moved.alias("shift"), t.alias("text"), F.array_append(acc["out"], F.struct(F.sha2(t, 256).alias("hash"), x.alias("span"), t.alias("text")).cast(step_type)).alias("out"))), F.lit(0))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda acc: acc["out"])).otherwise(none_of(step_type))


def shifted(spans: Column, offset: Column, start: str = "character_start", end: str = "character_end") -> Column:
    return F.transform(spans, lambda x: x.withField(start, (x[start] + offset).cast("int")).withField(end, (x[end] + offset).cast("int")))


def same_range(spans: Column, span: Column) -> Column:
    """Spans of the same range and confidence and another type."""
    return F.filter(spans, lambda x: (x["character_start"] == span["character_start"]) & (x["character_end"] == span["character_end"]) & (x["confidence"] == span["confidence"]) & (x["filter_type"] != span["filter_type"]))


def starts_at(spans: Column, index: Column) -> Column:
    """The first span that starts at an index, or null."""
    return F.get(F.filter(spans, lambda x: x["character_start"] == index), F.lit(0))


def adjacent(text: Column, left: Column, right: Column) -> Column:
    """Whether only white space, or a comma, lies between two spans."""
    return F.substring(text, left["character_end"] + 1, right["character_start"] - left["character_end"]).rlike(r"(?U)^\s*,?\s*$")


def token_count(text: Column) -> Column:
    """Pieces between runs of white space; an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"(?U)\s+", -1))).cast("long")


def utf16_offset(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 units."""
    head = F.substring(text, F.lit(1), offset)
    return (offset + F.length(head) - F.length(F.regexp_replace(head, r"[\x{10000}-\x{10FFFF}]", ""))).cast("int")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df with a column computed once for each row, whatever uses it: a generator of one row keeps the optimizer from moving
    the expression, or a Python kernel, into the expressions above it."""
    return df.select(*[F.explode(F.array(F.col(c))).alias(c) if c == name else F.col(c) for c in df.columns])
