"""Splitting of long texts into pieces with their offsets, and detection piece by piece."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S

PIECE = "struct<text:string,offset:int>"


#: What lines lose at their ends: what Java's trim takes off, and what SQL's does (category Zs).
CONTROLS = "".join(map(chr, range(33)))
SEPARATORS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def newline(text: str, returns: bool = True, ends: str = CONTROLS) -> list[str]:
    """Lines without `ends` around them, empty ones left out. returns: whether a carriage return breaks a line too."""
    if returns:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [x for x in (line.strip(ends) for line in text.split("\n")) if x]


def width(text: str, threshold: int) -> list[str]:
    """Lines of at most `threshold` characters, broken at spaces; a longer word is a line of its own."""
    out, line = [], ""
    for word in text.split(" "):
        if line and len(line) + 1 + len(word) > threshold:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [x for x in [*out, line] if x.strip()]


def characters(text: str, threshold: int) -> list[str]:
    """Sentences (ending in . ? or !) packed up to `threshold` characters."""
    import regex

    out, piece = [], ""
    for sentence in regex.split(r"(?<=[.?!])\s", text):
        if piece and len(piece) + 1 + len(sentence) > threshold:
            out.append(piece)
            piece = sentence
        else:
            piece = f"{piece} {sentence}" if piece else sentence
    return [x for x in [*out, piece] if x.strip()]


def located(text: str, pieces: list[str], overlap: int = 0) -> list[tuple[str, int]] | None:
    """Pieces with their places in the text, each led by up to `overlap` characters before it; None where one isn't in it as it is."""
    out, at = [], 0
    for p in pieces:
        s = text.find(p, at)
        if s < 0:
            return None
        first = max(0, s - overlap)
        out.append((text[first : s + len(p)], first))
        at = s + len(p)
    return out


def pieces_of(text: Column, method: str, threshold: int, overlap: int, **lines) -> Column:
    """array<PIECE> of a text; texts up to the threshold, and those whose pieces can't be placed, are one piece; blank ones beyond it have none.

    lines: how `newline` finds its lines.
    """
    if method not in ("newline", "width", "characters", "character"):
        raise ValueError(f"unknown splitting method '{method}'")

    @F.pandas_udf(f"array<{PIECE}>")
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append([])
                continue
            found = None
            if len(t) >= threshold:
                own = newline(t, **lines) if method == "newline" else width(t, threshold) if method == "width" else characters(t, threshold)
                found = located(t, own, overlap)
            out.append([{"text": p, "offset": o} for p, o in ([(t, 0)] if found is None else found)])
        return pd.Series(out)

    return split(text)


def detect_in_pieces(redactor, df: DataFrame, text: str, context, method: str, threshold: int, overlap: int, windows: bool) -> DataFrame:
    """df with `spans` found in the pieces of each text, at their places in it, and `regex_timeouts`.

    Pieces stay an array of their row, so spans can't meet another row's text, however often the plan is computed.
    """
    df = S.settled(df.withColumn("__pieces", F.coalesce(pieces_of(F.col(text), method, threshold, overlap), S.none_of(PIECE))), "__pieces")
    found = redactor.detect_each(df, "__pieces", context, windows)
    moved = F.transform("__found", lambda spans, i: S.shifted(spans, F.get("__pieces", i)["offset"]))
    by_filter = F.array_sort(F.flatten(moved), lambda x, y: x["ordinal"] - y["ordinal"])  # spans of one filter stay in the order of the pieces
    out = found.withColumn("spans", S.first_of_range(by_filter)).withColumn("__row", F.xxhash64(F.lit(redactor.seed), F.col(text)))
    return out.drop("__pieces", "__found")


def combine(pieces: DataFrame, key: str, piece: str = "piece", text: str = "filtered_text", separator: str = "\n") -> DataFrame:
    """Results of pieces as one for each key: texts joined in order, spans moved to their places, tokens added up."""
    ordered = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(piece).alias("piece"), F.col(text).alias("text"), F.col("tokens").alias("tokens"), F.to_json("spans").alias("spans")))).alias("all"))
    zero = F.struct(F.lit(0).alias("at"), S.none_of(S.SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = S.shifted(F.from_json(x["spans"], f"array<{S.SPAN}>"), acc["at"])
        return F.struct((acc["at"] + F.length(x["text"]) + len(separator)).cast("int").alias("at"), F.concat(acc["out"], own).alias("out"))

    return ordered.select(
        key, F.trim(F.array_join(F.transform("all", lambda x: x["text"]), separator)).alias(text), F.aggregate("all", zero, step, lambda a: a["out"]).alias("spans"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )
