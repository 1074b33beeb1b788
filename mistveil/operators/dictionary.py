"""Dictionaries as tables: exact and fuzzy term matching by joins, for lists that are too large for a plan or a kernel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import word_spans


def _normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


#: Terms up to which their first words are sent to the tasks, so that only n-grams that may be terms are made.
FEW_TERMS = 100_000


def word_ngrams(df: DataFrame, most: int, key: str = "doc_id", text: str = "text", first_words: frozenset[str] | None = None) -> DataFrame:
    """key, n, character_start, character_end, ngram: all runs of 1 to `most` words, with what lies between them.

    first_words (lower case): only runs that begin with one of them, as it is or without marks at its ends, or with marks alone.
    """
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *(T.StructField(n, T.IntegerType()) for n in ("n", "character_start", "character_end")), T.StructField("ngram", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        lead, tail = regex.compile(r"^[^\p{L}\p{Nd}]+"), regex.compile(r"[^\p{L}\p{Nd}]+$")
        may: dict[str, bool] = {}

        def begins(word: str) -> bool:
            if word not in may:
                if len(may) > 1_000_000:
                    may.clear()
                low = word.lower()
                bare = lead.sub("", low)
                may[word] = not bare or not first_words.isdisjoint((low, bare, tail.sub("", bare)))
            return may[word]

        for rows in batches:
            out: list[tuple] = []
            for k, t in zip(rows.iloc[:, 0], rows.iloc[:, 1], strict=True):
                words = word_spans(t) if t else []
                starts = range(len(words)) if first_words is None else [i for i, (s, e) in enumerate(words) if begins(t[s:e])]
                out += [(k, n, words[i][0], words[i + n - 1][1], t[words[i][0] : words[i + n - 1][1]]) for n in range(1, most + 1) for i in starts if i + n <= len(words)]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=schema.names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return df.select(key, text).mapInPandas(run, schema).withColumnRenamed("key", key)


def exact_matches(df: DataFrame, terms: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, character_start, character_end, text, term: n-grams that are terms (column `term`), as they are or without marks at their ends.

    An equi-join on the normal form: the optimizer broadcasts small lists and shuffles large ones; n-grams without a match never
    leave their task where the list is broadcast. Of up to FEW_TERMS terms, the first words decide which n-grams are made at all.
    """
    begin = [r[0] for r in terms.select(F.split(_normal(F.col("term")), " ")[0]).limit(FEW_TERMS + 1).collect()]
    grams = word_ngrams(df, most, key, text, frozenset(x for x in begin if x is not None) if len(begin) <= FEW_TERMS else None)
    lead = F.regexp_extract("ngram", r"(?U)^[^\p{L}\p{Nd}]*", 0)
    bare = F.regexp_extract("ngram", r"(?Us)^[^\p{L}\p{Nd}]*(.*?)[^\p{L}\p{Nd}]*$", 1)
    one = lambda skipped, form: F.struct(skipped.alias("lead"), form.alias("form"))
    both = F.explode(F.array(one(F.lit(0), F.col("ngram")), one(F.length(lead), bare)))
    forms = grams.select(key, "character_start", both.alias("f")).select(key, "character_start", "f.lead", "f.form").where("form <> ''")
    known = terms.select(F.col("term"), _normal(F.col("term")).alias("__term")).dropDuplicates(["__term"])
    hits = forms.join(known, _normal(F.col("form")) == F.col("__term"))
    start = F.col("character_start") + F.col("lead")
    found = hits.select(key, start.alias("character_start"), (start + F.length("form")).alias("character_end"), F.col("form").alias("text"), "term")
    return found.dropDuplicates([key, "character_start", "character_end"])


def fuzzy_matches(df: DataFrame, terms: DataFrame, distance: int, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """key, character_start, character_end, text, term, distance: n-grams within an edit distance of a term of as many words.

    Candidates share one of distance + 1 parts of the term (a string within d edits keeps one of d + 1 parts, moved by at most d
    characters), so the join is an equi-join on parts and never compares every n-gram with every term.
    """
    grams = word_ngrams(df, most, key, text).where("length(ngram) > 2").withColumn("form", _normal(F.col("ngram")))
    known = terms.select("term", _normal(F.col("term")).alias("__term")).dropDuplicates(["__term"]).withColumn("__n", F.size(F.split("__term", " ")))
    parts = distance + 1
    size = F.greatest(F.lit(1), F.floor(F.length("__term") / parts)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((i * size).cast("int").alias("at"), F.when(i < parts - 1, F.substring("__term", i * size + 1, size)).otherwise(F.substring("__term", i * size + 1, F.length("__term"))).alias("part")))
    pieces = known.select("term", "__term", "__n", F.explode(cut).alias("c")).select("term", "__term", "__n", "c.at", "c.part", F.length("c.part").alias("len"))
    shapes = pieces.select("__n", F.length("__term").alias("tl"), "at", "len").distinct()
    # places at which a part of a term of this shape may stand in an n-gram of this length
    spread = grams.join(F.broadcast(shapes), (F.col("n") == F.col("__n")) & (F.abs(F.length("form") - F.col("tl")) <= distance))
    windows = spread.select(key, "character_start", "character_end", "ngram", "form", "n", "tl", "at", "len", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - distance), F.col("at") + distance)).alias("p"))
    probes = windows.select(key, "character_start", "character_end", "ngram", "form", F.col("n").alias("n2"), F.col("tl").alias("tl2"), F.col("at").alias("at2"), F.expr("substring(form, p + 1, len)").alias("piece")).distinct()
    hits = probes.join(pieces, (F.col("piece") == F.col("part")) & (F.col("n2") == F.col("__n")) & (F.col("at2") == F.col("at")) & (F.col("tl2") == F.length("__term")))
    d = F.levenshtein(F.col("form"), F.col("__term"), distance)
    found = hits.select(key, "character_start", "character_end", F.col("ngram").alias("text"), "term", d.alias("distance")).where("distance >= 0")
    return found.distinct()


def map_tokens(spans: DataFrame, mapping: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """spans with the replacement that a mapping table (token, replacement) gives their text, where it has one."""
    fold = (lambda c: c) if case_sensitive else F.lower
    table = mapping.select(fold(F.col("token")).alias("__token"), F.col("replacement").alias("__value")).dropDuplicates(["__token"])
    return spans.join(table, fold(F.col("text")) == F.col("__token"), "left").withColumn("replacement", F.coalesce("__value", "replacement")).drop("__token", "__value")


def without_terms(spans: DataFrame, ignored: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """spans whose text isn't a term of the table `ignored` (column term)."""
    fold = (lambda c: c) if case_sensitive else F.lower
    return spans.join(ignored.select(fold(F.col("term")).alias("__term")).distinct(), fold(F.col("text")) == F.col("__term"), "left_anti")


def known_zips(spans: DataFrame, census: DataFrame) -> DataFrame:
    """spans whose first five characters are a code of the census table (column zip)."""
    return spans.join(census.select(F.col("zip").alias("__zip")).distinct(), F.substring("text", 1, 5) == F.col("__zip"), "left_semi")
