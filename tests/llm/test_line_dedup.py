"""Line dedup against a plain version: witnesses, repeated ids, shuffled joins, large groups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mistveil.llm import line_dedup, shared
from tests.conftest import SF


def token_sets(rows):
    """(row, line number) in order, with the line's words; rows: (doc_id, text), those of one doc_id by text, null ids first."""
    ordered = sorted(((i is not None, i or 0, t or ""), i, t) for i, t in rows)
    return [((n, k), i, frozenset(re.findall("[^\x20\x09-\x0d]+", x.lower()))) for n, (_, i, t) in enumerate(ordered) if t is not None for k, x in enumerate(t.split("\n"))], ordered


def plain(rows):
    """For each line that goes: its kind, and all earlier lines that it matches."""
    lines, ordered = token_sets(rows)
    lines = [(at, i, s) for at, i, s in lines if s]
    by_word, first, out = {}, {}, {}
    for n, (at, i, s) in enumerate(lines):
        near = {m for w in s for m in by_word.get(w, ())}
        close = [lines[m][:2] for m in near if 5 * len(s & lines[m][2]) >= 4 * len(s | lines[m][2])]
        if close:
            out[at] = ("repeat" if s in first else "similar", i, close)
        first.setdefault(s, at)
        for w in s:
            by_word.setdefault(w, []).append(n)
    return out, ordered


def check(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if docs is None else docs
    want, ordered = plain(rows)
    got = line_dedup.repeated_lines(docs).collect()
    assert sorted((str(r.doc_id), r.line_no, r.kind) for r in got) == sorted((str(i), at[1], kind) for at, (kind, i, _) in want.items())
    allowed = {}
    for at, (_, i, close) in want.items():
        allowed.setdefault((i, at[1]), set()).update((j, k) for (_, k), j in close)
    assert all((r.first_doc_id, r.first_line_no) in allowed[r.doc_id, r.line_no] for r in got)
    if len({i for i, _ in rows}) == len(rows):
        assert all(r.kind == "repeat" or (r.first_doc_id, r.first_line_no) == min(allowed[r.doc_id, r.line_no]) for r in got)
    left = [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in want)) for n, (_, i, t) in enumerate(ordered)]
    after = line_dedup.remove_lines(docs)
    assert after.columns == docs.columns
    assert sorted(map(repr, left)) == sorted(repr((r.doc_id, r.text)) for r in after.collect())


@pytest.fixture(autouse=True)
def small_table(monkeypatch):
    monkeypatch.setattr(line_dedup, "RARITY_CELLS", 1 << 12)


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(shared, "SMALL_ROWS", 0)


def test_repeated_ids_nulls_and_ties(spark, joins):
    rows = [
        (1, "alpha beta gamma\n\nonly once here"), (2, "hello there\nalpha beta gamma"), (2, "only here forever\ntotally unique second line"), (2, "hello there\nalpha beta gamma"),
        (None, "a null id\nalpha beta gamma"), (None, "another null id\nunlike the rest of them"), (3, None), (4, ""), (5, "\n \t\n"), (6, "Gamma  ALPHA\tbeta beta\r"), (-7, "the first of all ids\nhello there"),
        (8, "one two three four five six seven eight nine ten"), (9, "one two three four five six seven eight nine eleven"), (10, "one two three four five six seven eight nine eleven twelve"), (11, "one two three four five six seven eight nine"),
        (12, "x y z w\nx y z w v"), (12, "x y z"),
    ]
    check(spark, rows)


def test_documents(spark, joins):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_near_copies_in_a_large_group(spark):
    rng = random.Random(3)
    base = [f"word{k}" for k in range(30)]
    rows = [(i, " ".join([*rng.sample(base, 28), f"own{i}"])) for i in range(1500)] + [(2000 + i, " ".join(rng.sample(base, 20))) for i in range(200)]
    check(spark, rows)


def test_very_long_line_and_clashing_columns(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[20_000:])), (4, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("__doc", "__copy", "__gone", "at", "kind", "doc", "copy")])
    want, _ = plain(rows)
    after = line_dedup.remove_lines(docs)
    assert after.columns == docs.columns and {r.doc_id for r in after.where("text = ''").collect()} == {n + 1 for n, _ in want}
    check(spark, rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.repeated_lines(docs).count() == 0 and line_dedup.remove_lines(docs).count() == 0


def test_words_are_counted_and_coded_once_for_each_set(spark, monkeypatch):
    seen, real = [], line_dedup._rarity
    monkeypatch.setattr(line_dedup, "_rarity", lambda scratch, lines: seen.append(lines.select("hashes").collect()) or real(scratch, lines))
    rows = [(i, f"alpha beta beta gamma delta\n\n  \nGAMMA\talpha  delta beta\nown{i} line of this row") for i in range(4)]
    check(spark, rows)
    assert sorted(len(r.hashes) for r in seen[0]) == [4, 5, 5, 5, 5]
