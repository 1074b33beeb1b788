"""Toxicity, language, licences, repetition and the pipeline: held-out accuracy and brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import regex
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mistveil.llm import langid, licenses, repetition, toxicity
from tests.conftest import SF

SF1 = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "123 !!", "x", "é" * 10, "word " * 30000]


def odd(spark):
    return spark.createDataFrame([(9000 + i, t, None, "x", 1) for i, t in enumerate(ODD)] + [(9000, "again", "en", "x", 1)], "doc_id long, text string, lang string, score string, n_chars long")


def test_language(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    truth = docs.select("doc_id", "lang")
    held = langid.identify(docs).where("held_out").join(truth, "doc_id")
    assert held.count() > 250 and held.where("lang = lang_pred").count() >= 0.98 * held.count()
    got = langid.identify(odd(spark), docs).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r for r in got if r.doc_id != 9000}
    assert [by[9000 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[9006].lang_pred in ("en", "de", "fr", "es") and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert langid.identify(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in langid.keep_identified(docs.select("doc_id", "text", "lang").unionByName(odd(spark).select("doc_id", "text", "lang"))).collect()}
    assert not kept & {9001, 9002, 9003} and len(kept) >= 0.99 * docs.count()


def test_language_of_many_labels(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(80):  # each language has its own syllables; the last ones have the fewest documents
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(20)]
        rows += [(k * 100 + i, " ".join(rng.choice(words, 60)), f"l{k:02}") for i in range(24 if k < 64 else 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    late = [r for r in held if r.lang >= "l64"]
    assert len(late) > 50 and sum(r.lang == r.lang_pred for r in late) >= 0.95 * len(late) and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    both = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id")
    assert both.where("predicted = toxic").count() >= 0.93 * both.count()
    rows = odd(spark)
    got = toxicity.classify(rows, labels).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_learns_from_all_labels(spark):
    """Each word is in just as many labelled texts as it takes to be known, so one text left out would lose words; 5,200 texts."""
    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5][:5200]
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(i, f"{word(k // toxicity.LEAST_TEXTS)} {'bad' if k % 2 else 'good'}", "en", k % 2) for k, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"))
    buckets = [toxicity.word_buckets(word(k).encode())[0] for k in range(5200 // toxicity.LEAST_TEXTS)]
    assert all(model.row[b] > 0 for b in buckets)
    scores = model.scores([b"bad", b"good"])
    assert scores[0] > 0.5 > scores[1]
    again = toxicity.train(table.drop("toxic").union(table.drop("toxic")).repartition(7), table.select("doc_id", "toxic"))  # how rows lie, or that they lie twice, changes nothing
    assert again.offset == model.offset and again.slope == model.slope and all((a == b).all() for a, b in zip(again.responses, model.responses, strict=True))


def test_toxicity_thresholds_and_windows():
    rng = np.random.default_rng(4)
    z, clean, toxic = np.sort(rng.normal(size=60)), rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    cut = toxicity._best_cut(z, clean, toxic, 0.3)
    wrong = lambda c: 0.3 * toxic[z < c].sum() / toxic.sum() + 0.7 * clean[z >= c].sum() / clean.sum()
    assert abs(wrong(cut) - min(wrong(c) for c in [*z, z[-1] + 1])) < 1e-12
    model = toxicity._new_model(rng.normal(size=50).astype(np.float32))
    embedding, filters, *_ = toxicity._parts_of(model)
    docs = [rng.integers(0, 51, n).astype(np.int32) for n in (0, 1, 2, 40, toxicity.STEP + 5, 7)]
    top, words = toxicity._tops(embedding, filters, docs)
    for d, t, w in zip(docs, top, words, strict=True):
        x, slot = np.concatenate([d if len(d) else [0], [0, 0]]).astype(int), 0
        for width in toxicity.WIDTHS:
            v = sum(embedding[x[k : len(x) - 2 + k]] @ filters[slot + k] for k in range(width))
            columns = slice((width - 1) * toxicity.FILTERS, width * toxicity.FILTERS)
            assert np.allclose(v.max(axis=0), t[columns], atol=1e-5)
            own = w[columns, :width]
            assert np.allclose(np.einsum("fks,ksf->f", embedding[own], filters[slot : slot + width]), t[columns], atol=1e-5)
            slot += width


def plain_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_repetition(spark):
    texts = [*ODD, "a b c\na b c\n\n\nx", "one two three four five six seven eight nine ten " * 9, "<a> & |" * 40, "ends\n", " x y"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, "text", F.lit(True)).toDF("doc_id", "text", "kept"))
    rows = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for r in docs.collect():
        n, *rest = plain_counts(r.text)
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (n, *rest)
        assert got.base_failed == (n < 20 or 100 * rest[3] > 30 * n) and not (got.base_failed and got.kept)
    assert {r.doc_id for r in repetition.keep_good(docs).collect()} == {i for i, r in rows.items() if r.kept}
    assert repetition.quality_rules(docs.limit(0)).count() == 0


def test_repeated_characters():
    text = ("a1 b2 c3 d4 e5 f6 " + " ".join(f"w{i}" for i in range(30)) + " a1 b2 c3 d4 e5 f6").encode()
    m = repetition.measure(text)
    assert m[6:] == (12, 12, 0, 0, 0, 0)  # six words of two characters met before, as 5- and 6-grams


def test_licences(spark):
    cases = [
        ("Licensed under the Apache License, Version 2.0.", "apache"), ("x\nThis work is licensed under the GNU General Public License, version 3.", "gpl"), ("released under the mit license", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("All rights reserved.", "proprietary"), ("My driving license expired.", None), ("nothing", None), (None, None), ("", None), ("gnu " * 5000, None), ("Der Mit Lizenz", None),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)], "doc_id long, text string, family string")
    got = {r.doc_id: r.family for r in licenses.scan(docs).where("confirmed").collect()}
    assert got == {i: f for i, (_, f) in enumerate(cases) if f}
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs.unionByName(docs)).where("confirmed").count() == 10
    assert not re.search("Python|Pandas|Arrow", licenses.scan(docs)._jdf.queryExecution().executedPlan().toString())


GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
"""


def plain_licences(text: str) -> dict[tuple[int, str], tuple[float, bool]]:
    """(paragraph, family) to probability and whether it is confirmed, without the gate."""
    model, shapes, out = licenses.train(), licenses.templates(), {}
    for number, block in enumerate(regex.split(licenses._BLANK, text)):
        words = regex.findall("[a-z0-9]+", block.lower())
        for at in range(0, max(1, len(words) - licenses.WINDOW + licenses.STEP), licenses.STEP):
            window = words[at : at + licenses.WINDOW]
            z = np.array(model.bias)
            for gram in licenses.grams_of(window):
                z = z + np.array(model.weights.get(gram, 0.0))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = model.families[int(p.argmax())]
            if family == licenses.NONE or p.max() < 0.5:
                continue
            own = licenses.pairs_of(window)
            near = max(len(own & t) / min(len(own), len(t)) for t in (licenses.pairs_of(regex.findall("[a-z0-9]+", n.lower())) for n in shapes[family]))
            best = out.get((number, family), (0.0, 0.0))
            out[number, family] = max(best, (round(float(p.max()), 6), round(near, 6)))
    return {k: (p, near >= 0.6 and k[1] != licenses.UNKNOWN) for k, (p, near) in out.items()}


def test_licences_against_plain(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [GPL, GPL + "//\n// SPDX-License-Identifier: MIT\n", "word " * 500 + "Released under the MIT License. " + "other " * 500 + GPL, "\n\n", "a\n \nAll rights reserved.\n***\nThis is free software.", GPL * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.paragraph, r.family): (r.probability, r.confirmed) for r in licenses.scan(docs).collect()}
    want = {(i, *k): v for i, t in enumerate(texts) if t for k, v in plain_licences(t).items()}
    assert got.keys() == want.keys()
    assert {f for _, _, f in want} >= {"apache", "cc-by-nc", "gpl", "mit", "proprietary"}
    for k, (p, confirmed) in want.items():
        assert abs(got[k][0] - p) < 2e-6 and got[k][1] == confirmed, k


def test_licence_notices(spark):
    """Wrapped notices are one paragraph; tags; families told apart; notices of no known family; text that is no notice."""
    cases = [
        (GPL, {"gpl"}), ("# SPDX-License-Identifier: MIT", {"mit"}), ("SPDX-License-Identifier: GPL-2.0-only", {"gpl"}), ("Covered by the Eclipse Public License v2.0.", {"epl"}),
        ("This is free and unencumbered software released into the public domain.", {"unlicense"}), ("This module is released under the Foobar Public License, version 7.", {"unknown"}),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED', {"mit"}),
        ("The company wrote new software for the general public last year, but no copies of it were sold.", set()), ("The Apache helicopter landed in the public park.", set()),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got: dict = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    assert got == {i: f for i, (_, f) in enumerate(cases) if f}


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages(spark, extra):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    if extra:
        docs = docs.withColumn("kept", F.lit(1))
        names = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and now
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before
