"""pipeline.run against a plain version of what follows the trained stages."""

import itertools
import re

import corpus_pipeline
from mistveil.llm import langid, line_dedup, repetition
from tests.conftest import SF
from tests.llm.test_line_dedup import plain


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_run(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RARITY_CELLS", 1 << 12)
    good = repetition.keep_good(langid.keep_identified(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    gone, ordered = plain(rows)
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in gone) for n, (_, i, t) in enumerate(ordered)}
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {i for i in texts if find(i) == i}
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
