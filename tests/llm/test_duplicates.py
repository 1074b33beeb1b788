"""Near-duplicates of embeddings, lines and fingerprints against brute force."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from mistveil.llm import line_dedup, near_copies, rp_forest, simhash
from mistveil.llm.components import components
from tests.conftest import SF


def groups(ids, links):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 100), (90, 100), (50, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[300:600] = x[0] + rng.normal(size=(300, 16)) * 0.05  # a dense group
    x[600:700] = x[200:300] + rng.normal(size=(100, 16)) * 0.1
    x[700:760] = x[1]  # copies
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None] * 8), (1005, [float("inf")] * 16), (1006, rows[1][1][:8]), (1, rows[1][1])]
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, component_id string")


def test_rp_forest(spark, vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    component = groups({i for i, _ in rows}, links)
    got = rp_forest.near_duplicates(vectors, leaf=64).collect()
    assert len(got) == len(rows)
    true = {}
    for (i, _), n in zip(good, near.sum(axis=1), strict=True):
        true.setdefault(i, int(n))
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= true.get(r.vec_id, 0) for r in got) and found >= 0.95 * near.sum()
    assert np.mean([component[r.vec_id] == r.component_id for r in got]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert rp_forest.near_duplicates(vectors.limit(0)).count() == 0


def test_rp_forest_compares_large_leaves_in_blocks(spark, vectors, monkeypatch):
    whole = {(r.vec_id, r.n_links, r.component_id) for r in rp_forest.near_duplicates(vectors, leaf=2000, trees=2).collect()}
    monkeypatch.setattr(rp_forest, "BLOCK", 100)
    assert {(r.vec_id, r.n_links, r.component_id) for r in rp_forest.near_duplicates(vectors, leaf=2000, trees=2).collect()} == whole


def test_rp_forest_splits_large_leaves_again(spark, monkeypatch):
    """Leaves that the first sample leaves large are split by samples of their own, and hard pairs still meet; a dense group stays."""
    monkeypatch.setattr(rp_forest, "BLOCK", 128)
    rng = np.random.default_rng(4)
    x = rp_forest._unit(list(rng.normal(size=(4000, 24))))
    x[3600:] = rp_forest._unit(list(x[0] + 0.01 * rng.normal(size=(400, 24))))
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>")
    before = rp_forest.fit(x[:256], 4000, leaf=2000)
    forest = rp_forest.grown(x[:256], classes, 4000, rp_forest.TREES, 2000, rp_forest.SPILL, rp_forest.COSINE)
    assert max(np.bincount(t.route(x)[1]).max() for t in before) > 1000
    for t in forest:
        rows, leaves = t.route(x)
        assert set(rows) == set(range(4000))  # every vector is in a leaf
        numbers, sizes = np.unique(leaves[rows < 3600], return_counts=True)
        assert sizes.max() <= 400
    assert len({int(n) for t in forest for n in t.leaf if n >= 0}) == sum(int((t.leaf >= 0).sum()) for t in forest)
    a, b = rp_forest.hard_pairs(x[:256], 0.9)
    assert np.logical_or.reduce([rp_forest.meeting(t, a, b) for t in forest]).mean() >= 0.99


@pytest.mark.parametrize("common", [0.0, 0.7])
def test_rp_forest_is_deep_and_meets_in_a_cone(common):
    rng = np.random.default_rng(8)
    mean = np.eye(64)[0] * np.sqrt(common)

    def cone(e):
        v = mean + np.sqrt(1 - common) * e / np.linalg.norm(e, axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    e = rng.normal(size=(4000, 64))
    own = (0.91 - common) / (1 - common)  # cosine of the parts beside the mean
    pairs = cone(e), cone(own * e + np.sqrt(1 - own * own) * rng.normal(size=e.shape))
    near = (pairs[0] * pairs[1]).sum(axis=1)
    near = (near >= 0.9) & (near <= 0.92)
    forest = rp_forest.fit(cone(rng.normal(size=(1024, 64))), 1_000_000)
    met = np.any([rp_forest.meeting(t, pairs[0][near], pairs[1][near]) for t in forest], axis=0)
    first = np.any([rp_forest.meeting(t, pairs[0][near], pairs[1][near]) for t in forest[: rp_forest.TREES]], axis=0)
    print("common", common, "pairs", near.sum(), "trees", len(forest), "meet", met.mean(), "of ten trees", first.mean())
    assert near.sum() > 100 and met.mean() >= 0.99


def plain_print(text):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(5000, None, "x"), (5001, "", "x"), (5002, " \n", "x"), (5003, "one TWO", "x"), (5004, "ÀB c d", "x"), (5005, "one two", "x"), (5005, "one two", "x")], "doc_id long, text string, source string")
    rows = [(r.doc_id, r.text) for r in docs.unionByName(odd).collect()]
    prints = {i: plain_print(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = groups(prints, links)
    got = simhash.near_duplicates(docs.unionByName(odd)).collect()
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == expected[r.doc_id] for r in got)
    assert {r.doc_id for r in simhash.deduplicate(docs.unionByName(odd)).collect()} == set(expected.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(odd, distance=5)


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_of_the_pipeline(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "one TWO", "one two", "one two three"]
    for _ in range(40):
        w = [f"w{k}" for k in rng.integers(0, 4000, 150)]
        texts.append(" ".join(w))
        for edits in (1, 2, 3, 4, 6, 9):  # 5-word Jaccard from 0.93 to 0.5
            v = list(w)
            for at in rng.integers(0, 150, edits):
                v[at] = f"x{rng.integers(0, 10**6)}"
            texts.append("\n".join(" ".join(v[i : i + 11]) for i in range(0, 150, 11)))
    sets = [plain_shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if not (sets[a] or sets[b]) or (sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    expected = groups(range(len(texts)), links)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, own string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(expected.values())
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == expected
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def plain_lines(rows):
    lines = [(i, k, frozenset(re.findall("[^\x20\x09-\x0d]+", x.lower()))) for i, t in sorted(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    out, first = {}, {}
    for n, (i, k, s) in enumerate(lines):
        if s in first:
            out[i, k] = ("repeat", *first[s])
            continue
        first[s] = (i, k)
        close = [x[:2] for x in lines[:n] if x[2] != s and 5 * len(s & x[2]) >= 4 * len(s | x[2])]
        if close:
            out[i, k] = ("similar", *min(close))
    return out


def test_lines(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"{a}\n\nshort one\n{a} lambda"), (2, f"{a.upper()}\nshort\tone\nnew"), (3, None), (4, ""), (5, "x " * 3000 + "\nnew\n" + a.replace("beta", "b2")), (6, "one two three four\none two three four five"), (7, a + " lambda mu")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, line_no string, n int")
    got = {(r.doc_id, r.line_no): (r.kind, r.first_doc_id, r.first_line_no) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == plain_lines(rows)
    texts = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert texts[2] == "new" and texts[1] == f"{a}\n\nshort one" and texts[3] is None and texts[4] == "" and len(texts) == len(rows)
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_lines_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = spark.createDataFrame(docs.select("doc_id", "text").collect(), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.kind, r.first_doc_id, r.first_line_no) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == plain_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_native_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_dedup.remove_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
