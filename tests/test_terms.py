"""Term lists as a trie, against n-grams looked up one by one."""

import random

import pytest
from pyspark.sql import functions as F

from mistveil.functions import strategies
from mistveil.operators import dictionary, kernel
from mistveil.operators.terms import TermTrie, normal
from mistveil.plans.policy import Policy
from mistveil.plans.redactor import Redactor, Resources, redact


def plain(terms, text):
    known, most = {normal(t) for t in terms}, max((len(t.split()) for t in terms), default=0)
    words, out = kernel.word_spans(text), set()
    for n in range(1, most + 1):
        for i in range(len(words) - n + 1):
            s, e = words[i][0], words[i + n - 1][1]
            a, b = s, e
            while a < b and not text[a].isalnum():
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if normal(text[s:e]) in known:
                out.add((s, e))
            elif normal(text[a:b]) in known:
                out.add((a, b))
    return out


def test_against_n_grams():
    rng = random.Random(1)
    words = ["New", "york", "City", "&", "st.", "O'Neil", "İzmir", "ΟΔΟΣ", "x", "(x)", "--", "straße", "a1", "日本"]
    for _ in range(400):
        terms = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        texts = ["".join(rng.choice(["", "(", "-"]) + rng.choice(words) + rng.choice(["", ",", ").", "!"]) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randint(0, 15))) for _ in range(3)]
        got = TermTrie.of(terms).search(texts)
        assert [{(x["s"], x["e"]) for x in own} for own in got] == [plain(terms, t) for t in texts], (terms, texts)
        assert all(x["t"] == t[x["s"] : x["e"]] for own, t in zip(got, texts, strict=True) for x in own)


def test_marks_alone_and_capitals_by_place():
    """A word of marks alone isn't left out of a term; capitals whose lower case hangs on their place, or is longer than they are."""
    for terms, text in ((["a --", "b"], "(a -- b, -- (b)"), (["οδος", "ΟΔΟΣ ab", "i̇x"], "(ΟΔΟΣ) ΟΔΟΣ ab, İx."), (["x"], "\u3000x\x1fx\u200bx"), (["𐐨 日"], "(𐐀 日)!")):
        found = TermTrie.of(terms).search([text, "", text])
        assert {(x["s"], x["e"]) for x in found[0]} == plain(terms, text) and found[0] == found[2] and found[1] == []


def test_matches_as_a_column():
    texts = ["(Ann) met ann b.", None, "", "no one", "b 12, ann"]
    searches = [kernel.TermSearch("t", ["ann", "ann b"]), kernel.PatternSearch("p", r"\d+"), kernel.TermSearch("u", ["b"])]
    assert kernel._column(texts, searches).to_pylist() == kernel._searched(texts, searches)
    assert kernel._column(texts, searches[:1]).to_pylist() == kernel._searched(texts, searches[:1]) and len(kernel._column([], searches)) == 0


def test_long_list(spark):
    """300,000 terms: found as by the join, and neither the plan nor what a task is sent grows with them."""
    terms = [f"name{i} of{i % 7}" if i % 2 else f"Word{i}" for i in range(300_000)]
    policy = Policy({"identifiers": {"dictionaries": [{"terms": terms}], "city": {}}})
    rows = spark.createDataFrame([(i, f"(Word{i * 2}) met name{i * 2 + 1}  of{(i * 2 + 1) % 7}, and name{i} of9; word{i * 2 + 1}") for i in range(500)] + [(500, None), (501, "")], "doc_id long, text string")
    redactor = Redactor(policy, Resources(terms={"city": ["word8"]}))
    found = redactor.redact(rows)
    got = {(r.doc_id, r.x.character_start, r.x.character_end) for r in found.select("doc_id", F.explode("spans").alias("x")).collect()}
    joined = dictionary.exact_matches(rows, spark.createDataFrame([(t,) for t in terms], "term string"), 2)
    assert got == {(r.doc_id, r.character_start, r.character_end) for r in joined.collect()} and len(got) == 1000
    search = next(f.search for f in redactor.filters if f.key == "dictionaries")
    assert search._sent is not None and search.__getstate__()["terms"] is None


def test_empty_lists(spark):
    assert TermTrie.of([]).search(["a b", ""]) == [[], []] and TermTrie.of(["", "  "]).search(["a"]) == [[]]
    assert redact(spark.createDataFrame([("Zoe",)], "text string"), Policy({"identifiers": {"dictionaries": [{"terms": []}]}})).first().filtered_text == "Zoe"


def test_lists_too_long_for_a_plan_are_errors(spark):
    many = [str(i) for i in range(strategies.LITERALS + 1)]
    rows = spark.createDataFrame([("a",)], "text string")
    for data, resources in (
        ({"identifiers": {"age": {}}, "ignored": [{"terms": many}]}, None), ({"identifiers": {"age": {"ignored": many}}}, None),
        ({"identifiers": {"age": {"ageFilterStrategies": [{"strategy": "MAP_REPLACE", "mappings": dict.fromkeys(many, "x")}]}}}, None), ({"identifiers": {"zipCode": {"validate": True}}}, Resources(zips=dict.fromkeys(many, 1))),
    ):
        with pytest.raises(ValueError, match="too many for a plan"):
            redact(rows, Policy(data), resources=resources)
