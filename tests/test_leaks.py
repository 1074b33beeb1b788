"""Nothing stays in clear, or lands in another row, without an error."""

import base64
import hashlib
import hmac
import re
import time

import pytest
from pyspark.sql import functions as F

from mistveil.operators import dictionary, kernel, tables
from mistveil.operators.context import ContextTable
from mistveil.plans.policy import Policy
from mistveil.plans.redactor import Redactor, Resources, redact
from tests.conftest import SF

EMAIL = re.compile(r"\b[A-Za-z0-9!#$%&'*+/=?^_`{|}~.\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")


def test_pieces_stay_in_their_row(spark):
    policy = Policy({"identifiers": {"emailAddress": {}, "identifiers": [{"pattern": r"zz\d+"}]}, "config": {"splitting": {"enabled": True, "threshold": 200, "method": "newline", "overlap": 64}}})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "a@b.com\n" * 60 + "zz12"), (-1, None), (-2, "")], "doc_id long, text string")).repartition(7)
    out = redact(docs, policy)
    assert not re.search("Join|Exchange hashpartitioning", out._jdf.queryExecution().executedPlan().toString())
    want = {(r.doc_id, None if r.text is None else re.sub(r"zz\d+", "{{{REDACTED-identifier}}}", EMAIL.sub("{{{REDACTED-email-address}}}", r.text))) for r in docs.collect()}
    assert {(r.doc_id, r.filtered_text) for r in out.select("doc_id", "filtered_text").collect()} == want


def test_cells_stay_in_their_row(spark):
    rows = [(i, f"mail u{i}@x.org", f"u{i}@y.org" if i % 3 else None, i * 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, note string, mail string, n int").repartition(7)
    got = tables.redact_columns(df, Policy({"identifiers": {"emailAddress": {}}}), ["note", "mail"], ["n"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    mark = "{{{REDACTED-email-address}}}"
    assert sorted((r.id, r.note, r.mail, r.n) for r in got.collect()) == [(i, f"mail {mark}", mark if i % 3 else None, tables.FULL) for i in range(200)]


def test_replacements_of_a_context(spark):
    policy = Policy({"identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": "RANDOM_REPLACE", "replacementScope": "CONTEXT"}]}}})
    docs = spark.createDataFrame([(i, f"{'x' * i} 123-45-6789 and 123-45-6789", "a" if i < 3 else "b") for i in range(6)], "doc_id long, text string, c string")
    secret = "a secret of the tests"
    rows = redact(docs, policy, context=F.col("c"), secret=secret).collect()
    values = {c: {s.replacement for r in rows if r.c == c for s in r.spans} for c in "ab"}
    assert all(len(v) == 1 for v in values.values()) and values["a"] != values["b"]
    cells = tables.redact_columns(docs.select("doc_id", "text"), policy, ["text"], secret=secret).collect()
    assert len({r.text.split()[-1] for r in cells}) == 1 and not any("123-45-6789" in r.text for r in cells)


@pytest.mark.parametrize("options", [
    {"emailAddress": {"onlyValidTLDs": True}}, {"zipCode": {"validate": True}}, {"phoneNumber": {"region": ["gb"]}}, {"phoneNumber": {"leniency": "valid"}}, {"person": {}},
    {"ssn": {"ssnFilterStrategies": [{"strategy": "RANDOM_REPLACE", "replacementScope": "ALL"}]}}, {"age": {"ageFilterStrategies": [{"strategy": "MAP_REPLACE", "mappingFiles": ["m.csv"]}]}},
    {"zipCode": {"zipCodeFilterStrategies": [{"condition": "population > 3"}]}}, {"ssn": {"ssnFilterStrategies": [{"strategy": "RANDOM_REPLACE", "replacementScope": "CONTEXT"}]}},
])
def test_options_that_cannot_be_met_are_errors(options):
    with pytest.raises(ValueError):
        Redactor(Policy({"identifiers": options}))


def test_lists_that_are_there(spark):
    policy = Policy({"identifiers": {"emailAddress": {"onlyValidTLDs": True}, "zipCode": {"validate": True}, "person": {"id": "ner"}}})
    search = lambda text: [{"s": m.start(), "e": m.end(), "t": m[0], "p": 0} for m in re.finditer("Ann", text)]
    docs = spark.createDataFrame([("a@b.org c@d.nowhere 90210 00000 Ann",)], "text string")
    got = redact(docs, policy, resources=Resources(tlds=["org"], zips={"90210": 5}, searches={"ner": search})).first().filtered_text
    assert got == "{{{REDACTED-email-address}}} c@d.nowhere {{{REDACTED-zip-code}}} 00000 {{{REDACTED-ph-eye}}}"


def test_fuzzy_terms_across_blanks():
    search = kernel.FuzzySearch("d", ["new york", "boston"], "low", False)
    gap = "new" + " " * 5000 + "yorc"
    assert [(x["t"], x["p"]) for x in search(f"in {gap} or Bostan, boston")] == [(gap, 1), ("boston", 0), ("Bostan,", 1)]
    plain = [(w, t) for w in ("bostn", "bo", "bsotn", "xboston", "bostonxyz", "tsobon") for t in ["boston"] if len(w) > 2 and kernel.levenshtein(t, w, 2) <= 2]
    assert {x["t"] for x in search("bostn bo bsotn xboston bostonxyz tsobon")} == {w for w, _ in plain}


def test_clear_keeps_the_rest(spark, tmp_path):
    table = ContextTable(spark, str(tmp_path / "contexts"))
    table.add(spark.createDataFrame([("a", "x", "1"), ("b", "y", "2"), ("b", "z", "3")], "context string, token string, replacement string"))
    table.clear("a")
    assert table.get("a", "x") is None and table.get("b", "y") == "2" and table.get("b", "z") == "3"
    table.add(spark.createDataFrame([("a", "x", "4")], "context string, token string, replacement string"))
    assert table.get("a", "x") == "4"


def test_few_terms_find_what_many_find(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 'In "New  York", (St. Louis) -- Boston; NEW\nYORK. -- new york'), (2, None), (3, "boston boston's st louis")], "doc_id long, text string")
    terms = spark.createDataFrame([("New York",), ("St. Louis",), ("boston",)], "term string")
    few = {tuple(r) for r in dictionary.exact_matches(docs, terms, 3).collect()}
    monkeypatch.setattr(dictionary, "FEW_TERMS", 0)
    assert few == {tuple(r) for r in dictionary.exact_matches(docs, terms, 3).collect()} and len(few) >= 6


def _searched(spark, text, policy):
    """The tokens that someone finds who has the output and tries every one in the text: what is made of seed, place, text and token alone."""
    from mistveil.functions import anonymize

    span = redact(spark.createDataFrame([(text,)], "text string"), policy).first().spans[0]
    sealed = base64.b64decode(span.replacement.strip("{}")) if span.replacement.startswith("{{") else b""
    tries = spark.range(6700, 6900).select(F.concat(F.lit("123-45-"), F.col("id").cast("string")).alias("token"))
    tries = tries.withColumn("row", F.xxhash64(F.lit(0), F.replace(F.lit(text), F.lit(span.text), F.col("token")))).withColumn("place", F.xxhash64("row", F.lit(span.character_start), "token"))
    found = []
    for r in tries.collect():
        nonces = {hashlib.sha256(f"nonce{seed}{r.token}".encode()).digest()[:12] for seed in (r.row, r.place)}
        values = {anonymize.anonymize("ssn", r.token, f"{r.row}|{span.character_start}|{r.token}", secret=s) for s in (b"", b"0")}
        if sealed[:12] in nonces or span.replacement in values:
            found.append(r.token)
    return span, found


def test_published_values_do_not_give_the_token_away(spark):
    text, key = "ssn 123-45-6789 end", "00112233445566778899aabbccddeeff"
    crypto = Policy({"crypto": {"key": key}, "identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": "CRYPTO_REPLACE"}]}}})
    other = Policy({"crypto": {"key": key[::-1]}, "identifiers": crypto.identifiers})
    twice = redact(spark.createDataFrame([("123-45-6789 or 123-45-6789",)], "text string"), crypto).first().spans
    nonces = [base64.b64decode(s.replacement.strip("{}"))[:12] for s in twice]
    assert len(set(nonces)) == 2
    # the same text under another key, or read with what is published alone, has another nonce
    again = base64.b64decode(redact(spark.createDataFrame([("123-45-6789 or 123-45-6789",)], "text string"), other).first().spans[0].replacement.strip("{}"))[:12]
    assert again not in nonces
    salted = Policy({"identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": "HASH_SHA256_REPLACE", "salt": True}]}}})
    one, two = (redact(spark.createDataFrame([(text,)], "text string"), salted).first().spans[0] for _ in range(2))
    assert one.salt != two.salt and one.replacement == hashlib.sha256(("123-45-6789" + one.salt).encode()).hexdigest()
    same = [redact(spark.createDataFrame([(text,)], "text string"), salted, secret="sixteen bytes and more").first().spans[0].salt for _ in range(2)]
    assert same[0] == same[1] and len(base64.b64decode(same[0])) == 16


def test_search_for_tokens_finds_nothing(spark):
    text = "ssn 123-45-6789 end"
    for strategy in ("CRYPTO_REPLACE", "RANDOM_REPLACE"):
        policy = Policy({"crypto": {"key": "00112233445566778899aabbccddeeff"}, "identifiers": {"ssn": {"ssnFilterStrategies": [{"strategy": strategy}]}}})
        span, found = _searched(spark, text, policy)
        assert span.text == "123-45-6789" and not found


def test_mac_is_hmac(spark):
    from mistveil.functions import keyed

    for key in (b"k" * 16, b"long key " * 20):
        got = bytes(spark.createDataFrame([("tok", 7)], "t string, n long").select(keyed.mac(key, F.col("n"), F.col("t")).alias("m")).first().m)
        assert got == hmac.new(key, b"1:7" + b"3:tok", hashlib.sha256).digest()
    with pytest.raises(ValueError):
        Redactor(Policy({"identifiers": {"ssn": {}}}), secret="short")


def test_generated_values_are_searched(spark):
    """No value of a generator that holds what the policy looks for, fails, is blank or repeats the token gets out; in texts and in cells."""
    made = {"A1": "mail me@x.org", "A2": "Bob", "A3": " ", "A4": "a4", "A5": None, "A6": "12-345"}

    def generate(generator, token, label):
        if token == "A7":
            raise RuntimeError("no service")
        return made[token]

    strategy = {"strategy": "MAP_REPLACE", "generator": "g", "mappings": {"A8": "known@x.org"}}
    policy = Policy({"identifiers": {"emailAddress": {}, "identifiers": [{"pattern": r"\bA\d\b", "identifierFilterStrategies": [strategy]}, {"pattern": r"12-\d+"}]}})
    texts = [f"see A{i} here" for i in range(1, 9)] + ["A1 A2 A6", None, ""]
    resources = Resources(generate=generate)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    tag = "{{{REDACTED-identifier}}}"
    want = [f"see {x} here" for x in (tag, "Bob", tag, tag, tag, tag, tag, "known@x.org")] + [f"{tag} Bob {tag}", None, ""]
    out = redact(rows, policy, resources=resources)
    assert [r.filtered_text for r in sorted(out.collect(), key=lambda r: r.i)] == want
    assert out.columns == ["i", "text", "spans", "regex_timeouts", "filtered_text", "tokens"]
    cells = tables.redact_columns(rows.withColumn("other", F.col("text")), policy, ["text", "other"], resources=resources)
    assert [(r.text, r.other) for r in sorted(cells.collect(), key=lambda r: r.i)] == [(w, w) for w in want]


@pytest.mark.parametrize(("token", "form"), [("2021-03-04", r"\d{4}-\d\d-\d\d"), ("03-04-2021", r"\d\d-\d\d-\d{4}"), ("3-4-21", r"\d{1,2}-\d{1,2}-\d{4}"), ("March 4, 2021", r"[A-Z][a-z]+ \d\d, \d{4}"), ("4 Sept 2021", r"[A-Z][a-z]+ \d\d, \d{4}"), ("3/4/2021", r"\d{4}-\d\d-\d\d")])
def test_random_dates_keep_the_form(token, form):
    from mistveil.functions import anonymize

    assert all(re.fullmatch(form, anonymize.anonymize("date", token, str(i), secret=b"s")) for i in range(50))
    assert anonymize.anonymize("numeric", "12345", "k") == "00000"


def test_columns_are_not_overwritten(spark):
    df = spark.createDataFrame([("a@b.org", "mine")], "text string, Tokens string")
    with pytest.raises(ValueError, match="Tokens"):
        redact(df, Policy({"identifiers": {"emailAddress": {}}}))
    assert redact(df.withColumnRenamed("Tokens", "other"), Policy({"identifiers": {"emailAddress": {}}})).first().other == "mine"


def test_context_has_no_bound(spark):
    policy = Policy({"identifiers": {"emailAddress": {}}})
    word = "x" * 63
    texts = ["mail" + " " * 5000 + "a@b.org", "a@b.org" + " " * 5000 + "email", "email " + f"{word} " * 4 + "a@b.org", "email" + f" {word}" * 5 + " a@b.org", "e-mail" + " \n" * 40_000 + "a@b.org . . ."]
    got = [r.spans[0].confidence for r in sorted(redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), policy).collect(), key=lambda r: r.i)]
    assert got == [0.9, 0.95, 0.95, 0.9, 0.95]


def test_steps_follow_each_other(spark):
    policy = Policy({"identifiers": {"emailAddress": {"emailAddressFilterStrategies": [{"strategy": "STATIC_REPLACE", "staticReplacement": "é🎉"}]}}})
    texts = ["a@b.org, 🎉 c@d.org and e@f.org.", "none", "", None, "a@b.org"]
    for r in redact(spark.createDataFrame([(t,) for t in texts], "text string"), policy, incremental=True).collect():
        now = r.text
        for s in r.incremental_redactions or []:
            now = now.replace(s.span.text, "é🎉", 1)
            assert s.text == now and s.hash == hashlib.sha256(now.encode()).hexdigest()
        assert now == r.filtered_text and len(r.incremental_redactions or []) == len(r.spans or [])


@pytest.mark.parametrize("place", ["policy", "filter"])
def test_ignored_patterns_have_a_budget(spark, place):
    """A pattern that backtracks without end costs its budget, is named, and ignores nothing."""
    bad, good = r"^(a|aa)+$", "^b+@"
    texts = ["a" * 40 + "@x.org b@x.org", "c@x.org", None, ""] + ["a" * (41 + i) + "@x.org" for i in range(30)]
    patterns = [{"pattern": bad}, {"pattern": good}]
    data = {"identifiers": {"emailAddress": {"ignoredPatterns": patterns if place == "filter" else []}}, "ignoredPatterns": patterns if place == "policy" else []}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    began = time.time()
    out = {r.i: r for r in Redactor(Policy(data), budget_ms=200).redact(rows).collect()}
    assert time.time() - began < 30
    assert [s.text for s in out[0].spans] == ["a" * 40 + "@x.org"] and out[0].regex_timeouts == [f"ignored pattern '{bad}'"]
    assert [s.text for s in out[1].spans] == ["c@x.org"] and out[1].regex_timeouts == [] and out[3].regex_timeouts == []
    cells = tables.redact_columns(rows.select("i", "text"), Policy({**data, "ignoredPatterns": [{"pattern": good}]}), ["text"])
    assert "b@x.org" in next(r.text for r in cells.collect() if r.i == 0)


def test_ignored_spans_push_none_aside(spark):
    """A span that a filter's pattern takes out doesn't hide a shorter one of the same filter."""
    policy = Policy({"identifiers": {"identifiers": [{"pattern": r"x\d+"}], "creditCard": {"onlyValidCreditCardNumbers": False, "ignoredPatterns": ["^9"]}}})
    got = redact(spark.createDataFrame([("9111 1111 1111 1111 x12",), ("4111 1111 1111 1111",)], "text string"), policy).collect()
    assert [[s.text for s in r.spans] for r in got] == [["x12"], ["4111 1111 1111 1111"]]
