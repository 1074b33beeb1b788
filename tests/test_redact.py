"""Detectors, strategies and the planner: cases as data, all run by one plan for each policy."""

import base64
from datetime import date

import pytest
from pyspark.sql import functions as F

from mistveil import queries as registered
from mistveil.plans.policy import Policy, PolicyError, PolicyStore, from_text
from mistveil.plans.redactor import Redactor, Resources, explain, explode_spans, redact

AS_OF = date(2026, 1, 15)


def run(spark, identifiers, texts, resources=None, seed=0, **policy):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = redact(rows, Policy({"identifiers": identifiers, **policy}), resources=resources, seed=seed, as_of=AS_OF, secret="a secret of the tests")
    return [(r["filtered_text"], [(s["character_start"], s["character_end"], s["filter_type"], s["confidence"]) for s in r["spans"]]) for r in found.orderBy("id").collect()]


def tag(name):
    return "{{{REDACTED-" + name + "}}}"


CASES = [
    ("emailAddress", {}, [("write test@something.com.", f"write {tag('email-address')}."), ("none here", "none here"), ("", ""), (None, None)]),
    ("ssn", {}, [("SSN: 123-45-6789", f"SSN: {tag('ssn')}"), ("123 45 6789", tag("ssn")), ("123456789", tag("ssn")), ("666-45-6789", "666-45-6789"), ("000-12-3456", "000-12-3456"), ("123‑45‑6789", tag("ssn")), ("123-\n45-6789", tag("ssn"))]),
    ("zipCode", {}, [("52168-1208", tag("zip-code")), ("zip 90210", f"zip {tag('zip-code')}"), ("A-90210", "A-90210")]),
    ("creditCard", {}, [("cc 4121742025464465", f"cc {tag('credit-card')}"), ("2223003122003222", tag("credit-card")), ("4121742025464466", "4121742025464466"), ("1234567890123456789", "1234567890123456789"), ("4121-7420-2546-4465", tag("credit-card"))]),
    ("ipAddress", {}, [("10.1.2.3 x", f"{tag('ip-address')} x"), ("::1 and 2001:db8::8a2e:370:7334", f"{tag('ip-address')} and {tag('ip-address')}"), ("300.1.2.3", "300.1.2.3")]),
    ("url", {}, [("see https://a.org/x?y=1.", f"see {tag('url')}."), ("www.b.org!", f"{tag('url')}!")]),
    ("date", {"onlyValidDates": True}, [("05/20/1999", tag("date")), ("02/30/2020", "02/30/2020"), ("1999-05-20T10", f"{tag('date')}T10"), ("May 20, 1999", tag("date")), ("20th of May", "20th of May"), ("20th May 1999", tag("date"))]),
    ("phoneNumber", {}, [("call 304-555-1234", f"call {tag('phone-number')}"), ("(304) 555-1234", tag("phone-number")), ("1-304-555-1234", tag("phone-number"))]),
    ("streetAddress", {}, [("Ship to 123 Main St NW", f"Ship to {tag('street-address')}"), ("77 Rectory Mews", tag("street-address")), ("P.O. Box 12", tag("street-address"))]),
    ("age", {}, [("is 45 years old", f"is {tag('age')}"), ("aged 30, 35 and 40", tag("age")), ("age thirty-two", tag("age")), ("age 130", "age 130")]),
    ("ibanCode", {}, [("GB33BUKB20201555555555", tag("iban-code")), ("GB33BUKB20201555555556", "GB33BUKB20201555555556")]),
    ("bankRoutingNumber", {}, [("021000021", tag("bank-routing-number")), ("021000022", "021000022")]),
    ("canadaSin", {}, [("046 454 286", tag("canada-sin")), ("046 454 287", "046 454 287")]),
    ("ein", {"onlyValidPrefixes": True}, [("12-3456789", tag("ein")), ("07-3456789", "07-3456789")]),
    ("itin", {}, [("912-70-1234", tag("itin")), ("812-70-1234", "812-70-1234")]),
    ("macAddress", {}, [("00:1B:44:11:3a:B7", tag("mac-address"))]),
    ("vin", {}, [("1HGCM82633A004352", tag("vin")), ("1HGCM82633A00435O", "1HGCM82633A00435O")]),
    ("bitcoinAddress", {}, [("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", tag("bitcoin-address"))]),
    ("passportNumber", {}, [("AB1234567", tag("passport-number"))]),
    ("driversLicense", {}, [("A1234567", tag("drivers-license-number"))]),
    ("phoneNumberExtension", {}, [("ext. 123", tag("phone-number-extension")), ("x22", tag("phone-number-extension"))]),
    ("trackingNumber", {}, [("1Z9999W99999999999", tag("tracking-number"))]),
    ("stateAbbreviation", {}, [("from WV", f"from {tag('state-abbreviation')}"), ("wv", "wv")]),
    ("currency", {}, [("paid $1,000.50 now", f"paid {tag('currency')} now"), ("20 EUR", tag("currency"))]),
]


@pytest.mark.parametrize("key,options,pairs", CASES, ids=[c[0] for c in CASES])
def test_detectors(spark, key, options, pairs):
    got = run(spark, {key: options}, [a for a, _ in pairs])
    assert [g[0] for g in got] == [b for _, b in pairs]


def test_contexts_raise_confidence_and_neighbours_lower_it(spark):
    got = run(spark, {"ssn": {}, "creditCard": {}}, ["ssn 123-45-6789", "123-45-6789", "123-45-6789 a b c d e ssn", "-4121742025464465 card", "-4121742025464465-"])
    assert [g[1][0][3] for g in got] == [0.95, 0.9, 0.9, 0.65, 0.5]


def test_longest_span_wins_and_ignored_after(spark):
    got = run(spark, {"zipCode": {}, "identifiers": [{"pattern": r"ID-\d{5}"}]}, ["ID-90210"], ignored=[{"terms": ["id-90210"]}])
    assert got == [("ID-90210", [])]  # the ignored longer span had already beaten the shorter one


STRATEGIES = [
    ({"strategy": "MASK"}, "**********"), ({"strategy": "MASK", "maskCharacter": "#", "maskLength": "3"}, "###"), ({"strategy": "LAST_4"}, "1208"), ({"strategy": "TRUNCATE"}, "5216******"),
    ({"strategy": "TRUNCATE", "truncateDirection": "TRAILING", "truncateLeaveCharacters": 2}, "********08"), ({"strategy": "STATIC_REPLACE", "staticReplacement": "Z"}, "Z"),
    ({"strategy": "static_replace"}, tag("zip-code")), ({"strategy": "SAME"}, "52168-1208"), ({"strategy": "ABBREVIATE"}, "5"), ({"strategy": "NOPE"}, tag("zip-code")),
    ({"strategy": "MAP_REPLACE", "mappings": {"52168-1208": "mapped"}}, "mapped"), ({"strategy": "MAP_REPLACE", "fallbackStrategy": "LAST_4"}, "1208"), ({"strategy": "MASK", "condition": "confidence > 0.99"}, "52168-1208"),
    ({"redactionFormat": "<%t>"}, "<zip-code>"), ({"strategy": "HASH_SHA256_REPLACE"}, None), ({"strategy": "RANDOM_REPLACE"}, None), ({"strategy": "CRYPTO_REPLACE"}, tag("zip-code")),
]


@pytest.mark.parametrize("strategy,expected", STRATEGIES)
def test_strategies(spark, strategy, expected):
    import hashlib

    got = run(spark, {"zipCode": {"zipCodeFilterStrategies": [strategy]}}, ["52168-1208"])[0][0]
    if strategy.get("strategy") == "HASH_SHA256_REPLACE":
        expected = hashlib.sha256(b"52168-1208").hexdigest()
    if strategy.get("strategy") == "RANDOM_REPLACE":
        assert got != "52168-1208" and got == run(spark, {"zipCode": {"zipCodeFilterStrategies": [strategy]}}, ["52168-1208"])[0][0]
    else:
        assert got == expected


def test_first_met_condition_chooses(spark):
    chosen = [{"strategy": "LAST_4", "condition": 'token startswith "9"'}, {"strategy": "STATIC_REPLACE", "staticReplacement": "other"}]
    assert [g[0] for g in run(spark, {"zipCode": {"zipCodeFilterStrategies": chosen}}, ["90210", "10001"])] == ["0210", "other"]


def test_population_needs_a_table(spark):
    chosen = [{"strategy": "STATIC_REPLACE", "staticReplacement": "small", "condition": "population < 20000"}]
    got = run(spark, {"zipCode": {"zipCodeFilterStrategies": chosen}}, ["90210", "10001", "99999"], Resources(zips={"90210": 100, "10001": 50000}))
    assert [g[0] for g in got] == ["small", "10001", "99999"]


def test_dates(spark):
    shift = {"dateFilterStrategies": [{"strategy": "SHIFT_DATE", "shiftDays": 1, "shiftMonths": 1}]}
    assert [g[0] for g in run(spark, {"date": shift}, ["01/31/2020", "2020-12-31", "May 1, 2020", "31 Jan. 2020", "3rd Sept 2020"])] == ["3/1/2020", "2021-02-01", "June 2, 2020", "01 Mar. 2020", "4th Oct 2020"]
    assert run(spark, {"date": {"dateFilterStrategies": [{"strategy": "RELATIVE"}]}}, ["01/01/2024", "01/01/2030"])[0][0] == "2 years 0 months ago"
    assert run(spark, {"date": {"dateFilterStrategies": [{"strategy": "TRUNCATE_TO_YEAR"}]}}, ["01/01/2024"])[0][0] == "2024"


def test_dictionaries_identifiers_sections(spark):
    got = run(spark, {"dictionaries": [{"classification": "meds", "terms": ["aspirin", "vitamin  c"], "customFilterStrategies": [{"redactionFormat": "<%l>"}]}]}, ["(Aspirin), vitamin\nC"])
    assert got[0][0] == "(<meds>), <meds>"
    fuzzy = {"terms": ["aspirin"], "fuzzy": True, "customFilterStrategies": [{"redactionFormat": "X"}]}
    for level, expected in (("high", "X asprin"), ("medium", "X X"), ("low", "X X"), ("off", "X asprin")):
        assert run(spark, {"dictionaries": [fuzzy | {"sensitivity": level}]}, ["aspirin asprin"])[0][0] == expected
    assert run(spark, {"identifiers": [{"pattern": r"AB(\d+)", "groupNumber": 1}]}, ["AB123 x"])[0][0] == f"AB{tag('identifier')} x"
    assert run(spark, {"identifiers": [{"pattern": r"\d{16}", "validator": "luhn"}]}, ["4111111111111111 4111111111111112"])[0][0] == f"{tag('identifier')} 4111111111111112"
    assert run(spark, {"sections": [{"startPattern": "BEGIN", "endPattern": "END"}]}, ["a BEGIN b END c"])[0][0] == f"a {tag('section')} c"
    assert run(spark, {"surname": {}}, ["Mr. Smith"], Resources(terms={"surname": ["Smith"]}))[0][0] == f"Mr. {tag('surname')}"


def test_slow_pattern_runs_out_of_time(spark):
    rows = spark.createDataFrame([("the id is " + "a" * 40 + "c b",)], "text string")
    r = Redactor(Policy({"identifiers": {"identifiers": [{"pattern": "(?:a|a)+b"}]}}), budget_ms=200).redact(rows).first()
    assert r["spans"] == [] and len(r["regex_timeouts"]) == 1


def test_long_tokens_are_encrypted_in_one_line(spark, tmp_path):
    long = "x" * 200 + "@example.org"
    spark.createDataFrame([(1, f"to {long} or a@example.org")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registered.queries()["crypto_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(r["decrypted"] for r in rows) == ["a@example.org", long]
    crypto = {"key": "000102030405060708090a0b0c0d0e0f"}
    text = run(spark, {"emailAddress": {"emailAddressFilterStrategies": [{"strategy": "CRYPTO_REPLACE"}]}}, [long], crypto=crypto)[0][0]
    assert len(text.splitlines()) == 1 and len(base64.b64decode(text.strip("{}"), validate=True)) == 12 + len(long) + 16


def test_both_ends_of_a_range_of_zip_codes(spark):
    texts = ["see 09998-9998 there", "see 10000-10000 there", "see 100000-100000 there"]
    got = [g[0] for g in run(spark, {"zipCode": {"requireDelimiter": True}}, texts)]
    assert got == [f"see {tag('zip-code')} there", f"see {tag('zip-code')}-{tag('zip-code')} there", texts[2]]


def test_cards_without_boundaries(spark):
    got = run(spark, {"creditCard": {"onlyWordBoundaries": False}}, ["x4121742025464465y"])
    assert got[0][0] == f"x{tag('credit-card')}y"


def test_invariants_on_documents(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    policy = Policy({"identifiers": {"emailAddress": {}, "ipAddress": {}, "creditCard": {}, "stateAbbreviation": {}}})
    whole = redact(docs, policy)
    spans = explode_spans(whole.withColumn("t", F.col("text")), "doc_id", "t").withColumn("own", F.expr("substring(t, character_start + 1, character_end - character_start)"))
    assert spans.where("own <> text").count() == 0 and spans.count() > 0
    for method in ("newline", "characters", "width"):
        for overlap in (0, 32):
            split = Policy(policy.data | {"config": {"splitting": {"enabled": True, "threshold": 300, "method": method, "overlap": overlap}}})
            if method == "width":
                continue  # lines broken at spaces may cut a card with spaces
            same = redact(docs, split).select("doc_id", "filtered_text").exceptAll(whole.select("doc_id", "filtered_text"))
            assert same.count() == 0
    again = redact(whole.select("doc_id", F.col("filtered_text").alias("text")), Policy({"identifiers": {"emailAddress": {}, "ipAddress": {}}}))
    assert again.where("size(spans) > 0").count() == 0
    assert redact(docs.repartition(7), policy).select("doc_id", "filtered_text").exceptAll(whole.select("doc_id", "filtered_text")).count() == 0


def test_incremental_and_explain(spark):
    rows = spark.createDataFrame([("a@b.com and 10.0.0.1",)], "text string")
    policy = Policy({"identifiers": {"emailAddress": {}, "ipAddress": {"ipAddressFilterStrategies": [{"strategy": "SAME"}]}}})
    r = redact(rows, policy, incremental=True).first()
    import hashlib

    assert [s["hash"] for s in r["incremental_redactions"]] == [hashlib.sha256(s["text"].encode()).hexdigest() for s in r["incremental_redactions"]]
    assert r["incremental_redactions"][-1]["text"] == r["filtered_text"] and r["tokens"] == 3
    e = explain(rows, policy).first()
    assert (len(e["applied_spans"]), len(e["ignored_spans"])) == (1, 1)


def test_policies(tmp_path, monkeypatch):
    monkeypatch.setenv("FMT", "<%t>")
    p = Policy.from_json('{"Identifiers": {"SSN": {"ssnFilterStrategies": [{"strategy": "shift_date", "redactionFormat": "${FMT}"}]}, "dictionary": [{"terms": [" a "], "level": "high"}]}}')
    assert p.identifiers["ssn"]["ssnFilterStrategies"][0] == {"strategy": "SHIFT", "redactionFormat": "<%t>"}
    assert p.identifiers["dictionaries"] == [{"terms": ["a"], "sensitivity": "low"}]
    for bad in ('{"identifiers": {"nope": {}}}', '{"identifiers": {"ssn": {"ssnFilterStrategies": [{"condition": "a or b"}]}}}', "{", '{"config": {"splitting": {"method": "x"}}}', '{"identifiers": {"identifiers": [{"validator": "mod11"}]}}'):
        with pytest.raises(PolicyError):
            Policy.from_json(bad)
    store = PolicyStore(str(tmp_path / "p"))
    store.save("one", p)
    assert store.names() == ["one"] and store.load("one").data == p.data
    t = from_text("POLICY x; REDACT SSN, EMAIL_ADDRESS WITH MASK (mask_character = '#') WHERE confidence > 0.5;")
    assert set(t.identifiers) == {"ssn", "emailAddress"}
    with pytest.raises(PolicyError):
        from_text("POLICY x; DELETE SSN;")
