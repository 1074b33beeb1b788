"""Phone numbers with and without country codes, by region and leniency."""

import pytest

from mistveil.operators import phones
from mistveil.plans.policy import Policy
from mistveil.plans.redactor import redact

#: Text, regions, leniency, the numbers found.
CASES = [
    ("Call 555-867-5309", "US", "POSSIBLE", ["555-867-5309"]), ("Phone: (555) 867-5309.", "US", "POSSIBLE", ["(555) 867-5309"]), ("+1 555 867 5309", "US", "POSSIBLE", ["+1 555 867 5309"]),
    ("No phone. Just 123. ZIP code: 12345", "US", "POSSIBLE", []), ("Call +44 20 7946 0958 today", "US", "POSSIBLE", ["+44 20 7946 0958"]), ("+33 1 42 68 53 00, +91 98765 43210", "US", "POSSIBLE", ["+33 1 42 68 53 00", "+91 98765 43210"]),
    ("Office +49 30 901820 ext", "US", "POSSIBLE", ["+49 30 901820"]), ("the number is 020 7946 0958.", "GB", "POSSIBLE", ["020 7946 0958"]), ("the number is 020 7946 0958.", "US", "POSSIBLE", ["020 7946"]),
    ("call 123-456-7890 or 020 7946 0958 or 01 42 68 53 00.", "US GB FR", "POSSIBLE", ["123-456-7890", "020 7946 0958", "01 42 68 53 00"]), ("the number is +1 202-555-0182.", "GB FR US", "POSSIBLE", ["+1 202-555-0182"]),
    ("Oct 9, 2026. Call +1 202-555-0182.", "US GB DE", "POSSIBLE", ["2026", "+1 202-555-0182"]), ("Oct 9, 2026. Call +1 202-555-0182.", "US GB DE", "VALID", ["+1 202-555-0182"]),
    ("call 1-112-997-5633 or 1.109.299.5128 now", "US", "POSSIBLE", ["1-112-997-5633", "1.109.299.5128"]), ("1-109-299-5128 x512", "US", "POSSIBLE", ["1-109-299-5128 x512"]), ("call 1-112-997-5633 now", "GB", "POSSIBLE", []),
    ("Item 1 112-997-5633", "US", "POSSIBLE", ["112-997-5633"]), ("call 1 (112) 997-5633", "US", "POSSIBLE", ["(112) 997-5633"]), ("11129975633", "US", "POSSIBLE", []), ("1-212-997-5633", "US", "POSSIBLE", ["1-212-997-5633"]),
    ("12/25/2020 and 2024-01-15 10:30", "US SG", "POSSIBLE", []), ("4111 1111 1111 1111", "US", "POSSIBLE", []), ("+44 (0)20 7946 0958", "US", "VALID", ["+44 (0)20 7946 0958"]), ("+960 330 1234", "US", "POSSIBLE", ["+960 330 1234"]),
    ("+44 123 or +1 202 or +0 20 7946", "US", "POSSIBLE", []), ("+7 701 234 5678, +7 495 123 45 67", "US", "VALID", ["+7 701 234 5678", "+7 495 123 45 67"]), ("＋81-3-1234-5678", "US", "POSSIBLE", ["＋81-3-1234-5678"]),
    ("", "US", "POSSIBLE", []), (None, "US", "POSSIBLE", []),
]
#: By leniency, whether a number is found.
STRICTER = [("202 555 0182", "yyyy"), ("202-5550182", "yyyn"), ("202 55 50182", "yynn"), ("112-997-5633", "ynnn"), ("(202) 555-0182", "yyyy"), ("2025550182", "yyyy")]


def found(spark, texts, regions, leniency):
    policy = Policy({"identifiers": {"phoneNumber": {"region": regions.split(), "leniency": leniency}}})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [[s.text for s in r.spans] for r in sorted(redact(rows, policy).collect(), key=lambda r: r.i)]


@pytest.mark.parametrize(("regions", "leniency"), sorted({c[1:3] for c in CASES}))
def test_found(spark, regions, leniency):
    cases = [c for c in CASES if c[1:3] == (regions, leniency)]
    assert found(spark, [c[0] for c in cases], regions, leniency) == [c[3] for c in cases]


def test_leniencies(spark):
    got = [found(spark, [f"Call {n} now" for n, _ in STRICTER], "US", x) for x in phones.LENIENCIES]
    assert ["".join("y" if got[k][i] == [n] else "n" for k in range(4)) for i, (n, _) in enumerate(STRICTER)] == [w for _, w in STRICTER]


def test_confidence(spark):
    texts = ["Call 555-123-4567", "+1 555 867 5309", "at +44 20 7946 0958 today", "Office +49 30 901820 ext"]
    rows = redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), Policy({"identifiers": {"phoneNumber": {}}})).collect()
    assert [r.spans[0].confidence for r in sorted(rows, key=lambda r: r.i)] == [0.95, 0.95, 0.75, 0.60]


def test_blank_regions_are_the_default(spark):
    assert found(spark, ["Call 555-123-4567"], "", "POSSIBLE") == [["555-123-4567"]]
    assert Policy({"identifiers": {"phoneNumber": {"region": " "}}}).errors() == []


def test_plans_are_consistent():
    assert len({p.region for p in phones.PLANS}) == len(phones.PLANS)
    for p in phones.PLANS:
        assert set(p.valid) <= set(p.possible) and (len(p.code) == 3) == (int(p.code) not in phones.SHORT_CODES) and max(p.possible) + len(p.code) <= phones.MOST
