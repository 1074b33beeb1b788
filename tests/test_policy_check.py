"""Policies are checked as a whole: unknown options, types, conditions, validators and keys, each with its place."""

import re

import pytest

from mistveil.operators import ages
from mistveil.plans.policy import Policy, PolicyError
from mistveil.plans.redactor import Redactor, Resources, redact


def errors(**data):
    return Policy(data).errors()


def strategy(**s):
    return {"ssn": {"ssnFilterStrategies": [{"strategy": "REDACT", **s}]}}


@pytest.mark.parametrize(("data", "start"), [
    ({"identifiers": {"phoneNumber": {"regions": ["GB"]}}}, "/identifiers/phoneNumber/regions: unknown option; did you mean 'region'?"),
    ({"identifiers": {"ssn": {"ssnFilterStrategies": [{}, {"redactionFormt": "x"}]}}}, "/identifiers/ssn/ssnFilterStrategies/1/redactionFormt: unknown option; did you mean 'redactionFormat'?"),
    ({"identifiers": {"identifiers": [{}, {"patern": "x"}]}}, "/identifiers/identifiers/1/patern: unknown option"), ({"identifier": {}}, "/identifier: unknown option; did you mean 'identifiers'?"),
    ({"identifiers": {"emails": {}}}, "/identifiers/emails: unknown option"), ({"identifiers": ["ssn"]}, "/identifiers: an object is expected"), ({"identifiers": {"ssn": []}}, "/identifiers/ssn: an object is expected"),
    ({"identifiers": {"ssn": {"enabled": "perhaps"}}}, "/identifiers/ssn/enabled: true or false is expected"), ({"identifiers": {"ssn": {"windowSize": "five"}}}, "/identifiers/ssn/windowSize: a whole number is expected"),
    ({"identifiers": {"identifiers": {"pattern": "x"}}}, "/identifiers/identifiers: a list of an object is expected"), ({"config": {"splitting": {"method": "page"}}}, "/config/splitting/method: unknown method 'page'"),
    ({"ignoredPatterns": [{"pattern": "x", "flags": "i"}]}, "/ignoredPatterns/0/flags: unknown option"), ({"identifiers": {"ssn": {"ignored": [{"words": ["x"]}]}}}, "/identifiers/ssn/ignored/0/words: unknown option"),
    ({"identifiers": {"dictionaries": [{"terms": ["x"], "validate": True}]}}, "/identifiers/dictionaries/0/validate: unknown option"),
    ({"identifiers": {"identifiers": [{"validator": {"name": "mod97", "params": {"varian": "iban", "variant": "iban"}}}]}}, "/identifiers/identifiers/0/validator/params/varian: not a parameter of mod97"),
    ({"identifiers": {"identifiers": [{"validator": {"name": "mod23-letter", "params": {"substitutions": {"X": 0}}}}]}}, "/identifiers/identifiers/0/validator/params/substitutions: texts"),
    ({"identifiers": {"identifiers": [{"validator": "luhnn"}]}}, "/identifiers/identifiers/0/validator: Unknown validator 'luhnn'."),
])
def test_each_error_has_its_place(data, start):
    found = errors(**data)
    assert len(found) == 1 and found[0].startswith(start), found


def test_keys():
    fpe = {"ssn": {"ssnFilterStrategies": [{"strategy": "FPE_ENCRYPT_REPLACE"}]}}
    assert errors(identifiers=fpe, fpe={"key": "00" * 16, "tweak": "00" * 7}) == [] == errors(identifiers=fpe, fpe={"key": "00" * 32, "tweak": "00" * 8})
    assert errors(identifiers=fpe, fpe={"key": "00" * 15, "tweak": "00" * 9}) == ["/fpe/key: 16, 24 or 32 bytes in hex are needed", "/fpe/tweak: 7 or 8 bytes in hex are needed"]
    assert errors(identifiers=strategy(strategy="CRYPTO_REPLACE"), crypto={"key": "zz"}) == ["/crypto/key: 16, 24 or 32 bytes in hex are needed"]


@pytest.mark.parametrize(("condition", "mentions"), [
    ('confidence > 0.9 && context == "medical"', "&&"), ("confidence = 0.9", "'= 0.9'"), ("confidence > 0.5 or confidence < 0.1", "'or'"), ("token is birthdate", "birthdate"), ("this is not a condition", ""),
    ("confidence startswith 5", ""), ('confidence > "high"', ""), ('population == "many"', ""), ('type > "PER"', ""), ('name == "x"', ""), ('token == "x" and', ""), ("(confidence > 0.5)", ""), ('token == "unterminated', ""), ("token ==", ""),
])
def test_conditions(condition, mentions):
    (error,) = errors(identifiers=strategy(condition=condition))
    assert error.startswith("/identifiers/ssn/ssnFilterStrategies/0: the condition ") and mentions in error


def test_strategies_are_named_by_place_and_id():
    secret = 'token == "123-45-6789" or token == "987-65-4321"'
    with pytest.raises(PolicyError) as e:
        Policy.from_json('{"identifiers": {"ssn": {"ssnFilterStrategies": [{"id": "last4", "condition": "x"}]}, "pheyes": [{"phEyeFilterStrategies": [{}, {"condition": "y"}]}]}}')
    assert [x.split(": ")[0] for x in e.value.errors] == ['/identifiers/pheyes/0/phEyeFilterStrategies/1', '/identifiers/ssn/ssnFilterStrategies/0 (id "last4")'] or \
        sorted(x.split(": ")[0] for x in e.value.errors) == ['/identifiers/pheyes/0/phEyeFilterStrategies/1', '/identifiers/ssn/ssnFilterStrategies/0 (id "last4")']
    (error,) = errors(identifiers=strategy(condition=secret))
    assert "123-45" not in error and "joins comparisons with 'or', which is not supported; only 'and' is" in error
    moved = errors(identifiers={"person": {"phEyeFilterStrategies": [{"condition": "x"}]}, "zipCode": {"zipCodeFilterStrategy": [{"condition": "x"}]}})
    assert sorted(x.split(": ")[0] for x in moved) == ["/identifiers/pheyes/0/phEyeFilterStrategies/0", "/identifiers/zipCode/zipCodeFilterStrategies/0"]


def test_lists_from_files(spark):
    data = {"identifiers": {"dictionaries": [{"files": ["names.txt"], "ignoredFiles": ["not.txt"]}]}}
    with pytest.raises(ValueError, match="names.txt"):
        Redactor(Policy(data))
    got = redact(spark.createDataFrame([("Zoe met Ann and Bob",)], "text string"), Policy(data), resources=Resources(files={"names.txt": ["Zoe", "Bob"], "not.txt": ["bob"]})).first()
    assert [s.text for s in got.spans] == ["Zoe"]


def number_in_words(n):
    if n >= 100:
        rest = number_in_words(n - 100) if n > 100 else []
        return [f"{a} hundred{link}{r}" for a in ("one", "a") for link, r in ([(" ", r) for r in rest] + [(" and ", r) for r in rest] or [("", "")])]
    if n < 20:
        return [ages.SMALL[n]]
    tens = ages.TENS[n // 10 - 2]
    return [f"{tens}{s}{ages.SMALL[n % 10]}" for s in " -"] if n % 10 else [tens]


def test_ages():
    found = [re.compile(p, re.I) for p in ages.patterns()]
    whole = lambda text: any((m := p.search(text)) and m[0] == text for p in found)
    for n in range(126):
        assert whole(f"age {n}") and whole(f"aged {n}") and whole(f"{n} years old")
        for words in number_in_words(n):
            assert whole(f"aged {words}") and whole(f"{words} years old") and whole(f"{words}-yr"), words
    for n in range(126, 200):
        assert not whole(f"age {n}") and not any(whole(f"aged {w}") for w in number_in_words(n)) and all(whole(f"{w} years old") for w in number_in_words(n))
    for text in ("aged 3, 5 and 7", "Ages: 39, 41", "age 18 to 65", "aged between 3 and 7", "AGE 047", "47 y/o", "12.5 yrs", "ages of 3-5"):
        assert whole(text), text
    for text in ("age 25-03-2024", "Age: 12/25/2020", "Bronze Age 1200", "aged one hundred thousand", "age"):
        assert not any(p.search(text) for p in found), text
    assert [m[0] for p in found for m in p.finditer("age 45, 3 visits; aged 39, 2 children")] == ["age 45", "aged 39"]
