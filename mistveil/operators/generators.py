"""Seeded test data: a table of any size with columns of made-up identifiers, as expressions over spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.anonymize import STATE_CODES, STATES, STREETS

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class _Dice:
    """Independent numbers for each row, column and draw: hashes of (seed, column, draw, id)."""

    def __init__(self, seed: int, column: str):
        self.seed, self.column, self.draw = seed, column, 0

    def below(self, n: int) -> Column:
        self.draw += 1
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.column), F.lit(self.draw), F.col("id")), F.lit(n)).cast("long")

    def between(self, low: int, high: int) -> Column:
        return self.below(high - low + 1) + low

    def pick(self, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.below(len(values)) + 1).cast("int"))

    def number(self, digits: int) -> Column:
        parts = []
        while digits > 0:
            n = min(digits, 9)
            parts.append(F.lpad(self.below(10**n).cast("string"), n, "0"))
            digits -= n
        return F.concat(*parts)

    def text(self, letters: str, n: int) -> Column:
        return F.concat(*[F.substring(F.lit(letters), (self.below(len(letters)) + 1).cast("int"), F.lit(1)) for _ in range(n)])


def with_luhn(body: Column, n: int) -> Column:
    """A number of n digits with its check digit."""
    digits = [F.substring(body, i + 1, 1).cast("int") for i in range(n)]
    total = F.lit(0)
    for i, d in enumerate(reversed(digits)):
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if i % 2 == 0 else d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def column(kind: str, seed: int = 0, name: str = "", lists: dict[str, list[str]] | None = None, pattern: str = "") -> Column:
    """One kind of value; lists: names of city, county, hospital, first-name and surname; pattern: `#` digit, `?` letter, for custom-id."""
    d, lists = _Dice(seed, name or kind), lists or {}
    if kind in ("city", "county", "hospital", "first-name", "surname"):
        return d.pick(lists[kind])
    if kind == "full-name":
        return F.concat_ws(" ", d.pick(lists["first-name"]), d.pick(lists["surname"]))
    if kind == "custom-id":
        return F.concat(*[d.number(1) if c == "#" else d.text(_LETTERS, 1) if c == "?" else F.lit(c) for c in pattern])
    alnum = _LETTERS + "0123456789"
    make = {
        "age": lambda: d.between(0, 100).cast("string"),
        "bank-routing-number": lambda: d.number(9),
        "drivers-license-number": lambda: F.concat(d.text(_LETTERS, 1), d.number(7)),
        "passport-number": lambda: F.concat(d.text(_LETTERS, 1), d.number(8)),
        "phone-number": lambda: F.concat_ws("-", d.between(200, 999).cast("string"), d.between(200, 999).cast("string"), d.number(4)),
        "ssn": lambda: F.concat_ws("-", F.lpad(d.between(1, 665).cast("string"), 3, "0"), F.lpad(d.between(1, 99).cast("string"), 2, "0"), F.lpad(d.between(1, 9999).cast("string"), 4, "0")),
        "canada-sin": lambda: with_luhn(F.concat(d.between(1, 7).cast("string"), d.number(7)), 8),
        "itin": lambda: F.concat_ws("-", F.concat(F.lit("9"), d.number(2)), d.between(50, 65).cast("string"), d.number(4)),
        "credit-card": lambda: with_luhn(F.concat(F.lit("4"), d.number(14)), 15),
        "vin": lambda: d.text("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", 17),
        "iban-code": lambda: F.concat(F.lit("DE"), d.number(20)),
        "bitcoin-address": lambda: F.concat(F.lit("1"), d.text("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz123456789", 30)),
        "ip-address": lambda: F.concat_ws(".", *[d.between(0, 255).cast("string") for _ in range(4)]),
        "mac-address": lambda: F.concat_ws(":", *[F.lpad(F.lower(F.hex(d.below(256))), 2, "0") for _ in range(6)]),
        "url": lambda: F.concat(F.lit("https://www."), F.lower(d.text(_LETTERS, 8)), F.lit(".com")),
        "email-address": lambda: F.concat(F.lower(d.text(_LETTERS, 8)), F.lit("@example.com")),
        "tracking-number": lambda: F.concat(F.lit("1Z"), d.text(alnum, 16)),
        "date": lambda: F.date_format(F.date_add(F.lit("1930-01-01").cast("date"), d.below(34_000).cast("int")), "MM/dd/yyyy"),
        "zip-code": lambda: d.number(5),
        "state": lambda: d.pick(STATES),
        "state-abbreviation": lambda: d.pick(STATE_CODES),
        "street-address": lambda: F.concat_ws(" ", d.between(1, 9999).cast("string"), d.pick(STREETS)),
    }
    return make[kind]()


#: Kinds that need no list.
KINDS = (
    "age bank-routing-number drivers-license-number passport-number phone-number ssn canada-sin itin credit-card vin iban-code bitcoin-address ip-address"
    " mac-address url email-address tracking-number date zip-code state state-abbreviation street-address"
).split()


def beside(df: DataFrame, key: str, columns: dict[str, str], seed: int = 0, lists=None) -> DataFrame:
    """df with made-up columns (name to kind), drawn by the seed and the row's key (a whole number): equal keys get equal values."""
    named = df.withColumn("id", F.col(key).cast("long")) if key != "id" else df
    out = named.select("*", *[column(kind, seed, name, lists).alias(name) for name, kind in columns.items()])
    return out if key == "id" else out.drop("id")


def table(spark: SparkSession, rows: int, columns: dict[str, str], seed: int = 0, lists=None, partitions: int | None = None) -> DataFrame:
    """rows lines of the given columns (name to kind); the same seed gives the same table, whatever its partitions."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return beside(base, "id", columns, seed, lists).drop("id")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, header=True, quoteAll=quote_all)
