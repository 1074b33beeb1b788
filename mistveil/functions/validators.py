"""Checksum predicates over a string column, as integer folds over its characters."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------------
NIF_LETTERS, CIF_FIRST, CIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "ABCDEFGHJNPQRSUVW", "JABCDEFGHI"
NIF_PREFIXES, NIR_SUBSTITUTES = {"X": "0", "Y": "1", "Z": "2"}, {"2A": "19", "2B": "18"}
DIHEDRAL = "0123456789 1234067895 2340178956 3401289567 4012395678 5987604321 6598710432 7659821043 8765932104 9876543210".replace(" ", "")
VERHOEFF = "0123456789 1576283094 5803796142 8916043527 9453126870 4286573901 2793806415 7046913258".replace(" ", "")
DAMM = "0317598642 7092154863 4206871359 1750983426 6123045978 3674209581 5869720134 8945362017 9438617205 2581436790".replace(" ", "")


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _values(t: Column) -> Column:
    """0-9 and A-Z of a string as 0 to 35; other characters are -1."""
    code = lambda c: F.ascii(c)
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.when(c.rlike("^[0-9]$"), code(c) - 48).when(c.rlike("^[A-Z]$"), code(c) - 55).otherwise(-1))


def _weighted(values: Column, weights: list[int]) -> Column:
    """Sum of values times weights, for as many as there are weights."""
    return F.aggregate(F.zip_with(F.slice(values, F.lit(1), F.lit(len(weights))), F.array(*[F.lit(w) for w in weights]), lambda v, w: v * w), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _table(table: str, row: Column, column: Column) -> Column:
    return F.substring(F.lit(table), row * 10 + column + 1, F.lit(1)).cast("int")


def _compact(t: Column, separators: str) -> Column:
    return F.regexp_replace(F.upper(F.trim(t)), f"(?U)[{separators}]", "")


def luhn(t: Column) -> Column:
    d = digits(t)
    return (d != "") & F.call_function("luhn_check", d)


def aba(t: Column) -> Column:
    return (F.length(digits(t)) == 9) & (_weighted(_values(digits(t)), [3, 7, 1] * 3) % 10 == 0)


def _check11(values: Column, weights: list[int]) -> Column:
    rest = _weighted(values, weights) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _mod11(t: Column, length: int, first: list[int], second: list[int]) -> Column:
    d = digits(t)
    v = _values(d)
    return F.coalesce((F.length(d) == length) & ~d.rlike(r"^(.)\1*$") & (_check11(v, first) == F.get(v, F.lit(length - 2))) & (_check11(v, second) == F.get(v, F.lit(length - 1))), F.lit(False))


def cpf(t: Column) -> Column:
    return _mod11(t, 11, list(range(10, 1, -1)), list(range(11, 1, -1)))


def cnpj(t: Column) -> Column:
    return _mod11(t, 14, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


def iban(t: Column) -> Column:
    s = F.upper(F.regexp_replace(t, r"(?U)\s", ""))
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    rest = F.aggregate(_values(moved), F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97)
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & F.length(s).between(5, 34) & (rest == 1)


def nir(t: Column, substitutes: dict[str, str] | None = None) -> Column:
    s = F.upper(F.regexp_replace(t, r"(?U)\s", ""))
    body = F.substring(s, 1, 13)
    for k, v in (substitutes or NIR_SUBSTITUTES).items():
        body = F.replace(body, F.lit(k), F.lit(v))
    key = F.substring(s, 14, 2)
    return F.coalesce((F.length(s) == 15) & key.rlike("^[0-9]{2}$") & body.rlike("^[0-9]{13}$") & (97 - body.try_cast("long") % 97 == key.try_cast("long")), F.lit(False))


def nif(t: Column, prefixes: dict[str, str] | None = None) -> Column:
    s = _compact(t, r"\s-")
    first = F.substring(s, 1, 1)
    head = first
    for k, v in (prefixes or NIF_PREFIXES).items():
        head = F.when(first == k, F.lit(v)).otherwise(head)
    number = F.concat(head, F.substring(s, 2, 7))
    return F.coalesce((F.length(s) == 9) & number.rlike("^[0-9]+$") & (F.substring(F.lit(NIF_LETTERS), (number.try_cast("long") % 23 + 1).cast("int"), F.lit(1)) == F.substring(s, 9, 1)), F.lit(False))


def cif(t: Column) -> Column:
    s = _compact(t, r"\s-")
    v = _values(F.substring(s, 2, 7))
    total = F.aggregate(F.transform(v, lambda x, i: F.when(i % 2 == 0, F.floor(x * 2 / 10) + x * 2 % 10).otherwise(x).cast("int")), F.lit(0), lambda a, x: a + x)
    check = (10 - total % 10) % 10
    control = F.substring(s, 9, 1)
    return F.coalesce((F.length(s) == 9) & s.rlike(f"^[{CIF_FIRST}][0-9]{{7}}") & ((control == check.cast("string")) | (control == F.substring(F.lit(CIF_LETTERS), check + 1, F.lit(1)))), F.lit(False))


def steuer_id(t: Column) -> Column:
    d = F.regexp_replace(t, r"(?U)[\s./-]", "")
    v = F.slice(_values(d), F.lit(1), F.lit(10))
    counts = F.transform(F.array(*[F.lit(k) for k in range(10)]), lambda k: F.size(F.filter(v, lambda x: x == k)))
    times = lambda n: F.size(F.filter(counts, lambda c: c == n))
    over = F.exists(counts, lambda c: c > 3)

    def step(p: Column, x: Column) -> Column:
        s = (x + p) % 10
        return F.when(s == 0, 10).otherwise(s) * 2 % 11

    check = (11 - F.aggregate(v, F.lit(10), step)) % 10
    once = ((times(2) == 1) & (times(3) == 0)) | ((times(2) == 0) & (times(3) == 1))
    return d.rlike("^[1-9][0-9]{10}$") & ~over & once & (check == F.substring(d, 11, 1).try_cast("int"))


def personalausweis(t: Column) -> Column:
    s = F.upper(F.trim(t))
    v = _values(F.substring(s, 1, 9))
    return F.coalesce((F.length(s) == 10) & s.rlike("[0-9]$") & ~F.array_contains(v, -1) & (_weighted(v, [7, 3, 1] * 3) % 10 == F.substring(s, 10, 1).try_cast("int")), F.lit(False))


def countries() -> list[str]:
    """The two-letter country codes of ISO 3166, as the JVM knows them."""
    return sorted(SparkContext._active_spark_context._jvm.java.util.Locale.getISOCountries())


def bic(t: Column) -> Column:
    s = F.upper(F.trim(t))
    return s.rlike(r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\z") & F.substring(s, 5, 2).isin(countries())


def verhoeff(t: Column) -> Column:
    v = _values(F.reverse(digits(t)))
    places = F.transform(v, lambda x, i: _table(VERHOEFF, i % 8, x))
    return (F.size(v) > 0) & (F.aggregate(places, F.lit(0), lambda a, x: _table(DIHEDRAL, a, x)) == 0)


def damm(t: Column) -> Column:
    v = _values(digits(t))
    return (F.size(v) > 0) & (F.aggregate(v, F.lit(0), lambda a, x: _table(DAMM, a, x)) == 0)


def date(t: Column, pattern: Column) -> Column:
    """A real date of the format, of the years 1800 to 2200; years of two digits count from 2000. No format: false."""
    out = F.lit(False)
    for f in DATE_FORMATS:
        short = f.endswith("yy") and not f.endswith("yyyy")
        full = F.concat(F.regexp_replace(t, r"\d\d$", ""), F.lit("20"), F.right(t, F.lit(2))) if short else t
        day = F.try_to_timestamp(full, F.lit(f.replace("yyyy", "yy").replace("yy", "yyyy")))
        out = out | ((pattern == f) & F.coalesce(F.year(day).between(1800, 2200), F.lit(False)))
    return F.coalesce(out, F.lit(False))


DATE_FORMATS = [f.replace("/", d) for d in "/-." for f in ("M/d/yyyy", "M/d/yy", "d/M/yyyy", "d/M/yy", "yyyy/MM/dd")]


def named(name: str, params: dict | None = None):
    """The predicate of a policy's validator; unknown names and missing variants are errors."""
    params = {k.lower(): v for k, v in (params or {}).items()}
    variant = str(params.get("variant", "")).lower()
    swaps = params.get("substitutions")
    table = {
        "luhn": luhn, "aba": aba, "verhoeff": verhoeff, "damm": damm, "es-cif": cif, "de-steuerid": steuer_id,
        "de-personalausweis": personalausweis, "bic-structural": bic, "mod23-letter": lambda t: nif(t, swaps),
    }
    if name in ("mod11", "mod97"):
        kinds = {"mod11": {"cpf": cpf, "cnpj": cnpj}, "mod97": {"iban": iban, "nir": lambda t: nir(t, swaps)}}[name]
        if variant not in kinds:
            raise ValueError(f"{name}: params.variant has to be one of {', '.join(kinds)}")
        return kinds[variant]
    if name not in table:
        raise ValueError(f"Unknown validator '{name}'.")
    return table[name]


#: Parameters that each validator reads.
PARAMS = {"mod11": ["variant"], "mod97": ["variant", "substitutions"], "mod23-letter": ["substitutions"]}


def unknown_params(name: str, params: dict | None) -> list[tuple[str, str]]:
    """Parameters that a validator doesn't read, or that have the wrong form, each with what is wrong."""
    out = []
    for key, value in (params or {}).items():
        if key.lower() not in PARAMS.get(name, []):
            out.append((key, f"not a parameter of {name}"))
        elif key.lower() == "substitutions" and not (isinstance(value, dict) and all(isinstance(x, str) for kv in value.items() for x in kv)):
            out.append((key, "texts by the texts that they stand for are expected"))
    return out
