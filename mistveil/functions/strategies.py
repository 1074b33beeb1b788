"""Replacement strategies as Columns over a span's token. What needs Python is named in `todo` and filled in by the kernel."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import conditions, keyed

REPLACEMENT = "struct<value:string,salt:string,applied:boolean,color:string,todo:string>"


def redacted(options: dict, name: str, classification: Column) -> Column:
    """The redaction format with %t as the identifier's name and %l as the classification, where there is one."""
    text = F.lit(options.get("redactionFormat", "{{{REDACTED-%t}}}").replace("%t", name))
    return F.when(classification.isNotNull(), F.replace(text, F.lit("%l"), classification)).otherwise(text)


def _masked(options: dict, token: Column) -> Column:
    length = str(options.get("maskLength", "same"))
    n = F.length(token)
    if length != "same":
        try:
            n = F.least(F.lit(max(0, int(length))), n)
        except ValueError:
            pass
    return F.repeat(F.lit((options.get("maskCharacter") or "*")[0]), n)


def _truncated(options: dict, token: Column) -> Column:
    n = F.length(token)
    leave = F.least(F.greatest(F.lit(int(options.get("truncateLeaveCharacters", 4))), F.lit(1)), F.greatest(n - 1, F.lit(0)))
    rest = F.repeat(F.lit(options.get("truncateCharacter", "*")), n - leave)
    if str(options.get("truncateDirection", "LEADING")).upper() == "LEADING":
        return F.concat(F.substring(token, F.lit(1), leave), rest)
    return F.concat(rest, F.substring(token, n - leave + 1, leave))


def _abbreviated(token: Column) -> Column:
    words = F.filter(F.split(token, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


#: Entries of a list that a plan holds as literals at most; larger ones are joined as tables.
LITERALS = 20_000


def check_literals(n: int, what: str, instead: str) -> None:
    if n > LITERALS:
        raise ValueError(f"{what}: {n} entries are too many for a plan (at most {LITERALS}); join them as a table by {instead}")


def literal_map(pairs: dict, what: str, instead: str) -> Column:
    check_literals(len(pairs), what, instead)
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _mapped(options: dict, token: Column, mappings: dict[str, str]) -> Column:
    """The mapped value, or null."""
    exact = bool(options.get("caseSensitive", False))
    pairs = {(k if exact else k.lower()): v for k, v in mappings.items()}
    if not pairs:
        return F.lit(None).cast("string")
    table = literal_map(pairs, "a mapping", "operators.dictionary.map_tokens")
    return F.try_element_at(table, token if exact else F.lower(token))


def one(options: dict, name: str, token: Column, classification: Column, seed: Column, policy, mappings: dict[str, str] | None = None, secret: bytes | None = None) -> Column:
    """REPLACEMENT of one strategy, whatever its condition. seed: a long that is the same whenever the row is computed again.

    Salts and nonces come from secret, seed and token; without a secret one is drawn now.
    """
    secret = secret or keyed.fresh()
    kind = options.get("strategy", "REDACT") or "REDACT"
    plain = redacted(options, name, classification)
    salted = options.get("salt") in (True, "true")
    salt = F.base64(F.substring(keyed.mac(keyed.subkey(secret, "salt"), seed, token), 1, 16)) if salted else F.lit("")
    applied, todo = F.lit(True), F.lit(None).cast("string")
    ask = lambda **more: F.lit(json.dumps({"kind": kind} | {k: v for k, v in options.items() if k not in ("condition", "mappings")} | more))
    if kind == "MAP_REPLACE":
        inline = {**(mappings or {}), **options.get("mappings", {})}
        fallback = str(options.get("fallbackStrategy") or "REDACT").upper()
        rest = one(options | {"strategy": "REDACT" if fallback == "MAP_REPLACE" else fallback}, name, token, classification, seed, policy, secret=secret)
        hit = _mapped(options, token, inline)
        generated = F.lit(json.dumps({"kind": "GENERATE", "generator": options["generator"]})) if options.get("generator") else None
        miss = rest.withField("todo", generated) if generated is not None else rest
        return F.when(hit.isNotNull(), F.struct(hit.alias("value"), salt.alias("salt"), F.lit(True).alias("applied"), F.lit(options.get("color")).cast("string").alias("color"), todo.alias("todo")).cast(REPLACEMENT)).otherwise(miss)
    if kind == "STATIC_REPLACE":
        value = F.lit(options["staticReplacement"]) if options.get("staticReplacement") else plain
    elif kind == "MASK":
        value = _masked(options, token)
    elif kind == "LAST_4":
        value = F.when(F.length(token) >= 4, F.right(token, F.lit(4))).otherwise(token)
    elif kind == "ABBREVIATE":
        value = _abbreviated(token)
    elif kind == "HASH_SHA256_REPLACE":
        value = F.sha2(F.concat(token, salt), 256)
    elif kind == "TRUNCATE":
        value = _truncated(options, token)
    elif kind == "SAME":
        value, applied = token, F.lit(False)
    elif kind == "CRYPTO_REPLACE" and policy.secret("crypto", "key"):
        key = F.unhex(F.lit(policy.secret("crypto", "key")))
        nonce = F.substring(keyed.mac(keyed.subkey(secret, "nonce"), seed, token), 1, 12)
        sealed = F.base64(F.aes_encrypt(F.encode(token, "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce))
        value = F.concat(F.lit("{{"), F.translate(sealed, "\r\n", ""), F.lit("}}"))  # Spark breaks base64 into lines of 76 characters
    elif kind == "FPE_ENCRYPT_REPLACE" and policy.secret("fpe", "key"):
        value, todo = plain, ask(fpe_key=policy.secret("fpe", "key"), fpe_tweak=policy.secret("fpe", "tweak"))
    elif kind in ("RANDOM_REPLACE", "SHIFT", "TRUNCATE_TO_YEAR", "RELATIVE") and (kind == "RANDOM_REPLACE" or name == "date"):
        value, todo = plain, ask()
    else:
        value = plain
    return F.struct(value.alias("value"), salt.alias("salt"), applied.alias("applied"), F.lit(options.get("color")).cast("string").alias("color"), todo.alias("todo")).cast(REPLACEMENT)


def chosen(strategies: list[dict], name: str, token: Column, context: Column, confidence: Column, classification: Column, seed: Column, policy, population=None, mappings=None, secret: bytes | None = None) -> Column:
    """REPLACEMENT of the first strategy whose condition holds; null where none does."""
    out = F.lit(None).cast(REPLACEMENT)
    for s in reversed(strategies):
        met = conditions.holds(s.get("condition"), token, context, confidence, classification, population)
        out = F.when(met, one(s, name, token, classification, seed, policy, mappings, secret)).otherwise(out)
    return out
