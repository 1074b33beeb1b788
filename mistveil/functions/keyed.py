"""Values that only the holder of a secret can compute: nonces, salts and the numbers that random replacements are drawn with.

They hang on a secret, the place and the token, so a task that runs again gives the same. Without the secret nobody can try tokens
against what is published.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # bytes of a block of SHA-256


def fresh() -> bytes:
    """A secret that is drawn now and kept nowhere."""
    return secrets.token_bytes(32)


def given(secret: str | bytes) -> bytes:
    """A secret of a deployment as bytes; too short ones are refused, since they can be searched for."""
    raw = secret.encode() if isinstance(secret, str) else bytes(secret)
    if len(raw) < 16:
        raise ValueError("a secret has 16 bytes or more")
    return raw


def subkey(secret: bytes, use: str) -> bytes:
    """A key for one use: what is learnt about one tells nothing about another."""
    return hmac.new(secret, use.encode(), hashlib.sha256).digest()


def mac(key: bytes, *message: Column) -> Column:
    """HMAC-SHA-256 of the parts of a message (each with its length before it), as binary."""
    padded = key.ljust(_BLOCK, b"\0") if len(key) <= _BLOCK else hashlib.sha256(key).digest().ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    parts = [p for m in message for p in (F.encode(F.concat(F.octet_length(m.cast("string")).cast("string"), F.lit(":")), "UTF-8"), F.encode(m.cast("string"), "UTF-8"))]
    digest = lambda *x: F.unhex(F.sha2(F.concat(*x), 256))
    return digest(outer, digest(inner, *parts))
