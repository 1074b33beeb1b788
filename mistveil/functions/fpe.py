"""Format-preserving encryption (FF3 and FF3-1, radix 10) and AES of one block, in plain Python: published algorithms."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=1)
def _sbox() -> bytes:
    """The AES substitution box, from inverses in GF(2^8)."""
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    for i in range(255, 512):
        exp[i] = exp[i - 255]
    out = []
    for v in range(256):
        q = exp[255 - log[v]] if v else 0
        r = 0x63
        for k in range(5):
            r ^= ((q << k) | (q >> (8 - k))) & 0xFF
        out.append(r)
    return bytes(out)


@lru_cache(maxsize=16)
def _round_keys(key: bytes) -> list[bytes]:
    s, n = _sbox(), len(key) // 4
    words, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = bytes(s[b] for b in t[1:] + t[:1])
            t = bytes([t[0] ^ rcon]) + t[1:]
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            t = bytes(s[b] for b in t)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], t, strict=True)))
    return [b"".join(words[4 * r : 4 * r + 4]) for r in range(n + 7)]


def aes_block(key: bytes, block: bytes) -> bytes:
    keys, s = _round_keys(key), _sbox()
    double = lambda b: ((b << 1) ^ (0x1B if b & 0x80 else 0)) & 0xFF
    state = bytes(a ^ b for a, b in zip(block, keys[0], strict=True))
    for r, k in enumerate(keys[1:], 1):
        state = bytes(s[state[(i + 4 * (i % 4)) % 16]] for i in range(16))
        if r < len(keys) - 1:
            mixed = []
            for c in range(0, 16, 4):
                a = state[c : c + 4]
                every = a[0] ^ a[1] ^ a[2] ^ a[3]
                mixed += [a[i] ^ every ^ double(a[i] ^ a[(i + 1) % 4]) for i in range(4)]
            state = bytes(mixed)
        state = bytes(a ^ b for a, b in zip(state, k, strict=True))
    return state


def _halves(tweak: bytes) -> tuple[bytes, bytes]:
    if len(tweak) == 7:
        return tweak[:3] + bytes([tweak[3] & 0xF0]), tweak[4:7] + bytes([(tweak[3] & 0x0F) << 4])
    if len(tweak) == 8:
        return tweak[:4], tweak[4:]
    raise ValueError("a tweak has 7 or 8 bytes")


def ff3(key: str, tweak: str, digits: str, decrypt: bool = False) -> str:
    """Encrypt 6 to 56 decimal digits. key: 16, 24 or 32 bytes in hex; tweak: 7 (FF3-1) or 8 (FF3) bytes in hex."""
    if not (6 <= len(digits) <= 56 and digits.isascii() and digits.isdigit()):
        raise ValueError("6 to 56 digits can be encrypted")
    k = bytes.fromhex(key)
    if len(k) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    left, right = _halves(bytes.fromhex(tweak))
    u = (len(digits) + 1) // 2
    a, b = digits[:u], digits[u:]
    for i in range(7, -1, -1) if decrypt else range(8):
        m, w = (u, right) if i % 2 == 0 else (len(digits) - u, left)
        source = a if decrypt else b
        p = bytes([w[0], w[1], w[2], w[3] ^ i]) + int(source[::-1] or "0").to_bytes(12, "big")
        y = int.from_bytes(aes_block(k[::-1], p[::-1])[::-1], "big")
        if decrypt:
            c = (int(b[::-1]) - y) % 10**m
            b, a = a, str(c).zfill(m)[::-1]
        else:
            c = (int(a[::-1]) + y) % 10**m
            a, b = b, str(c).zfill(m)[::-1]
    return a + b


def encrypt_token(key: str, tweak: str, token: str, decrypt: bool = False) -> str | None:
    """The letters and digits of a token encrypted in place; separators stay. None where it can't be done (letters, length)."""
    at = [i for i, c in enumerate(token) if c.isalnum()]
    try:
        done = ff3(key, tweak, "".join(token[i] for i in at), decrypt)
    except ValueError:
        return None
    out = list(token)
    for i, c in zip(at, done, strict=True):
        out[i] = c
    return "".join(out)
