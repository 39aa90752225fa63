"""Format-preserving encryption (FF1 with AES-256) over Arrow batches, and deterministic tokens as native expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 36: BASE36, 62: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}


_KNOWN: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The AES substitution box and doubling in its field, from their definitions."""
    if "box" in _KNOWN:
        return _KNOWN["box"]
    double = np.array([(x << 1) ^ (0x11B if x & 0x80 else 0) for x in range(256)], np.uint16).astype(np.uint8)
    times = lambda a, b: 0 if not b else (times(int(double[a]), b >> 1) ^ (a if b & 1 else 0))
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = a
            for _ in range(253):
                b = times(b, a)
            inverse[a], inverse[b] = b, a
    turn = lambda x, k: ((x << k) | (x >> (8 - k))) & 255
    box = np.array([x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse], np.uint8)
    _KNOWN["box"] = box, double
    return box, double


def _round_keys(key: bytes) -> np.ndarray:
    if key in _KNOWN:
        return _KNOWN[key]
    box, double = _tables()
    words = len(key) // 4
    w = [np.frombuffer(key[4 * i : 4 * i + 4], np.uint8) for i in range(words)]
    constant = np.uint8(1)
    for i in range(words, 4 * (words + 7)):
        t = w[-1]
        if i % words == 0:
            t = box[np.roll(t, -1)].copy()
            t[0] ^= constant
            constant = double[constant]
        elif words > 6 and i % words == 4:
            t = box[t]
        w.append(w[i - words] ^ t)
    _KNOWN[key] = np.concatenate(w).reshape(-1, 16)
    return _KNOWN[key]


SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])


def aes(blocks: np.ndarray, key: bytes) -> np.ndarray:
    """AES of many 16-byte blocks (rows) at once."""
    box, double = _tables()
    keys = _round_keys(key)
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = box[s][:, SHIFT].reshape(-1, 4, 4)
        near = np.roll(s, -1, axis=2)
        s = (double[s ^ near] ^ s ^ (s[:, :, [0]] ^ s[:, :, [1]] ^ s[:, :, [2]] ^ s[:, :, [3]])).reshape(-1, 16) ^ k
    return box[s][:, SHIFT] ^ keys[-1]


def ff1(values: list[str], tweaks: list[bytes], radix: int, key: bytes, decrypt: bool = False) -> list[str]:
    """FF1 (NIST SP 800-38G) of values over the radix' alphabet; values of one length and tweaks of one length go together."""
    alphabet = ALPHABETS[radix]
    at = {c: i for i, c in enumerate(alphabet)}
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (v, t) in enumerate(zip(values, tweaks, strict=True)):
        groups.setdefault((len(v), len(t)), []).append(i)
    out = list(values)
    for (n, t), members in groups.items():
        u = n // 2
        v = n - u
        b = -(-((radix**v - 1).bit_length()) // 8)
        d = 4 * -(-b // 4) + 4
        head = bytes([1, 2, 1]) + radix.to_bytes(3, "big") + bytes([10, u % 256]) + n.to_bytes(4, "big") + t.to_bytes(4, "big")
        pad = bytes((-t - b - 1) % 16)
        number = lambda s: int("".join(map(str, (at[c] for c in s)))) if radix == 10 else sum(at[c] * radix**k for k, c in enumerate(reversed(s)))
        left, right = [number(values[i][:u]) for i in members], [number(values[i][u:]) for i in members]
        for step in reversed(range(10)) if decrypt else range(10):
            fed = left if decrypt else right
            data = [head + tweaks[i] + pad + bytes([step]) + x.to_bytes(b, "big") for i, x in zip(members, fed, strict=True)]
            blocks = np.frombuffer(b"".join(data), np.uint8).reshape(len(members), -1, 16)
            mac = np.zeros((len(members), 16), np.uint8)
            for k in range(blocks.shape[1]):
                mac = aes(mac ^ blocks[:, k], key)
            stream = [mac]
            for k in range(1, -(-d // 16)):
                stream.append(aes(mac ^ np.frombuffer(k.to_bytes(16, "big"), np.uint8), key))
            raw = np.concatenate(stream, axis=1)[:, :d]
            m = radix ** (u if step % 2 == 0 else v)
            y = [int.from_bytes(r.tobytes(), "big") for r in raw]
            if decrypt:
                left, right = [(x - z) % m for x, z in zip(right, y, strict=True)], left
            else:
                left, right = right, [(x + z) % m for x, z in zip(left, y, strict=True)]
        for i, x, z in zip(members, left, right, strict=True):
            text = []
            for value, size in ((x, u), (z, v)):
                part = []
                for _ in range(size):
                    value, digit = divmod(value, radix)
                    part.append(alphabet[digit])
                text.append("".join(reversed(part)))
            out[i] = "".join(text)
    return out


def ff1_column(text: Column, tweak: Column, radix: Column, least: Column, key: bytes, decrypt: bool = False) -> Column:
    """FF1 of the characters of the radix' alphabet in a text; all others keep their places. Null where fewer than `least` are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, tweaks: pd.Series, radixes: pd.Series, leasts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        for radix in radixes.dropna().unique():
            if radix < 2:
                continue
            chars, rows, bare = set(ALPHABETS[int(radix)]), [], []
            for i in np.flatnonzero((radixes == radix).to_numpy()):
                own = "".join(c for c in texts.iloc[i] or "" if c in chars)
                if len(own) >= max(2, leasts.iloc[i]):
                    rows.append(i)
                    bare.append(own)
            done = ff1(bare, [bytes(tweaks.iloc[i]) for i in rows], int(radix), key, decrypt)
            for i, new in zip(rows, done, strict=True):
                left = iter(new)
                out.iloc[i] = "".join(next(left) if c in chars else c for c in texts.iloc[i])
        return out

    return run(text, tweak, radix, least)


def tweak(request_id: Column, place: Column) -> Column:
    """The request's 16 bytes, then the first 16 of sha256 of where the value stands."""
    return F.concat(F.unhex(F.regexp_replace(request_id, "-", "")), F.substring(F.unhex(F.sha2(place, 256)), 1, 16))


def base36_4(hex8: Column) -> Column:
    """Eight hex digits as a number, its last four digits to the base 36."""
    number = F.conv(hex8, 16, 10).cast("long") % 36**4
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), 4, "0")


def token(prefix: Column, request_id: Column, value: Column) -> Column:
    """PREFIX_ and four characters of sha256(request bytes, value)."""
    digest = F.sha2(F.concat(F.unhex(F.regexp_replace(request_id, "-", "")), F.encode(value, "UTF-8")), 256)
    return F.concat(prefix, F.lit("_"), base36_4(F.substring(digest, 1, 8)))
