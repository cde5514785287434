"""Digests, keyed digests, signatures and sealed (encrypted) values."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEX_SLICE = 13  # 13 hex digits = 52 bits, exact in both BIGINT and DOUBLE
TWO_52 = float(1 << 52)
HMAC_BLOCK = 64


def text_of(value: Column, dtype: T.DataType | None = None) -> Column:
    """The text whose bytes are hashed.

    Floating-point keys are refused: their text form differs between engines
    (``1e16`` and ``1.0E16``), so equal keys could hash differently.
    A timestamp is hashed by its microseconds since 1970 in UTC, in any session
    zone; decimals without their trailing zeros, so that the scale of a key's
    type does not matter.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        raise TypeError("floating-point values have no stable text form; cast to decimal first")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.regexp_replace(value.cast("string"), r"\.?0+$", "")
    return value.cast("string")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def slice52(digest: Column, slot: int = 0) -> Column:
    """The ``slot``-th 52-bit number of a SHA-256 hex digest (slots 0 to 3)."""
    piece = F.substring(digest, 1 + HEX_SLICE * slot, HEX_SLICE)
    return F.conv(piece, 16, 10).cast("long")


def digest52(text: Column) -> Column:
    """A 52-bit number derived from the text; equal text gives equal numbers on every engine."""
    return slice52(sha256_hex(text))


def derive_key(secret: str | bytes) -> str:
    """URL-safe base64 of SHA-256(secret), computed once on the driver."""
    raw = secret.encode() if isinstance(secret, str) else secret
    return base64.urlsafe_b64encode(hashlib.sha256(raw).digest()).decode()


def keyed_digest(text: Column, key: str, scope: str = "") -> Column:
    """SHA-256 over key, scope and value.  Without a scope it is the salted key hash of the vault."""
    prefix = key + (f"|{scope}|" if scope else "")
    return sha256_hex(F.concat(F.lit(prefix), text))


def hmac_sha256(text: Column, secret: str | bytes) -> Column:
    """RFC 2104 HMAC-SHA256 as two nested digests; the padded keys are driver-side constants."""
    raw = secret.encode() if isinstance(secret, str) else secret
    if len(raw) > HMAC_BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(HMAC_BLOCK, b"\0")
    inner_pad = bytes(b ^ 0x36 for b in raw)
    outer_pad = bytes(b ^ 0x5C for b in raw)
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def short_hash(text: Column) -> Column:
    return F.substring(sha256_hex(text), 1, 16)


def short_token(text: Column) -> Column:
    return F.concat(F.lit("TOK-"), F.upper(F.substring(sha256_hex(text), 1, 8)))


def seal(text: Column, key: str) -> Column:
    """Encrypt with AES-GCM, base64 text.

    The nonce is derived from the keyed digest of the value, so a retried
    task or a replayed batch writes the same bytes again.
    """
    nonce = F.unhex(F.substring(keyed_digest(text, key, "nonce"), 1, 24))
    cipher = F.aes_encrypt(
        F.encode(text, "UTF-8"),
        F.lit(hashlib.sha256(key.encode()).digest()),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        nonce,
    )
    return F.base64(cipher)


def unseal(cipher_text: Column, key: str) -> Column:
    plain = F.aes_decrypt(
        F.unbase64(cipher_text),
        F.lit(hashlib.sha256(key.encode()).digest()),
        F.lit("GCM"),
        F.lit("DEFAULT"),
    )
    return F.decode(plain, "UTF-8")
