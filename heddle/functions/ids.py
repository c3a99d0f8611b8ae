"""Hashes, identifiers, masks, signatures and encryption."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def namespaced_hash(namespace: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(namespace + "\0"), c), 256)


def _dashed(h: Column) -> Column:
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def uuid7(namespace: str, c: Column, masked_variant: bool = False) -> Column:
    """A version-7-shaped id of a value. The variant digit is 8, or with masked_variant the hash digit's low bits under 8."""
    h = F.overlay(F.substring(F.sha2(F.concat(F.lit(namespace + ":"), c), 256), 1, 32), F.lit("7"), F.lit(13))
    digit = F.lit("8")
    if masked_variant:
        digit = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return _dashed(F.overlay(h, digit, F.lit(17)))


def is_uuid7(c: Column) -> Column:
    return F.lower(c).rlike(UUID7)


def batch_number(c: Column, i: Column | None = None) -> Column:
    n = F.conv(F.substring(F.sha2(c, 256), 1, 7), 16, 10).cast("long")
    return n if i is None else n * 100 + i


def masked_email(c: Column) -> Column:
    local, host = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    return F.concat(F.when(F.length(local) <= 2, F.substring(local, 1, 1)).otherwise(F.substring(local, 1, 2)), F.lit("***@"), host)


def masked_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"^\++", "")
    n = F.length(digits)
    return F.when(n <= 4, "+***").otherwise(F.concat(F.lit("+"), F.repeat(F.lit("*"), F.greatest(F.lit(3), n - 4)), F.right(digits, F.lit(4))))


def masked_handle(c: Column) -> Column:
    return F.when(F.length(c) <= 4, F.concat(F.substring(c, 1, 1), F.lit("***"))).otherwise(F.concat(F.substring(c, 1, 2), F.lit("***"), F.right(c, F.lit(2))))


def masked_token(c: Column) -> Column:
    return F.when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("..."), F.right(c, F.lit(4))))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC; the padded keys are made here, so the key itself stands in no plan."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def seal(value: Column, key: Column, nonce: Column, aad: Column, version: str = "1") -> Column:
    """AES-256-GCM envelope prefix:version:nonce:ciphertext, both in URL-safe base64 without padding. nonce: 12 bytes, new for each value."""
    raw = F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    b64 = lambda b: F.translate(F.rtrim(F.base64(b), F.lit("=")), "+/\r\n", "-_")  # base64 breaks long lines
    return F.concat_ws(":", F.lit("si-aesgcm"), F.lit("v1"), F.lit(version), b64(F.substring(raw, 1, 12)), b64(F.substring(raw, 13, 1 << 30)))


def open_sealed(envelope: Column, key: Column, aad: Column) -> Column:
    """The sealed value; null if it was tampered with or the key or aad is another."""
    part = lambda i: F.unbase64(F.translate(F.split_part(envelope, F.lit(":"), F.lit(i)), "-_", "+/"))
    return F.try_aes_decrypt(F.concat(part(4), part(5)), key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
