"""Encryption and blind index of stored values."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prefix of an encrypted cell.
CIPHER_PREFIX = "bf:v1:"


def derive_key(root: bytes, purpose: str) -> bytes:
    """HKDF with SHA-256, one block, no salt (RFC 5869)."""
    pseudo = hmac.new(bytes(32), root, hashlib.sha256).digest()
    return hmac.new(pseudo, purpose.encode() + b"\x01", hashlib.sha256).digest()


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a text in lower-case hexadecimal, composed of two hashes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "utf-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def encrypt(value: Column, key: bytes, context: Column) -> Column:
    """AES-GCM with a fresh nonce; the context must be given again to decrypt."""
    raw = F.aes_encrypt(F.encode(value, "utf-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode(context, "utf-8"))
    return F.concat(F.lit(CIPHER_PREFIX), F.base64(raw))


def decrypt(cell: Column, key: bytes, context: Column) -> Column:
    """Null for a cell without the prefix or with another context or key."""
    raw = F.unbase64(F.regexp_replace(cell, "^" + CIPHER_PREFIX, ""))
    plain = F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.encode(context, "utf-8"))
    return F.when(cell.startswith(CIPHER_PREFIX), F.decode(plain, "utf-8"))
