"""Decryption of protected columns and protection of sensitive ones.

Keys come from the caller or from a session setting, never from code. A key is
no literal of a plan: it stands in a table of one row that plans refer to, so
neither ``explain`` nor the event log show it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# the default redaction of Spark hides settings whose name holds "secret"
KEY_SETTING = "spark.fieldwarden.cipher.secret"
DIGEST_BLOCK = 64  # bytes that SHA-256 takes at a time


def cipher_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"no cipher key: set {KEY_SETTING}")
    return key


def hidden(value: bytes) -> Column:
    """A value that plans hold by reference: the only cell of a table."""
    return SparkSession.active().createDataFrame([(bytearray(value),)], "hidden binary").scalar()


def decrypt(value: Column, key: str) -> Column:
    """Clear text of a base64 AES value; null where the value does not decrypt."""
    cipher = F.try_to_binary(value, F.lit("base64"))
    return F.try_aes_decrypt(cipher, hidden(key.encode())).cast("string")


def encrypt(value: Column, key: str) -> Column:
    return F.base64(F.aes_encrypt(value, hidden(key.encode())))


def pseudonym(value: Column, key: str) -> Column:
    """HMAC-SHA256 of a text (RFC 2104) as lower-case hex; null stays null.

    Equal texts keep equal pseudonyms, so protected columns can be joined, and
    without the key no list of possible numbers gives them away.
    """
    secret = key.encode()
    if len(secret) > DIGEST_BLOCK:
        secret = hashlib.sha256(secret).digest()
    block = secret.ljust(DIGEST_BLOCK, b"\0")
    inner, outer = (hidden(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    inside = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, inside), 256)


def protect(value: Column, method: str, key: str | None = None) -> Column:
    """Protected form of a value: ``aes`` (reversible), ``hmac`` (joinable) or ``mask``."""
    if method == "mask":
        return F.mask(value)
    if method not in ("aes", "hmac"):
        raise ValueError(f"unknown method {method!r}")
    if not key:
        raise ValueError(f"{method} needs a key")
    return encrypt(value, key) if method == "aes" else pseudonym(value, key)


def protect_by_class(value: Column, class_name: Column, methods: Mapping[str, str], key: str | None = None) -> Column:
    """Pick the method by the detected class; other classes stay as they are."""
    out = value
    for name, method in methods.items():
        out = F.when(class_name == name, protect(value, method, key)).otherwise(out)
    return out
