"""Field-bound authenticated encryption of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.core import as_column, bind

# AES-256-GCM with a 12-byte nonce and a 16-byte tag, kept as three base64 strings.
NONCE_BYTES = 12
TAG_BYTES = 16
KEY_BYTES = 32


def key_literal(key: bytes) -> Column:
    if len(key) != KEY_BYTES:
        raise ValueError(f"a key has {KEY_BYTES} bytes")
    return F.lit(bytearray(key))


def bound_data(field: str, memory_id: Column | str) -> Column:
    """Authenticated data: a payload only opens as its own field of its own row."""
    return F.concat(F.lit('{"field":"' + field + '","id":"'), as_column(memory_id), F.lit('"}'))


def encrypt(plain: Column, key: bytes, field: str, memory_id: Column | str) -> Column:
    """struct(enc, iv, tag) under a fresh nonce. The sealed bytes are bound once: cutting two
    slices of separately evaluated calls would mix two nonces."""
    sealed = F.aes_encrypt(plain, key_literal(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""),
                           bound_data(field, memory_id))

    def parts(c: Column) -> Column:
        body = F.octet_length(c) - (NONCE_BYTES + TAG_BYTES)
        return F.struct(
            F.base64(F.substring(c, F.lit(NONCE_BYTES + 1), body)).alias("enc"),
            F.base64(F.substring(c, 1, NONCE_BYTES)).alias("iv"),
            F.base64(F.substring(c, F.lit(NONCE_BYTES + 1) + body, F.lit(TAG_BYTES))).alias("tag"))

    return bind(sealed, parts)


def decrypt(payload: Column | str, key: bytes, field: str, memory_id: Column | str) -> Column:
    """Plain text, or null where authentication fails or a part is missing."""
    p = as_column(payload)
    sealed = F.concat(*[F.try_to_binary(p[n], F.lit("base64")) for n in ("iv", "enc", "tag")])
    opened = F.try_aes_decrypt(sealed, key_literal(key), F.lit("GCM"), F.lit("DEFAULT"),
                               bound_data(field, memory_id))
    return F.try_validate_utf8(opened.cast("string"))
