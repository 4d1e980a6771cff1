"""Sealing of originals: AES-GCM encryption and keyed digests.

Keys live in a one-row table and enter the plan as scalar subqueries, so no key
shows up in ``explain()`` output, column names or event logs.
"""

from __future__ import annotations

import base64
import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import KDF_KEY_BYTES, KDF_ROUNDS, KDF_SALT_BYTES

_BLOCK = 64  # block size of SHA-256 in bytes


def derive_key(password: str, salt: bytes, rounds: int = KDF_ROUNDS) -> bytes:
    """PBKDF2-HMAC-SHA256, once per run on the driver."""
    return hashlib.pbkdf2_hmac(
        "sha256", password.encode(), salt, rounds, dklen=KDF_KEY_BYTES
    )


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    padded = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)


@dataclass(frozen=True)
class Keyring:
    """Key material of one mapping store."""

    table: DataFrame
    salt: bytes | None

    @staticmethod
    def from_key(
        spark: SparkSession, key: bytes, salt: bytes | None = None
    ) -> "Keyring":
        digest_key = hashlib.sha256(b"value digest" + key).digest()
        inner, outer = hmac_pads(digest_key)
        table = spark.createDataFrame(
            [(bytearray(key), bytearray(inner), bytearray(outer))],
            "enc_key binary, inner_pad binary, outer_pad binary",
        )
        return Keyring(table, salt)

    @staticmethod
    def from_password(
        spark: SparkSession,
        password: str,
        salt: bytes | None = None,
        rounds: int = KDF_ROUNDS,
    ) -> "Keyring":
        salt = salt if salt is not None else os.urandom(KDF_SALT_BYTES)
        return Keyring.from_key(spark, derive_key(password, salt, rounds), salt)

    @staticmethod
    def for_session(spark: SparkSession) -> "Keyring":
        """A random key that is kept nowhere: its mappings cannot be loaded."""
        return Keyring.from_key(spark, os.urandom(KDF_KEY_BYTES), None)

    @property
    def salt_text(self) -> str | None:
        return base64.b64encode(self.salt).decode() if self.salt else None

    def _key(self, name: str) -> Column:
        return self.table.select(name).scalar()

    def encrypt(self, text: Column) -> Column:
        return F.aes_encrypt(text, self._key("enc_key"), F.lit("GCM"))

    def decrypt(self, sealed: Column) -> Column:
        """The original, or NULL where the key is wrong."""
        return F.try_aes_decrypt(
            sealed, self._key("enc_key"), F.lit("GCM")
        ).cast("string")

    def digest(self, text: Column) -> Column:
        """HMAC-SHA256 of a value as hex: joinable, useless without the key."""
        inner = F.sha2(
            F.concat(self._key("inner_pad"), text.cast("binary")), 256
        )
        return F.sha2(F.concat(self._key("outer_pad"), F.unhex(inner)), 256)
