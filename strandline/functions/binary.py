"""Column functions over bytes: hexadecimal, encryption, frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(c: Column) -> Column:
    return F.unhex(F.replace(c, F.lit(" "), F.lit("")))


def encrypt(c: Column, key: str, fixed_iv: bool = False) -> Column:
    """AES-CBC with the first 32 characters of key; bytes: IV, then cipher text.

    The IV is random. With fixed_iv it is the key's first 16 characters, and the result is the cipher
    text alone: only to read and write older data.
    """
    secret = F.lit(key[:32])
    if not fixed_iv:
        return F.aes_encrypt(c, secret, F.lit("CBC"), F.lit("PKCS"))
    iv = F.lit(key[:16].encode())
    return F.substring(F.aes_encrypt(c, secret, F.lit("CBC"), F.lit("PKCS"), iv), 17, 2_000_000_000)


def decrypt(c: Column, key: str, fixed_iv: bool = False) -> Column:
    whole = F.concat(F.lit(key[:16].encode()), c) if fixed_iv else c
    return F.aes_decrypt(whole, F.lit(key[:32]), F.lit("CBC"), F.lit("PKCS"))


def encrypt_head(c: Column, key: str) -> Column:
    """The first 16 bytes encrypted (32 with padding), the rest as it is; null under 16 bytes."""
    head = encrypt(F.substring(c, 1, 16), key, True)
    return F.when(F.length(c) >= 16, F.concat(head, F.substring(c, 17, 2_000_000_000)))


def decrypt_head(c: Column, key: str) -> Column:
    return F.concat(decrypt(F.substring(c, 1, 32), key, True), F.substring(c, 33, 2_000_000_000))


def int32(c: Column, at: Column | int) -> Column:
    """Signed big-endian integer of four bytes from position `at` (from 1); null where they lack."""
    part = F.substring(c, at, F.lit(4)) if isinstance(at, Column) else F.substring(c, at, 4)
    value = F.conv(F.hex(part), 16, 10).cast("long")
    signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)
    return F.when(F.length(part) == 4, signed.cast("int"))


def byte_at(c: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(c, at, 1)), 16, 10).cast("int")


def four_bytes(n: Column) -> Column:
    """A non-negative integer as four big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def frame(kind: int, flags: int, serialisation: int, event: Column | None, session: Column | None, payload: Column) -> Column:
    """A binary frame: four header bytes, event, session and payload with their lengths."""
    head = F.unhex(F.lit(f"11{kind:X}{flags:X}{serialisation:X}000"))
    parts = [head]
    if event is not None:
        parts.append(four_bytes(event))
    if session is not None:
        parts += [four_bytes(F.length(session)), session]
    return F.concat(*parts, four_bytes(F.length(payload)), payload)
