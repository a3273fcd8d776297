"""Digests, stable ids and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def digest(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts; null differs from empty."""
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


def uuid8(hex_digest: Column) -> Column:
    """UUID of version 8 from the first 16 bytes of a digest in hex."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(hex_digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    piece = lambda at, n: F.substring(hex_digest, at, n)
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-8"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def content_leaf(*parts: Column) -> Column:
    """A record's leaf in hex; leaves of a source are added, so order doesn't matter."""
    return digest(*parts)


def leaf_sum(leaf: Column) -> Column:
    """Sum of leaves modulo 2^256, as sixteen sums of 16-bit limbs, in hex.

    Limb sums stay below 2^63 for 2^47 rows and are carried at the end, so the
    aggregate is partial on every executor.
    """
    limbs = [F.sum(F.conv(F.substring(leaf, 1 + 4 * i, 4), 16, 10).cast("long")) for i in range(16)]
    carry, out = F.lit(0).cast("long"), []
    for limb in reversed(limbs):
        total = limb + carry
        out.append(F.lpad(F.lower(F.hex(total.bitwiseAND(F.lit(0xFFFF)))), 4, "0"))
        carry = F.shiftrightunsigned(total, 16)
    return F.concat(*reversed(out))
