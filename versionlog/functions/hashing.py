"""Hash expressions that agree with 64-bit unsigned arithmetic, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = "14695981039346656037", "1099511628211"
#: Seed i of the seeded hashes is the text "000" followed by the digit i.
MAX_SEEDS = 10


def seed(i: Column) -> Column:
    return F.concat(F.lit("000"), i.cast("string"))


def md5_u64(data: Column, salt: Column | None = None) -> Column:
    """The first 8 bytes of md5(data ‖ salt) as an unsigned number, DECIMAL(20,0)."""
    both = data if salt is None else F.concat(data, salt)
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def md5_i64(data: Column) -> Column:
    """The same bits as a signed BIGINT."""
    return F.conv(F.substring(F.md5(data.cast("binary")), 1, 16), 16, -10).cast("long")


def fnv1a64(data: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, unsigned, DECIMAL(38,0); the multiplication is exact in decimals."""
    digits = F.hex(data.cast("binary"))
    n = F.octet_length(data)
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(digits.substr(2 * i - 1, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        mixed = (h - h % 256 + low.bitwiseXOR(b)) * F.lit(FNV_PRIME).cast("decimal(13,0)")
        return (mixed % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(38,0)")

    return F.aggregate(octets, F.lit(FNV_BASIS).cast("decimal(38,0)"), step)


def to_signed(h: Column) -> Column:
    return F.conv(h.cast("string"), 10, -10).cast("long")


def trailing_rank(h: Column) -> Column:
    """Trailing zero bits of a signed BIGINT, plus one; 65 of zero."""
    bits = F.bin(h)
    return F.when(h == 0, F.lit(65)).otherwise(F.length(bits) - F.length(F.rtrim(F.translate(bits, "0", " "))) + 1)


def record_crc(key: Column, value: Column) -> Column:
    """CRC32 of key ‖ value: what a record's checksum covers."""
    return F.crc32(F.concat(key, value))
