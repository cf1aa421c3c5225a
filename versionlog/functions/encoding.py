"""Encoded lengths of records, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def varint_length(n: Column) -> Column:
    """Bytes of a nonnegative BIGINT in groups of 7 bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("long")


def plain_length(key: Column, value: Column, tombstone: Column) -> Column:
    """A record in a run: lengths, key, checksum, time, mark, and the value unless deleted."""
    return (F.octet_length(key) + F.when(tombstone, F.lit(21)).otherwise(F.lit(29) + F.octet_length(value))).cast("long")


def compressed_length(crc: Column, ts: Column, value: Column, tombstone: Column) -> Column:
    """The same with a dictionary id for the key and varints for checksum, time and length."""
    size = F.octet_length(value)
    tail = F.when(tombstone, F.lit(0)).otherwise(varint_length(size.cast("long")) + size)
    return (F.lit(9) + varint_length(crc) + varint_length(ts) + tail).cast("long")


def log_length(key: Column, value: Column) -> Column:
    """A record in the log: a fixed header of 29 bytes, key and value."""
    return (F.lit(29) + F.octet_length(key) + F.octet_length(value)).cast("long")


def index_entry_length(key: Column) -> Column:
    return (F.lit(16) + F.octet_length(key)).cast("long")


def display(key: Column, value: Column, tombstone: Column) -> Column:
    """Two spaces, or a cross for a deleted record, then key and value."""
    return F.concat(F.when(tombstone, F.lit("✝ ")).otherwise(F.lit("  ")), key, F.lit("\t"), value)


def next_name(last: Column, width: int = 4) -> Column:
    """The name after ``last``: a counter of at least ``width`` digits."""
    digits = (F.coalesce(last.cast("long"), F.lit(0)) + 1).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def _fixed(n: Column, width: int) -> Column:
    """A nonnegative number in ``width`` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def varint_bytes(n: Column) -> Column:
    """A nonnegative BIGINT in groups of 7 bits, the lowest first; all bytes but the last have the top bit set."""
    size = varint_length(n).cast("int")
    bits = F.lpad(F.bin(n), size * 7, "0")

    def octet(i: Column) -> Column:
        group = bits.substr((size - 1 - i) * 7 + 1, F.lit(7))
        return F.lpad(F.conv(F.concat(F.when(i < size - 1, "1").otherwise("0"), group), 2, 16), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), octet), ""))


def plain_bytes(key: Column, value: Column, ts: Column, tombstone: Column, crc: Column) -> Column:
    """A record as it stands in a run; a deleted one ends with its mark."""
    body = F.concat(F.unhex(F.lit("00")), _fixed(F.octet_length(value), 8), value.cast("binary"))
    return F.concat(_fixed(F.octet_length(key), 8), key.cast("binary"), _fixed(crc, 4), _fixed(ts, 8), F.when(tombstone, F.unhex(F.lit("01"))).otherwise(body))


def compressed_bytes(id_: Column, value: Column, ts: Column, tombstone: Column, crc: Column) -> Column:
    """The same with the key's dictionary id and varints."""
    body = F.concat(F.unhex(F.lit("00")), varint_bytes(F.octet_length(value).cast("long")), value.cast("binary"))
    return F.concat(_fixed(id_, 8), varint_bytes(crc), varint_bytes(ts), F.when(tombstone, F.unhex(F.lit("01"))).otherwise(body))


def log_bytes(key: Column, value: Column, ts: Column, tombstone: Column, crc: Column) -> Column:
    """A record as it stands in the log: fixed header, key, value."""
    mark = F.when(tombstone, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(_fixed(crc, 4), _fixed(ts, 8), mark, _fixed(F.octet_length(key), 8), _fixed(F.octet_length(value), 8), key.cast("binary"), value.cast("binary"))


def _number(data: Column, start: Column | int, width: int) -> Column:
    at = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.hex(F.substring(data, at, F.lit(width))), 16, 10).cast("long")


def decode_log(data: Column) -> Column:
    """The struct (key, value, ts, tombstone, crc) of a log record's bytes."""
    keys, values = _number(data, 14, 8).cast("int"), _number(data, 22, 8).cast("int")
    return F.struct(
        F.substring(data, F.lit(30), keys).cast("string").alias("key"), F.substring(data, keys + 30, values).cast("string").alias("value"),
        _number(data, 5, 8).alias("ts"), (_number(data, 13, 1) == 1).alias("tombstone"), _number(data, 1, 4).alias("crc"))


def decode_plain(data: Column) -> Column:
    """The struct (key, value, ts, tombstone, crc) of a run record's bytes; a deleted one has an empty value."""
    keys = _number(data, 1, 8).cast("int")
    dead = _number(data, keys + 21, 1) == 1
    size = F.when(dead, F.lit(0)).otherwise(_number(data, keys + 22, 8).cast("int"))
    return F.struct(
        F.substring(data, F.lit(9), keys).cast("string").alias("key"), F.when(dead, F.lit("")).otherwise(F.substring(data, keys + 30, size).cast("string")).alias("value"),
        _number(data, keys + 13, 8).alias("ts"), dead.alias("tombstone"), _number(data, keys + 9, 4).alias("crc"))
