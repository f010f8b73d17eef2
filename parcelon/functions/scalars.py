"""Scalar functions on columns; all stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DMS = r"^(-?)(\d{1,3})°([0-5]?\d)[′'](\d{1,2}(?:\.\d+)?)[″\"]$"


def blank_to_null(column: Column) -> Column:
    """A number from text; blanks become null, other text fails."""
    return F.nullif(F.trim(column), F.lit("")).cast("double")


def dms_to_degrees(column: Column) -> Column:
    """Degrees to nine places from text such as 129°30′00″; text of another form fails."""
    part = lambda i: F.regexp_extract(column, _DMS, i).cast("double")
    size = part(2) + part(3) / 60 + part(4) / 3600
    signed = F.when(F.regexp_extract(column, _DMS, 1) == "-", -size).otherwise(size)
    wrong = F.raise_error(F.concat(F.lit("no angle: "), column)).cast("double")
    return F.when(column.isNull(), F.lit(None).cast("double")).when(column.rlike(_DMS), F.round(signed, 9)).otherwise(wrong)


def split_ints(column: Column, separator: str = ";") -> Column:
    """Sorted whole numbers of a list in text; empty text gives an empty list."""
    parts = F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.transform(parts, lambda x: x.cast("int")))


def join_sorted(column: Column, separator: str = ";") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(column)).cast("array<string>"), separator)


def is_code(column: Column, digits: int = 5) -> Column:
    """Exactly so many ASCII digits; null is no code."""
    return F.coalesce(column.rlike(rf"\A[0-9]{{{digits}}}\z"), F.lit(False))


def short_id(prefix: str, column: Column) -> Column:
    """A prefix and the first 16 hexadecimal digits of the SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(column, 256), 1, 16))


def fits_bytes(column: Column, width: int) -> Column:
    """Text that fits a field of so many bytes in UTF-8; longer text fails rather than be cut."""
    long = F.raise_error(F.concat(F.lit(f"over {width} bytes: "), column)).cast("string")
    return F.when(F.octet_length(column) > width, long).otherwise(column)


def on_grid(column: Column, places: int = 9) -> Column:
    """The value equals itself rounded to so many decimal places."""
    return F.format_string(f"%.{places}f", column).cast("double") == column


def geometry_flags(column: Column) -> Column:
    """Byte order, envelope kind and emptiness from the flags byte of a geometry's header."""
    byte = F.conv(F.hex(F.substring(column, 4, 1)), 16, 10).cast("int")
    bits = lambda at, mask: F.shiftright(byte, at).bitwiseAND(F.lit(mask))
    return F.struct((bits(0, 1) == 1).alias("little_endian"), bits(1, 7).alias("envelope"), (bits(4, 1) == 1).alias("empty"))


def double_bytes(column: Column) -> Column:
    """The eight bytes of a double by IEEE 754, big-endian; NaNs are all the same."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), column.cast("double")).cast("long")
    return F.when(column.isNotNull(), F.unhex(F.lpad(F.hex(bits), 16, "0")))


def length_bytes(column: Column) -> Column:
    """The number of bytes of a text or binary as eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(F.octet_length(column).cast("long")), 16, "0"))
