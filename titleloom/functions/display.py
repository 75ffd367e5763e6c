"""Text forms used by the read side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KB, _MB, _GB = 10, 20, 30  # bits per unit


def _fixed(size: Column, bits: int, digits: int) -> Column:
    # Integer arithmetic, halves up: exact where a rounded double would not be.
    scale, unit = 10**digits, 1 << bits
    rest = F.shiftright((size % unit) * (2 * scale) + unit, bits + 1)
    total = F.shiftright(size, bits) * scale + rest
    if digits == 0:
        return total.cast("string")
    return F.concat(
        F.floor(total / scale).cast("string"),
        F.lit("."),
        F.lpad((total % scale).cast("string"), digits, "0"),
    )


def size_text(size: Column) -> Column:
    """0 B, or KB / MB / GB with 0 / 1 / 2 decimals, 1024-based."""
    size = size.cast("bigint")
    return (
        F.when(size.isNull() | (size == 0), "0 B")
        .when(size >= 1 << _GB, F.concat(_fixed(size, _GB, 2), F.lit(" GB")))
        .when(size >= 1 << _MB, F.concat(_fixed(size, _MB, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(size, _KB, 0), F.lit(" KB")))
    )


def rfc3339(ts: Column) -> Column:
    """UTC text with no, three or six fraction digits, whichever is exact (session zone UTC)."""
    micros = F.unix_micros(ts) % 1_000_000
    micros = F.when(micros < 0, micros + 1_000_000).otherwise(micros)
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def completion_percent(completed: Column, unresolved: Column, exhausted: Column) -> Column:
    total = completed + unresolved + exhausted
    return F.when(total > 0, F.floor(completed / total * 100 + 0.5).cast("int")).otherwise(0)
