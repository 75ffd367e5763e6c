"""Encoder for the payload codec, to derive encoded documents from tables."""

from __future__ import annotations

from array import array
from binascii import b2a_base64
from collections.abc import Iterator
from itertools import chain
from sys import byteorder

import pyarrow as pa
from pyspark.sql import DataFrame


# Base 64 takes bits highest first; the stream is kept lowest bit first.
_MIRRORED = bytes(int(f"{v:08b}"[::-1], 2) for v in range(256))
_HELD = 3072  # bits kept back at most: whole groups of base 64, three bytes each


def _signs(stream: int, size: int) -> str:
    """The characters of so many bytes of the stream, a multiple of three."""
    return b2a_base64(stream.to_bytes(size, "little").translate(_MIRRORED), newline=False).decode().replace("/", "-")


def compress(text: str) -> str:
    """Greedy dictionary coding of UTF-16 code units; the inverse of ``payload.decompress``."""
    raw = text.encode("utf-16-le", "surrogatepass")
    units = memoryview(raw).cast("H") if byteorder == "little" else array("H", raw)
    if byteorder != "little":
        units.byteswap()
    # A phrase is known by its code; one with a unit behind it by both in one number. Units have codes of their own.
    own: dict[int, int] = {}
    longer: dict[int, int] = {}
    unseen: set[int] = set()
    stream, filled = 0, 0  # the bit stream so far, first bit lowest
    width, room = 2, 2
    chars: list[str] = []
    count = 3  # codes given, with the three control codes
    phrase = -1  # code of the phrase
    last = 0  # its unit, while it is one alone
    for unit in chain(units, (-1,)):
        if unit >= 0:
            code = own.get(unit)
            if code is None:
                code = own[unit] = count
                unseen.add(count)
                count += 1
            if phrase < 0:
                phrase, last = code, unit
                continue
            key = phrase << 16 | unit
            known = longer.get(key)
            if known is not None:
                phrase = known
                continue
        elif phrase < 0:
            break
        if phrase in unseen:
            unseen.discard(phrase)
            if last > 255:
                stream |= (last << width | 1) << filled
                filled += width + 16
            else:
                stream |= last << (filled + width)
                filled += width + 8
            room -= 1
            if room == 0:
                room, width = 1 << width, width + 1
        else:
            stream |= phrase << filled
            filled += width
        room -= 1
        if room == 0:
            room, width = 1 << width, width + 1
        if filled >= _HELD:
            chars.append(_signs(stream & ((1 << _HELD) - 1), _HELD // 8))
            stream >>= _HELD
            filled -= _HELD
        if unit >= 0:
            longer[key] = count
            count += 1
            phrase, last = code, unit
    stream |= 2 << filled
    filled += width
    ends = filled // 6 + 1
    chars.append(_signs(stream, -(-ends // 4) * 3)[:ends])
    return "".join(chars)


def encode_texts(df: DataFrame, text: str, payload: str = "payload") -> DataFrame:
    """Replace a text column by its encoded payload."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = pa.array([compress(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [coded], [*keep, payload]
            )

    return df.mapInArrow(run, f"{schema}, {payload} string")
