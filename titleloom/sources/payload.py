"""Decoder of the URI-safe dictionary-compressed text fragments carry.

A payload is a bit stream, six bits per character, most significant first;
codes are read least significant bit first and grow by one bit as the
dictionary fills. Code 0 announces an 8-bit character, 1 a 16-bit one, 2 the
end.
"""

from __future__ import annotations

import re

# Fixed value: the alphabet of the URI-safe encoding. The last sign pads with zero bits.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-$"

_KNOWN = re.compile(r"[A-Za-z0-9+$-]*")
# Per character its six bits, first bit lowest, as two octal digits.
_OCTAL = {ord(c): format(int(f"{v & 63:06b}"[::-1], 2), "02o") for v, c in enumerate(ALPHABET)}
_STEP = 64  # characters taken from the payload at a time

LOST = "payload not decodable"
NOT_TEXT = "payload is not valid UTF-16"


def decompress(payload: str) -> str | None:
    """Text of UTF-16 code units, or None for a broken stream."""
    payload = payload.replace(" ", "+")
    if not _KNOWN.fullmatch(payload):
        return None
    left = 6 * len(payload)
    words: list[str] = ["", "", ""]  # codes 0..2 are control codes
    out: list[str] = []
    known = 3  # words there are
    width, room = 2, 1  # the first code is two bits and fills the first slot
    last = ""
    window, held, at = 0, 0, 0  # bits taken from the stream but not used yet
    while True:
        if held < 64 and at < len(payload):
            chunk = payload[at : at + _STEP]
            window |= int(chunk[::-1].translate(_OCTAL), 8) << held
            held += 6 * len(chunk)
            at += _STEP
        left -= width
        if left < 0:
            return None
        code = window & ((1 << width) - 1)
        window >>= width
        held -= width
        if code > 2:
            if code < known:
                word = words[code]
            elif code == known and last:
                word = last + last[0]
            else:
                return None
        elif code == 2:
            return "".join(out)
        else:
            size = 16 if code else 8
            left -= size
            if left < 0:
                return None
            word = chr(window & ((1 << size) - 1))
            window >>= size
            held -= size
            words.append(word)
            known += 1
            # The opening character only takes a slot; later ones also use up room.
            if last:
                room -= 1
                if room == 0:
                    room, width = 1 << width, width + 1
        out.append(word)
        if last:
            words.append(last + word[0])
            known += 1
            room -= 1
            if room == 0:
                room, width = 1 << width, width + 1
        else:
            width, room = 3, 4
        last = word


def decode_text(payload: str | None) -> tuple[str | None, str | None]:
    """(text, error), one of them None."""
    if not payload:
        return None, LOST
    units = decompress(payload)
    if units is None:
        return None, LOST
    try:
        return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le"), None
    except UnicodeDecodeError:
        return None, NOT_TEXT
