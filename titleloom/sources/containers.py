"""Bencoded containers to file rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_CHUNK = 8192
_DIGITS, _SIGNED = re.compile(rb"[0-9]+"), re.compile(rb"-?[0-9]+")
_MOST, _LEAST = 2**63 - 1, -(2**63)


def _number(digits: bytes, signed: bool) -> int:
    """ASCII digits, nothing else; Python's own conversion takes blanks, signs and underscores."""
    if not (_SIGNED if signed else _DIGITS).fullmatch(digits) or len(digits) > 20:
        raise ValueError("not a number")
    return int(digits)


def _parse(data: bytes, at: int = 0) -> tuple[Any, int]:
    """One bencoded value and the offset behind it: int, bytes, list or dict. Any depth: open lists
    and dictionaries wait on a stack of their own."""
    open_values: list[tuple[bytes, list]] = []
    while True:
        head = data[at : at + 1]
        if head in (b"l", b"d"):
            open_values.append((head, []))
            at += 1
            continue
        if head == b"i":
            end = data.index(b"e", at)
            value: Any = _number(data[at + 1 : end], True)
            if not _LEAST <= value <= _MOST:
                raise ValueError("number out of range")
            at = end + 1
        elif head.isdigit():
            colon = data.index(b":", at)
            size = _number(data[at:colon], False)
            value = data[colon + 1 : colon + 1 + size]
            if len(value) != size:
                raise ValueError("text cut short")
            at = colon + 1 + size
        elif head == b"e" and open_values:
            kind, values = open_values.pop()
            value, at = values, at + 1
            if kind == b"d":
                keys = values[::2]
                if len(values) % 2 or not all(isinstance(k, bytes) for k in keys):
                    raise ValueError("bad dictionary")
                value = dict(zip(keys, values[1::2]))
        else:
            raise ValueError("unknown value")
        if not open_values:
            return value, at
        open_values[-1][1].append(value)


def _places(data: bytes, wrapped: bool) -> dict[bytes, int]:
    """Where the values of the file dictionary begin, of repeated keys the last.

    Walks the whole top value and builds nothing: open lists and dictionaries are marks on a stack, so
    memory follows the depth, not the number of values. What is not well-formed raises ValueError.
    """
    stack: list[list] = []  # kind, values so far, last key, whether it is the file dictionary
    found: dict[bytes, int] | None = None
    at = 0
    while True:
        head = data[at : at + 1]
        top = stack[-1] if stack else None
        wanted = False
        if top and top[0] == b"d" and head != b"e":
            if top[1] % 2 == 0:
                if not head.isdigit():
                    raise ValueError("bad dictionary")
                if len(stack) <= 2:  # deeper keys are not looked at
                    top[2] = _parse(data, at)[0]
            elif top[3]:
                found[top[2]] = at
            wanted = wrapped and len(stack) == 1 and top[1] % 2 == 1 and top[2] == b"info"
        if wanted or not (wrapped or stack):
            wanted, found = head == b"d", {} if head == b"d" else None
        if head in (b"l", b"d"):
            stack.append([head, 0, None, wanted])
            at += 1
            continue
        if head == b"i":
            end = data.index(b"e", at)
            if not _LEAST <= _number(data[at + 1 : end], True) <= _MOST:
                raise ValueError("number out of range")
            at = end + 1
        elif head.isdigit():
            colon = data.index(b":", at)
            at = colon + 1 + _number(data[at:colon], False)
            if at > len(data):
                raise ValueError("text cut short")
        elif head == b"e" and stack:
            if top[0] == b"d" and top[1] % 2:
                raise ValueError("bad dictionary")
            stack.pop()
            at += 1
        else:
            raise ValueError("unknown value")
        if not stack:
            if found is None:
                raise ValueError("no file dictionary")
            return found
        stack[-1][1] += 1


def _text(value: Any) -> str | None:
    try:
        return value.decode() if isinstance(value, bytes) else None
    except UnicodeDecodeError:
        return None


def _files(content: bytes, wrapped: bool) -> Iterator[tuple[str, int, int]]:
    """(path, size, position). Entries without a path are dropped but keep their position.

    The container is checked as a whole first; then one entry after the other is read and given out.
    """
    places = _places(content, wrapped)
    if b"files" not in places:
        name, size = (_parse(content, places[k])[0] if k in places else None for k in (b"name", b"length"))
        if _text(name) is None or not isinstance(size, int):
            raise ValueError("name or length missing")
        yield _text(name), size, 0
        return
    at = places[b"files"]
    if content[at : at + 1] != b"l":
        raise ValueError("files is not a list")
    at, position = at + 1, 0
    while content[at : at + 1] != b"e":
        entry, at = _parse(content, at)
        if isinstance(entry, dict):
            size, parts = entry.get(b"length"), entry.get(b"path")
            texts = [_text(p) for p in parts] if isinstance(parts, list) else []
            path = "/".join(t for t in texts if t is not None)
            if path:
                yield path, size if isinstance(size, int) else 0, position
        position += 1


def container_files(containers: DataFrame, wrapped: bool = True) -> DataFrame:
    """``key, content`` to ``key, path, size, file_index, error``.

    Files come out as rows with error NULL, a broken container as one row with
    only the error. ``wrapped`` containers hold the dictionary under ``info``.
    Rows leave in chunks, so a container with very many files is never held as
    one Arrow batch.
    """
    schema = "key string, path string, size bigint, file_index int, error string"
    names = ["key", "path", "size", "file_index", "error"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            keys, contents = batch.column("key").to_pylist(), batch.column("content")
            for key, content in zip(keys, contents):
                try:
                    for path, size, position in _files(content.as_py() or b"", wrapped):
                        rows.append((key, path, size, position, None))
                        if len(rows) >= _CHUNK:
                            yield pack(rows)
                            rows = []
                except ValueError as problem:
                    rows.append((key, None, None, None, str(problem)))
        if rows:
            yield pack(rows)

    return containers.select("key", "content").mapInArrow(run, schema)
