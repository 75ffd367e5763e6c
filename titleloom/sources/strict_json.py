"""Strict JSON values as Catalyst expressions.

A document becomes a VARIANT, which keeps the types of JSON, so that a number is no text and a text no number. Spark's
parser takes the first value and passes over what follows; the document is therefore parsed as the first element
of an array with an element of ours behind it, and is whole only if exactly these two come out.
Keys that repeat in an object, numbers without a value and half surrogate pairs are refused. Strings may have any length
(``maxStringLen``); a document ends at the 128 MB of a variant, and nests at most 1000 deep.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = {"maxStringLen": str(2**31 - 1), "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
#: An escaped half of a surrogate pair without its other half; the backslash is no escaped one.
_HALF = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"


def parse(text: Column) -> Column:
    """The document as a variant; NULL for anything that is not one whole JSON document with distinct keys."""
    both = items(F.from_json(F.concat(F.lit("["), text, F.lit(",0]")), "variant", _OPTIONS))
    half = F.contains(F.lower(text), F.lit("\\ud")) & F.regexp_like(text, F.lit(_HALF))
    return F.when((F.size(both) == 2) & ~half, both[0])


def items(value: Column) -> Column:
    """The elements of an array, else NULL."""
    return F.try_variant_get(value, "$", "array<variant>")


def field(value: Column, key: str) -> Column:
    """A field of an object, NULL where it is absent; a JSON null is a value."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def is_null(value: Column) -> Column:
    """Absent, or a JSON null."""
    return value.isNull() | F.is_variant_null(value)


def text_of(value: Column) -> Column:
    """A string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def whole_of(value: Column) -> Column:
    """A non-negative whole number that fits a long, else NULL."""
    number = F.try_variant_get(value, "$", "bigint")
    return F.when((F.schema_of_variant(value) == "BIGINT") & (number >= 0), number)


def only(value: Column, keys: list[str]) -> Column:
    """The field named by one of the keys; NULL if the object has none or several of them."""
    return single([field(value, k) for k in keys])


def single(fields: list[Column]) -> Column:
    """The one value that is there; NULL for none or several."""
    present = sum((f.isNotNull().cast("int") for f in fields[1:]), fields[0].isNotNull().cast("int"))
    return F.when(present == 1, F.coalesce(*fields))
