"""Explicit schemas for every table; readers never infer."""

from pyspark.sql import types as T

_QUEUE = [
    T.StructField("completed", T.BooleanType(), False),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("last_processed", T.TimestampType(), False),
]


def _struct(*fields: tuple[str, T.DataType], queue: bool = False) -> T.StructType:
    cols = [T.StructField(n, t, True) for n, t in fields]
    return T.StructType(cols + (_QUEUE if queue else []))


S, I, L, TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

LISTING = _struct(("path", S), ("type", S))
DOCUMENTS = _struct(("source", S), ("html", S))
CONTAINERS = _struct(("key", S), ("content", T.BinaryType()))
SOURCES = _struct(("name", S), queue=True)
ITEMS = _struct(("item_hash", S), ("filename", S), ("size_bytes", L), queue=True)
PARSED_ITEMS = _struct(
    ("item_hash", S), ("title", S), ("year", I), ("season", I), ("episode", I), queue=True
)
MAPPINGS = _struct(("item_hash", S), ("catalog_id", S), ("content_type", S), queue=True)
OUTPUTS = _struct(
    ("item_hash", S),
    ("catalog_id", S),
    ("output_type", S),
    ("size_bytes", L),
    ("file_index", I),
    ("season", I),
    ("episode", I),
    ("created_at", TS),
)
ITEM_FILES = _struct(("key", S), ("path", S), ("size", L), ("file_index", I))
# One row per candidate an external search returned for a lookup key.
# ``list`` names the search: a_movie, a_series, b_year or b_plain.
CANDIDATES = _struct(
    ("lookup_key", S),
    ("list", S),
    ("pos", I),
    ("id", S),
    ("name", S),
    ("year", I),
    ("qid", S),
)
COUNTER_EVENTS = _struct(("ts", TS), ("counter", S), ("n", L))

# Logs of the streaming stages.
_ENTRY = _struct(("filename", S), ("item_hash", S), ("size_bytes", L))
DECODED = _struct(
    ("source", S), ("title", S), ("entries", T.ArrayType(_ENTRY)), ("error", S), ("ingested_at", TS)
)
ITEM_ROWS = _struct(
    ("batch", TS), ("source", S), ("pos", I), ("item_hash", S), ("filename", S), ("size_bytes", L)
)
PARSED_LOG = _struct(
    ("item_hash", S),
    ("filename", S),
    ("title", S),
    ("year", I),
    ("season", I),
    ("episode", I),
    ("content_type", S),
    ("ingested_at", TS),
)
MAPPED_LOG = _struct(
    ("item_hash", S), ("catalog_id", S), ("content_type", S), ("season", I), ("episode", I), ("ts", TS)
)
MEMO = _struct(("lookup_key", S), ("catalog_id", S), ("content_type", S), ("ts", TS))
MARKS = _struct(("item_hash", S), ("cost", I), ("done", T.BooleanType()), ("ts", TS))
OUTPUT_LOG = T.StructType(
    [f for f in OUTPUTS.fields if f.name != "created_at"]
    + [T.StructField("pos", I), T.StructField("ts", TS)]
)

QUEUE_COLUMNS = ["completed", "attempts", "last_processed"]

TABLES = {
    "sources": SOURCES,
    "items": ITEMS,
    "parsed_items": PARSED_ITEMS,
    "mappings": MAPPINGS,
    "outputs": OUTPUTS,
    "item_files": ITEM_FILES,
}
