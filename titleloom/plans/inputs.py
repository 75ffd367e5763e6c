"""Stage tables derived from the given tables, so every query grows with them.

The SQL snippets are plain expressions both engines read the same way; the
reference SQL in ``oracles`` uses them to build its inputs and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1999-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-20 12:30:45"
FRAGMENT_MARKER = '<a href="/'
DOCUMENT_MARKER = "example.com/list#"

HASH = "lpad(cast(o_orderkey as string), 40, '0')"
QUEUE = {
    "completed": "o_orderstatus = 'F'",
    "attempts": "cast(o_orderkey % 4 as int)",
    "last_processed": "cast(o_orderdate as timestamp)",
}

_WORDS = "concat(c_mktsegment, '.', cast(c_custkey as string))"
_SEASON = "cast(o_orderkey % 9 + 1 as string)"
_EPISODE = "cast(o_orderkey % 20 + 1 as string)"
# Release-style names in the shapes the parser knows, one unparseable, one plain.
FILENAME = f"""CASE o_orderkey % 10
  WHEN 0 THEN concat({_WORDS}, '.', cast(year(o_orderdate) as string), '.1080p.BluRay.x264-GRP')
  WHEN 1 THEN concat({_WORDS}, '.S0', {_SEASON}, 'E', lpad({_EPISODE}, 2, '0'), '.720p.HDTV.mkv')
  WHEN 2 THEN concat(replace({_WORDS}, '.', '_'), '_S0', {_SEASON}, '_1080p_WEB-DL')
  WHEN 3 THEN concat(replace({_WORDS}, '.', ' '), ' Season ', {_SEASON}, ' Episode ', {_EPISODE}, ' 480p.mkv')
  WHEN 4 THEN concat({_WORDS}, '.', {_SEASON}, 'x', lpad({_EPISODE}, 2, '0'), '.DVDRip.avi')
  WHEN 5 THEN concat(replace({_WORDS}, '.', ' '), ' Season ', {_SEASON}, ' COMPLETE')
  WHEN 6 THEN concat({_WORDS}, '.S', {_SEASON}, 'E15E16.720p')
  WHEN 7 THEN '1080p.BluRay.x264'
  WHEN 8 THEN concat('[', c_mktsegment, '] (', cast(year(o_orderdate) as string), ') 1.5GB 0x12 S0', {_SEASON})
  ELSE CASE cast(floor(o_orderkey / 10) as bigint) % 16
    WHEN 0 THEN concat({_WORDS}, ' - ', cast(year(o_orderdate) as string))
    WHEN 1 THEN concat({_WORDS}, '.AAC2.0.tail')
    WHEN 2 THEN concat({_WORDS}, '.DTS-HD.MA.more')
    WHEN 3 THEN concat({_WORDS}, '.HDR10Plus.more')
    WHEN 4 THEN concat({_WORDS}, '.Dolby.Vision.tail')
    WHEN 5 THEN concat({_WORDS}, '.10bit.more')
    WHEN 6 THEN concat({_WORDS}, ' 25fps tail')
    WHEN 7 THEN concat({_WORDS}, '.Half-SBS.more')
    WHEN 8 THEN concat({_WORDS}, '.8.5 GB.more')
    WHEN 9 THEN concat({_WORDS}, '.4K.more')
    WHEN 10 THEN concat({_WORDS}, '.DIRECTORS.CUT.more')
    WHEN 11 THEN concat({_WORDS}, '-GRP2')
    WHEN 12 THEN concat({_WORDS}, ' more [tag]')
    WHEN 13 THEN concat({_WORDS}, '.more.srt')
    WHEN 14 THEN concat({_WORDS}, '.HEVC.TrueHD.Atmos.REMASTERED')
    ELSE concat({_WORDS}, '.UNRATED.MPEG4.BRRip.Opus.HLG') END END"""
ITEM_SIZE = "cast(round(o_totalprice * 100000) as bigint)"

# Parsed items by formula, for the stages behind the parser.
TITLE = "concat(c_mktsegment, ' ', cast(c_custkey as string))"
YEAR = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(year(o_orderdate) as int) END"
SEASON = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 9 + 1 as int) END"
EPISODE = "CASE WHEN o_orderkey % 3 = 1 THEN cast(o_orderkey % 20 + 1 as int) ELSE NULL END"
CATALOG_ID = "concat('tt', cast(o_custkey as string))"
CONTENT_TYPE = "CASE WHEN o_orderkey % 4 = 0 THEN 'movie' ELSE 'series' END"

# Line items as files of their order; the return flag names the provider.
FILE_KEY = "lpad(cast(l_orderkey as string), 40, '0')"
FILE_PATH = """CASE l_partkey % 7
  WHEN 0 THEN concat('Season 1/Show.', cast(l_partkey as string), '.S02E0', cast(l_linenumber as string), '.720p.mkv')
  WHEN 1 THEN concat('E0', cast(l_linenumber as string), '.mp4')
  WHEN 2 THEN concat('Sample/sample-', cast(l_suppkey as string), '.MKV')
  WHEN 3 THEN concat('info', cast(l_suppkey as string), '.nfo')
  WHEN 4 THEN concat('a/b/Extra_', cast(l_partkey as string), '.avi')
  WHEN 5 THEN concat('Show.E1', cast(l_linenumber as string), '.part.webm')
  ELSE concat('S01E0', cast(l_linenumber as string), '.ts') END"""
FILE_SIZE = "cast(round(l_extendedprice * 2500) as bigint)"
FILE_RANK = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"

CATALOG_NAME = "concat(p_name, ' ', p_brand, ' ', p_type)"
CATALOG_YEAR = "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 1950 + p_size END"
QUERY_NAME = f"""CASE p_partkey % 5
  WHEN 0 THEN {CATALOG_NAME}
  WHEN 1 THEN concat(substring({CATALOG_NAME}, 1, 2), substring({CATALOG_NAME}, 4))
  WHEN 2 THEN concat(replace({CATALOG_NAME}, 'a', 'e'), ' (x)')
  WHEN 3 THEN p_name
  ELSE concat(p_type, ' ', p_name) END"""
QUERY_YEAR = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE cast(1949 + p_size + p_partkey % 4 as int) END"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _queue() -> list[str]:
    return [f"{sql} AS {name}" for name, sql in QUEUE.items()]


def _order_rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The narrow base columns, spread by key: a table of one row group would feed a single task with all that is derived."""
    return table(spark, sf, "orders").select("o_orderkey", *columns).repartition("o_orderkey")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = _order_rows(
        spark, sf, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"])


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a source queue."""
    return table(spark, sf, "orders").selectExpr(
        "concat('d', cast(o_orderkey as string)) AS name", *_queue()
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).selectExpr(
        f"{HASH} AS item_hash", f"{FILENAME} AS filename", f"{ITEM_SIZE} AS size_bytes", *_queue()
    )


def parsed_items(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).selectExpr(
        f"{HASH} AS item_hash",
        f"{TITLE} AS title",
        f"{YEAR} AS year",
        f"{SEASON} AS season",
        f"{EPISODE} AS episode",
        *_queue(),
    )


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        f"{HASH} AS item_hash",
        f"{CATALOG_ID} AS catalog_id",
        f"{CONTENT_TYPE} AS content_type",
        *_queue(),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag"
    )
    return lines.repartition("l_orderkey", "l_linenumber").selectExpr(
        f"{FILE_KEY} AS key",
        f"{FILE_PATH} AS path",
        f"{FILE_SIZE} AS size",
        "l_linenumber AS file_index",
        f"{FILE_RANK} AS rank",
    )


# Candidates: every lookup key gets eight, spread over the four searches.
CANDIDATES = """
SELECT lookup_key, lookup_title, lookup_year, hint, j AS pos,
  CASE j % 4 WHEN 0 THEN 'a_movie' WHEN 1 THEN 'a_series' WHEN 2 THEN 'b_year' ELSE 'b_plain' END AS list,
  concat(CASE WHEN (k + j) % 5 = 4 THEN 'nm' ELSE 'tt' END, cast(k AS string), '0', cast(j AS string)) AS id,
  CASE (k + j) % 6
    WHEN 0 THEN lookup_title
    WHEN 1 THEN concat(lookup_title, ' returns (', cast(k AS string), ')')
    WHEN 2 THEN concat('the ', substring(lookup_title, 2))
    WHEN 3 THEN concat(substring(lookup_title, 1, 5), 'ing & else')
    WHEN 4 THEN '###'
    ELSE concat(substring(lookup_title, 1, 6), 'q', substring(lookup_title, 8)) END AS name,
  CASE WHEN (k + j) % 7 = 0 THEN NULL ELSE coalesce(lookup_year, 2000) + cast((k + j) % 4 AS int) - 1 END AS year,
  CASE (k * 3 + j) % 7 WHEN 0 THEN 'movie' WHEN 1 THEN 'tvSeries' WHEN 2 THEN 'tvMovie'
    WHEN 3 THEN 'tvMiniSeries' WHEN 4 THEN 'feature' WHEN 5 THEN 'game' ELSE NULL END AS qid
FROM spread"""


# Lookup keys of one task, each of which has eight wide candidates that are sorted there.
KEYS_OF_TASK = 20_000


def spread_keys(spark: SparkSession, sf: str, keys: DataFrame) -> DataFrame:
    """The lookup keys in partitions whose number follows the orders, of which there are never fewer than keys.

    The planner drops a repartition to as many partitions as a shuffle has, and adaptive execution then joins
    them by the size of the keys alone. A join deals anew what has fewer; it keeps more.
    """
    tasks = max(1, -(-table(spark, sf, "orders").count() // KEYS_OF_TASK))
    tasks += tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(tasks, "lookup_key")


def candidates(keys: DataFrame) -> DataFrame:
    """Candidate rows with their key's columns beside them."""
    k = F.length("lookup_title") + F.coalesce(F.col("lookup_year"), F.lit(7)) + F.substring_index(
        "lookup_title", " ", -1
    ).cast("int")
    spread = keys.withColumn("k", k.cast("bigint")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(7)))
    )
    return keys.sparkSession.sql(CANDIDATES.replace("spread", "{spread}"), spread=spread)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS pos",
        "concat('tt', cast(p_partkey AS string)) AS id",
        f"{CATALOG_NAME} AS name",
        f"cast({CATALOG_YEAR} AS int) AS year",
    )


def catalog_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS query_id", f"{QUERY_NAME} AS title", f"{QUERY_YEAR} AS year"
    )


# One JSON document per order, in all shapes, some of them broken.
_ENTRY = """concat('{{"filename":"f', cast(o_orderkey AS string), '-', cast(j AS string), '","hash":"h', cast(o_orderkey * 10 + j AS string),
  '"', CASE WHEN o_orderkey % 13 = 0 AND j = 2 THEN '' ELSE concat(',"{size}":', cast(o_orderkey * 1000 + j AS string)) END, ',"x":null}}')"""


def _entries(size: str) -> str:
    entry = _ENTRY.format(size=size)
    return f"array_join(transform(sequence(0, cast(o_orderkey % 4 AS int)), j -> {entry}), ',')"


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """source, json. Key % 17 = 0 lacks the list, % 19 = 0 has text behind the document."""
    list_doc = f"""concat('{{"title":"T', cast(o_orderkey AS string), '","list":[', {_entries('size')}, ']}}')"""
    alias_doc = f"""concat('  {{"torrents":[', {_entries('bytes')}, ']}}')"""
    bare_doc = f"""concat(' [', {_entries('bytes')}, ']')"""
    return _order_rows(spark, sf).selectExpr(
        "concat('d', cast(o_orderkey AS string)) AS source",
        f"""CASE WHEN o_orderkey % 17 = 0 THEN '{{"title":"lost"}}'
            WHEN o_orderkey % 19 = 0 THEN concat({bare_doc}, ' x')
            WHEN o_orderkey % 23 = 0 THEN '[]'
            WHEN o_orderkey % 3 = 0 THEN {list_doc}
            WHEN o_orderkey % 3 = 1 THEN {alias_doc}
            ELSE {bare_doc} END AS json""",
    )


def containers(spark: SparkSession, sf: str) -> DataFrame:
    """key, content: a file list per order, or one file, or noise."""
    part = "concat(cast(length({0}) AS string), ':', {0})"
    name = "concat('f', cast(o_orderkey AS string), '-', cast(j AS string), '.mkv')"
    entry = f"""CASE WHEN j = 1 AND o_orderkey % 5 = 0 THEN 'd6:lengthi5ee' WHEN j = 2 AND o_orderkey % 5 = 1 THEN 'i7e'
        ELSE concat('d', CASE WHEN j = 0 THEN '' ELSE concat('6:lengthi', cast(o_orderkey * 100 + j AS string), 'e') END,
                    '4:pathl4:dir1', {part.format(name)}, 'ee') END"""
    single = "concat('one', cast(o_orderkey AS string), '.mp4')"
    return _order_rows(spark, sf).selectExpr(
        f"{HASH} AS key",
        f"""encode(CASE WHEN o_orderkey % 17 = 0 THEN 'not bencode'
            WHEN o_orderkey % 4 = 0 THEN concat('d4:infod6:lengthi', cast(o_orderkey + 1 AS string), 'e4:name', {part.format(single)}, 'ee')
            ELSE concat('d8:announce1:a4:infod5:filesl', array_join(transform(sequence(0, cast(o_orderkey % 4 AS int)), j -> {entry}), ''), 'e4:name1:nee') END, 'UTF-8') AS content""",
    )


def bare_containers(spark: SparkSession, sf: str) -> DataFrame:
    """key, content: the dictionary of one file per order, or a list, which is none."""
    name = "concat('one', cast(o_orderkey AS string), '.mp4')"
    return _order_rows(spark, sf).selectExpr(
        f"{HASH} AS key",
        f"""encode(CASE WHEN o_orderkey % 7 = 0 THEN 'l3:fooe' ELSE concat('d6:lengthi', cast(o_orderkey AS string),
            'e4:name', cast(length({name}) AS string), ':', {name}, 'e') END, 'UTF-8') AS content""",
    )


def provider_lists(spark: SparkSession, sf: str) -> DataFrame:
    """key, json: a provider's file list per order; some entries lack a field."""
    entry = """concat('{"id":', CASE WHEN j = 2 AND o_orderkey % 3 = 0 THEN '"x"' ELSE cast(j AS string) END,
        ',"path":"', CASE WHEN j = 1 THEN '/' ELSE '' END, 'd/f', cast(o_orderkey AS string), '.mkv","bytes":', cast(o_orderkey + j AS string), '}')"""
    return _order_rows(spark, sf).selectExpr(
        f"{HASH} AS key",
        f"""CASE WHEN o_orderkey % 17 = 0 THEN '{{"none":1}}' ELSE concat('{{"files":[',
            array_join(transform(sequence(0, cast(o_orderkey % 4 AS int)), j -> {entry}), ','), ']}}') END AS json""",
    )


def counter_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "cast(ts AS timestamp) AS ts", "event_type AS counter", "cast(user_id AS bigint) AS n"
    )
