"""Reference SQL for the registered queries, written from the operators' definitions.

It shares with the queries only the snippets that derive inputs.
"""

from __future__ import annotations

from titleloom import fixed_values as V
from titleloom.plans import inputs as I

AS_OF = f"TIMESTAMP '{I.AS_OF}'"
_E = f"TIMESTAMP '{I.EVENTS_AS_OF}'"


def _fmt(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_Q = ", ".join(f"{sql} AS {name}" for name, sql in I.QUEUE.items())
_STATE = f"completed, attempts, {_fmt('last_processed')} AS last_processed"
_NEW = f"false AS completed, cast(0 as int) AS attempts, {AS_OF} AS last_processed"

BASE = f"""
src AS (SELECT concat('d', cast(o_orderkey as string)) AS name, {_Q} FROM orders),
oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
it AS (SELECT {I.HASH} AS item_hash, {I.FILENAME} AS filename, {I.ITEM_SIZE} AS size_bytes, {_Q} FROM oc),
pi AS (SELECT {I.HASH} AS item_hash, {I.TITLE} AS title, cast({I.YEAR} as int) AS year, {I.SEASON} AS season, {I.EPISODE} AS episode, {_Q} FROM oc),
ma AS (SELECT {I.HASH} AS item_hash, {I.CATALOG_ID} AS catalog_id, {I.CONTENT_TYPE} AS content_type, {_Q} FROM orders),
fi AS (SELECT {I.FILE_KEY} AS key, {I.FILE_PATH} AS path, {I.FILE_SIZE} AS size, l_linenumber AS file_index, {I.FILE_RANK} AS rank FROM lineitem),
won AS (SELECT * FROM fi QUALIFY rank = min(rank) OVER (PARTITION BY key))"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([BASE.strip(), *ctes]) + " " + body


# --- names -----------------------------------------------------------------

# Rules with a season alone get an empty episode group.
_RULES = ["(?i)" + r + ("" if r.count(r"(\d") == 2 else "()") for r in V.SEASON_EPISODE]
# RE2 has no \z; the queries' names hold no line breaks, so $ is the same place.
_NOISE = [rf"(?i)\b(?:{w})\b" for w in V.NOISE_WORDS] + [p.replace(r"\z", "$") for p in V.NOISE_SHAPES]


def _parse_ctes(source: str, name: str, tag: str) -> list[str]:
    """Parse ``name`` of ``source`` into <tag>: all source columns plus title, year, season, episode, kind."""
    hits = ", ".join(f"regexp_matches(n, '{r}') AS h{i}" for i, r in enumerate(_RULES))
    hits = hits.replace("AS h3", f"AND try_cast(regexp_extract(n, '{_RULES[3]}', 1) AS int) > 0 AS h3")
    rule = " ".join(f"WHEN h{i} THEN {i}" for i in range(6))
    cell = lambda g: " ".join(f"WHEN {i} THEN regexp_extract(n, '{r}', {g})" for i, r in enumerate(_RULES))
    flag = lambda r: (r[:4], r[4:]) if r.startswith("(?i)") else ("", r)
    head = " ".join(
        f"WHEN {i} THEN regexp_extract(n, '(?is)^(.*?){flag(r)[1]}', 1)" for i, r in enumerate(_RULES)
    )
    noise = ", ".join(
        f"CASE WHEN regexp_matches(n, '{p}') THEN length(regexp_extract(n, '(?s)^(.*?)(?:{p})', 1)) END"
        for p in _NOISE
    )
    edge = "' -()[]' || chr(9)"
    return [
        rf"{tag}0 AS (SELECT *, translate(regexp_replace({name}, '(?i)\.(?:mkv|mp4|avi|mov|wmv|flv|webm|m4v|ts)$', ''), '._', '  ') AS n FROM {source})",
        f"{tag}1 AS (SELECT *, {hits} FROM {tag}0)",
        f"{tag}2 AS (SELECT *, CASE {rule} END AS rule FROM {tag}1)",
        f"""{tag}3 AS (SELECT *, CASE rule {cell(1)} END AS s_text, CASE rule {cell(2)} END AS e_text,
            CASE WHEN rule IS NOT NULL THEN CASE rule {head} END
                 ELSE left(n, coalesce(list_min([{noise}]), length(n))) END AS raw FROM {tag}2)""",
        rf"""{tag}4 AS (SELECT *, trim(regexp_replace(trim(raw, {edge}), '\s+(?:19|20)\d{{2}}\s*$', '')) AS t FROM {tag}3)""",
        rf"""{tag} AS (SELECT *, CASE WHEN strlen(t) >= 2 THEN t END AS p_title,
            try_cast(regexp_extract(n, '\s((?:19|20)\d{{2}})\b', 1) AS int) AS p_year,
            try_cast(s_text AS int) AS p_season, try_cast(e_text AS int) AS p_episode,
            CASE WHEN rule IS NULL THEN 'unknown' WHEN e_text <> '' THEN 'episode' ELSE 'season' END AS kind FROM {tag}4)""",
    ]


_PARSED = _parse_ctes("it", "filename", "pn")
_FILES_PARSED = _parse_ctes("(SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM fi)", "base", "fp")
_BARE = r"try_cast(regexp_extract(base, '(?i)(?:^|[.\s_-])E(\d{1,3})(?:[.\s_-]|$)', 1) AS int)"
_MEDIA = r"regexp_matches(lower(path), '\.(mkv|mp4|avi|mov|wmv|flv|webm|m4v|ts)$') AND NOT (lower(path) LIKE '%sample%' AND size < 100000000)"


def _simple(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({x}), '\([^(]+\)$', ''), '&', 'and'), '[^0-9a-z ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _sim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::double ELSE 1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) END"


def _almost(a: str, b: str) -> str:
    return f"(starts_with({a}, {b}) OR ends_with({a}, {b}) OR starts_with({b}, {a}) OR ends_with({b}, {a}))"


# --- linkage -----------------------------------------------------------------

_KEYED = """keyed AS (SELECT *, lower(title) AS lookup_title, CASE WHEN season IS NOT NULL OR episode IS NOT NULL THEN 'series' END AS hint,
   concat(lower(trim(title)), '|', cast(coalesce(year, 0) as string), '|', CASE WHEN season IS NOT NULL OR episode IS NOT NULL THEN 'series' ELSE 'any' END) AS lookup_key FROM pi)"""
_KEYS = "keys AS (SELECT DISTINCT lookup_key, lookup_title, year AS lookup_year, hint FROM keyed)"
_SPREAD = """spread AS (SELECT *, length(lookup_title) + coalesce(lookup_year, 7) + cast(split_part(lookup_title, ' ', -1) as int) AS k, unnest(range(0, 8)) AS j FROM keys)"""
_CAND = f"cand AS ({I.CANDIDATES})"
_SCORED = f"""scored AS (SELECT *, {_sim('q', 'c')} AS sim, {_almost('q', 'c')} AS almost FROM
   (SELECT *, {_simple('lookup_title')} AS q, {_simple('name')} AS c FROM cand
    WHERE id LIKE 'tt%' AND (lookup_year IS NULL OR year IS NULL OR abs(lookup_year - year) <= 1)))"""
_LINK = [_KEYED, _KEYS, _SPREAD, _CAND, _SCORED]
_ADMITS = """CASE WHEN hint = 'movie' THEN coalesce(qid IN ('movie','feature','short','video','tvMovie','tvSpecial'), false)
   WHEN hint = 'series' THEN coalesce(qid IN ('tvSeries','tvMiniSeries'), false) ELSE true END"""
_TYPE = "CASE WHEN qid IN ('tvSeries','tvMiniSeries','tvMovie','tvSpecial') THEN 'series' ELSE 'movie' END"


def _pick(source: str, by: str, last_resort: str, tag: str) -> list[str]:
    """Row-number form of the pick: <tag>(by..., id, qid)."""
    n = "row_number() OVER (PARTITION BY"
    return [
        f"""{tag}r AS (SELECT *, {n} {by} ORDER BY (sim > 0.6) DESC, sim DESC, pos) AS rb,
              {n} {by} ORDER BY almost DESC, pos) AS ra, {n} {by} ORDER BY pos) AS rf FROM {source})""",
        f"""{tag}g AS (SELECT {by},
              max(CASE WHEN rb = 1 AND sim > 0.6 THEN id END) AS bid, max(CASE WHEN rb = 1 AND sim > 0.6 THEN qid END) AS bq,
              bool_or(CASE WHEN rb = 1 AND sim > 0.6 THEN almost END) AS balmost,
              max(CASE WHEN ra = 1 AND almost THEN id END) AS aid, max(CASE WHEN ra = 1 AND almost THEN qid END) AS aq,
              max(CASE WHEN rf = 1 AND {last_resort} THEN id END) AS fid, max(CASE WHEN rf = 1 AND {last_resort} THEN qid END) AS fq
              FROM {tag}r GROUP BY {by})""",
        f"""{tag} AS (SELECT {by},
              CASE WHEN bid IS NOT NULL AND aid IS NOT NULL AND NOT balmost THEN aid WHEN bid IS NOT NULL THEN bid WHEN aid IS NOT NULL THEN aid ELSE fid END AS id,
              CASE WHEN bid IS NOT NULL AND aid IS NOT NULL AND NOT balmost THEN aq WHEN bid IS NOT NULL THEN bq WHEN aid IS NOT NULL THEN aq ELSE fq END AS qid
              FROM {tag}g)""",
    ]


_CASCADE = [
    *_LINK,
    """lists AS (
       SELECT *, CASE WHEN (list = 'a_series') = coalesce(hint = 'series', false) THEN 0 ELSE 1 END AS stage, false AS lr FROM scored WHERE list IN ('a_movie', 'a_series')
       UNION ALL SELECT *, CASE list WHEN 'b_year' THEN 2 ELSE 3 END, true FROM scored WHERE (list = 'b_plain' OR (list = 'b_year' AND lookup_year IS NOT NULL)) AND """
    + _ADMITS
    + """
       UNION ALL SELECT *, CASE list WHEN 'b_year' THEN 4 ELSE 5 END, true FROM scored WHERE (list = 'b_plain' OR (list = 'b_year' AND lookup_year IS NOT NULL)) AND hint IS NOT NULL)""",
    *_pick("lists", "lookup_key, list, hint, stage", "lr", "pk"),
    f"""best AS (SELECT lookup_key, stage, id AS catalog_id,
         CASE WHEN stage < 2 THEN replace(list, 'a_', '') WHEN stage < 4 THEN {_TYPE} ELSE hint END AS content_type
         FROM pk WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lookup_key ORDER BY stage) = 1)""",
    "resolved AS (SELECT k.lookup_key, k.hint, stage, catalog_id, content_type FROM keys k LEFT JOIN best USING (lookup_key))",
    """fanned AS (SELECT item_hash, lookup_key, catalog_id, CASE WHEN catalog_id IS NOT NULL THEN coalesce(k.hint, r.content_type) END AS content_type
        FROM keyed k LEFT JOIN resolved r USING (lookup_key))""",
]

# --- routing -----------------------------------------------------------------

_ELIGIBLE = f"NOT completed AND attempts < 3 AND (attempts = 0 OR last_processed < {AS_OF} - INTERVAL 1440 MINUTE)"


def _elig(t: str) -> str:
    return f"NOT {t}.completed AND {t}.attempts < 3 AND ({t}.attempts = 0 OR {t}.last_processed < {AS_OF} - INTERVAL 1440 MINUTE)"


_SINGLE = "(m.content_type = 'movie' OR (m.content_type = 'series' AND p.season IS NOT NULL AND p.episode IS NOT NULL))"
_PACK = "(m.content_type = 'series' AND p.season IS NOT NULL AND p.episode IS NULL)"
_JOIN3 = "ma m JOIN it t ON m.item_hash = t.item_hash JOIN pi p ON m.item_hash = p.item_hash"
_SINGLES = f"""singles AS (SELECT m.item_hash, m.catalog_id, m.content_type AS output_type, t.size_bytes, cast(NULL as int) AS file_index, p.season, p.episode
   FROM {_JOIN3} WHERE {_elig('m')} AND {_SINGLE})"""
_PACKS = f"packs AS (SELECT m.item_hash, m.catalog_id, p.season, t.size_bytes FROM {_JOIN3} WHERE {_elig('m')} AND {_PACK})"
_WON_PARSED = _parse_ctes("(SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM won)", "base", "wp")
_EXPANDED = f"""expanded AS (SELECT k.item_hash, k.catalog_id, 'series' AS output_type, w.size AS size_bytes, w.file_index,
     CASE WHEN kind = 'episode' THEN p_season ELSE k.season END AS season,
     CASE WHEN kind = 'episode' THEN p_episode ELSE {_BARE} END AS episode
   FROM packs k JOIN wp w ON k.item_hash = w.key WHERE {_MEDIA})"""
_STATUS = f"""status AS (SELECT item_hash, coalesce(n, 0) AS outputs, n IS NOT NULL AS completed FROM packs LEFT JOIN
   (SELECT key, count(*) FILTER ({_MEDIA}) AS n FROM won GROUP BY key) ON key = item_hash)"""

# --- outputs -------------------------------------------------------------------

_OUT = f"""out AS (SELECT {I.HASH} AS item_hash, {I.CATALOG_ID} AS catalog_id, {I.CONTENT_TYPE} AS output_type, {I.ITEM_SIZE} AS size_bytes,
   CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE cast(o_orderkey % 5 AS int) END AS file_index, {I.SEASON} AS season, {I.EPISODE} AS episode,
   cast(o_orderdate AS timestamp) AS created_at FROM orders)"""
_NEW_OUT = """nw AS (SELECT * REPLACE (size_bytes + 1 AS size_bytes, CASE WHEN file_index = 1 THEN 9 ELSE file_index END AS file_index)
   FROM out WHERE cast(item_hash AS bigint) % 3 > 0)"""
_OLD_OUT = "od AS (SELECT * FROM out WHERE cast(item_hash AS bigint) % 4 > 0)"
_OUT_COLS = ["catalog_id", "output_type", "size_bytes", "season", "episode"]


def _upsert_outputs(same: str, new: str = _NEW_OUT, old: str = _OLD_OUT) -> str:
    cells = ", ".join(f"CASE WHEN n.item_hash IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in _OUT_COLS)
    return _sql(
        f"""SELECT coalesce(o.item_hash, n.item_hash) AS item_hash, {cells},
          CASE WHEN o.item_hash IS NOT NULL THEN o.file_index ELSE n.file_index END AS file_index,
          {_fmt(f"CASE WHEN o.item_hash IS NOT NULL THEN o.created_at ELSE {AS_OF} END")} AS created_at
        FROM od o FULL JOIN nw n ON o.item_hash = n.item_hash AND {same}""",
        _OUT, new, old,
    )


def _upsert(old: str, new: str, cols: list[str], ctes: list[str]) -> str:
    cells = ", ".join(f"CASE WHEN n.item_hash IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in cols)
    return _sql(
        f"""SELECT coalesce(o.item_hash, n.item_hash) AS item_hash, {cells}, coalesce(o.completed, false) AS completed,
          coalesce(o.attempts, 0) AS attempts, {_fmt(f'coalesce(o.last_processed, {AS_OF})')} AS last_processed
        FROM {old} o FULL JOIN {new} n ON o.item_hash = n.item_hash""",
        *ctes,
    )


_CLAIMED = "cl AS (SELECT concat('d', cast(l_orderkey AS string)) AS name, l_quantity FROM lineitem WHERE l_returnflag = 'R')"


def _marks(cost: str, done: str) -> str:
    return _sql(
        f"""SELECT s.name, s.completed OR ({done}) AS completed, s.attempts + ({cost}) AS attempts,
          {_fmt(f'CASE WHEN c.name IS NULL THEN s.last_processed ELSE {AS_OF} END')} AS last_processed
        FROM src s LEFT JOIN c ON s.name = c.name""",
        _CLAIMED,
        "c AS (SELECT name, bool_or(l_quantity > 25) AS good, bool_or(l_quantity <= 5) AS bad FROM cl GROUP BY name)",
    )


def _depth(stage: str, source: str, limit: int, where: str = "true", exhausted: str | None = None) -> str:
    ex = exhausted or f"count(*) FILTER (NOT m.completed AND m.attempts >= {limit})"
    return f"""SELECT '{stage}' AS stage, count(*) FILTER (m.completed) AS completed,
       count(*) FILTER (NOT m.completed AND m.attempts < {limit}) AS unresolved, {ex} AS exhausted FROM {source} WHERE {where}"""


_KNOWN = "ma m JOIN (SELECT * FROM pi WHERE year IS NOT NULL) p ON m.item_hash = p.item_hash"
_DEPTHS = " UNION ALL ".join([
    _depth("sources", "src m", 2),
    _depth("items", "it m", 3),
    _depth("parsed_items", "(SELECT * FROM pi WHERE year IS NOT NULL) m", 1),
    _depth("links", "ma m", 2),
    _depth("singles", _KNOWN, 2, "m.content_type = 'movie' OR (m.content_type = 'series' AND p.episode IS NOT NULL)", "0"),
    _depth("packs", _KNOWN, 3, _PACK),
])

# --- documents -------------------------------------------------------------------

# Documents: key, and what the derivation put into each.
_DOCS = """docs AS (SELECT o_orderkey AS k, concat('d', cast(o_orderkey AS string)) AS source,
   CASE WHEN o_orderkey % 17 = 0 THEN 'lost' WHEN o_orderkey % 19 = 0 THEN 'tail' WHEN o_orderkey % 23 = 0 THEN 'empty'
        WHEN o_orderkey % 3 = 0 THEN 'list' WHEN o_orderkey % 3 = 1 THEN 'alias' ELSE 'bare' END AS shape,
   o_orderkey % 4 AS last, o_orderkey % 13 = 0 AND o_orderkey % 4 >= 2 AS hole FROM orders)"""


def _json(size: str) -> str:
    return f"""array_to_string([concat('{{"filename":"f', k, '-', j, '","hash":"h', k * 10 + j, '"',
       CASE WHEN k % 13 = 0 AND j = 2 THEN '' ELSE concat(',"{size}":', k * 1000 + j) END, ',"x":null}}') FOR j IN range(0, last + 1)], ',')"""


_DOC_JSON = f"""CASE shape WHEN 'lost' THEN '{{"title":"lost"}}' WHEN 'tail' THEN concat(' [', {_json('bytes')}, '] x') WHEN 'empty' THEN '[]'
   WHEN 'list' THEN concat('{{"title":"T', k, '","list":[', {_json('size')}, ']}}')
   WHEN 'alias' THEN concat('  {{"torrents":[', {_json('bytes')}, ']}}') ELSE concat(' [', {_json('bytes')}, ']') END"""

_CAT = f"""cat AS (SELECT p_partkey AS pos, concat('tt', cast(p_partkey AS string)) AS id, {I.CATALOG_NAME} AS name, cast({I.CATALOG_YEAR} AS int) AS year FROM part)"""
_QRY = f"""qry AS (SELECT p_partkey AS query_id, {I.QUERY_NAME} AS title, {I.QUERY_YEAR} AS year FROM part)"""
_POINTS = """pts AS (SELECT event_type AS counter, date_trunc('minute', ts) AS minute, sum(user_id) AS n FROM events GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "listing_filter": """SELECT path AS name FROM (SELECT CASE WHEN page_id % 50 = 0 THEN 'index.html' ELSE url END AS path, page_id FROM pages)
        WHERE page_id % 5 <> 1 AND path LIKE '%.html' AND path <> 'index.html'""",
    "html_fragment": """SELECT page_id, CASE WHEN regexp_matches(html, '<a href="/[^"]*"') THEN regexp_extract(html, '(?s)<a href="/([^"]*)"', 1) END AS fragment,
        cast(NULL AS varchar) AS unmarked FROM pages""",
    "decode_payloads": _sql(f"SELECT source, CASE WHEN k % 29 <> 0 THEN {_DOC_JSON} END AS json, k % 29 = 0 AS failed FROM docs", _DOCS),
    "json_shapes": """SELECT event_id, true AS valid, 't' AS title, event_type AS filename, concat('h', event_id) AS item_hash, cast(json_extract_string(props, '$.k') AS bigint) AS size_bytes FROM events WHERE event_id % 5 = 0
        UNION ALL SELECT event_id, true, NULL, event_type, concat('h', event_id), cast(json_extract_string(props, '$.k') AS bigint) FROM events WHERE event_id % 5 IN (1, 2)
        UNION ALL SELECT event_id, true, NULL, 'b', 'c', 2 FROM events WHERE event_id % 5 = 1
        UNION ALL SELECT event_id, false, NULL, NULL, NULL, NULL FROM events WHERE event_id % 5 IN (3, 4)""",
    "document_items": _sql(
        """SELECT source, CASE WHEN shape = 'list' THEN concat('T', k) END AS title, cast(j AS int) AS pos, concat('f', k, '-', j) AS filename,
           concat('h', k * 10 + j) AS item_hash, k * 1000 + j AS size_bytes
           FROM (SELECT *, unnest(range(0, last + 1)) AS j FROM docs WHERE shape IN ('list', 'alias', 'bare') AND NOT hole AND k % 31 <> 0)""",
        _DOCS,
    ),
    "document_errors": _sql("SELECT source FROM docs WHERE k % 31 = 0 OR shape IN ('lost', 'tail') OR (hole AND shape <> 'empty')", _DOCS),
    "container_files": f"""SELECT key, path, size, file_index, failed FROM (
        SELECT {I.HASH} AS key, cast(NULL AS varchar) AS path, cast(NULL AS bigint) AS size, cast(NULL AS int) AS file_index, true AS failed FROM orders WHERE o_orderkey % 17 = 0
        UNION ALL SELECT {I.HASH}, concat('one', o_orderkey, '.mp4'), o_orderkey + 1, 0, false FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 4 = 0
        UNION ALL SELECT {I.HASH}, concat('dir1/f', o_orderkey, '-', j, '.mkv'), CASE WHEN j = 0 THEN 0 ELSE o_orderkey * 100 + j END, cast(j AS int), false
          FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4 + 1)) AS j FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 4 <> 0)
          WHERE NOT (j = 1 AND o_orderkey % 5 = 0) AND NOT (j = 2 AND o_orderkey % 5 = 1))""",
    "bare_containers": f"""SELECT {I.HASH} AS key, CASE WHEN o_orderkey % 7 <> 0 THEN concat('one', o_orderkey, '.mp4') END AS path,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS size, CASE WHEN o_orderkey % 7 <> 0 THEN 0 END AS file_index, o_orderkey % 7 = 0 AS failed FROM orders""",
    "json_file_lists": f"""SELECT {I.HASH} AS key, concat('d/f', o_orderkey, '.mkv') AS path, o_orderkey + j AS size, cast(greatest(j - 1, 0) AS int) AS file_index, cast(j AS int) AS pos
        FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4 + 1)) AS j FROM orders WHERE o_orderkey % 17 <> 0) WHERE NOT (j = 2 AND o_orderkey % 3 = 0)""",
    "first_nonempty_source": _sql("SELECT key, rank, path, size, file_index FROM won"),
    "insert_if_absent": _sql(
        f"""SELECT name, false AS completed, cast(0 as int) AS attempts, {_fmt(AS_OF)} AS last_processed FROM
        (SELECT DISTINCT concat('d', cast(l_orderkey + l_linenumber AS string)) AS name FROM lineitem) WHERE name NOT IN (SELECT name FROM src WHERE completed)"""
    ),
    "upsert_items": _upsert(
        "o1", "n1", ["filename", "size_bytes"],
        ["o1 AS (SELECT * FROM it WHERE attempts < 3)",
         f"""n1 AS (SELECT {I.FILE_KEY} AS item_hash, {I.FILE_PATH} AS filename, {I.FILE_SIZE} AS size_bytes FROM lineitem
             QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey DESC, concat('s', cast(l_partkey AS string)) DESC, l_linenumber DESC, {I.FILE_PATH} DESC, {I.FILE_SIZE} DESC) = 1)"""],
    ),
    "upsert_parsed": _upsert(
        "o1", "n1", ["title", "year", "season", "episode"],
        ["o1 AS (SELECT * REPLACE (cast(NULL AS int) AS episode) FROM pi WHERE attempts < 3)", "n1 AS (SELECT * FROM pi WHERE attempts > 1)"],
    ),
    "upsert_mappings": _upsert(
        "o1", "n1", ["catalog_id", "content_type"],
        ["o1 AS (SELECT * FROM ma WHERE attempts < 3)", "n1 AS (SELECT * REPLACE ('movie' AS content_type) FROM ma WHERE attempts > 1)"],
    ),
    "upsert_nullable_key": _upsert_outputs("o.file_index IS NOT DISTINCT FROM n.file_index"),
    "upsert_nulls_distinct": _upsert_outputs("o.file_index = n.file_index"),
    "upsert_repeated_key": _upsert_outputs(
        "o.file_index IS NOT DISTINCT FROM n.file_index",
        """nw AS (SELECT key AS item_hash, 'tt1' AS catalog_id, 'series' AS output_type, size AS size_bytes, cast(file_index % 2 AS int) AS file_index, 1 AS season,
          cast(NULL AS int) AS episode FROM fi QUALIFY row_number() OVER (PARTITION BY key, file_index % 2 ORDER BY file_index DESC, size DESC) = 1)""",
        "od AS (SELECT * FROM out)",
    ),
    "stage_extract": _sql(
        f"""SELECT name, completed OR ({_ELIGIBLE} AND NOT bad) AS completed, attempts + cast({_ELIGIBLE} AS int) AS attempts,
          {_fmt(f'CASE WHEN {_ELIGIBLE} THEN {AS_OF} ELSE last_processed END')} AS last_processed
        FROM src JOIN (SELECT source, k % 31 = 0 OR shape IN ('lost', 'tail') OR (hole AND shape <> 'empty') AS bad FROM docs) d ON d.source = src.name""",
        _DOCS,
    ),
    "stage_parse": _sql(
        f"""SELECT item_hash, size_bytes, completed OR ({_ELIGIBLE}) AS completed, attempts + cast({_ELIGIBLE} AS int) AS attempts,
          {_fmt(f'CASE WHEN {_ELIGIBLE} THEN {AS_OF} ELSE last_processed END')} AS last_processed FROM it"""
    ),
    "stage_route": _sql(
        f"""SELECT m.item_hash, m.catalog_id, m.content_type, m.completed OR s.item_hash IS NOT NULL OR coalesce(k.completed, false) AS completed,
          m.attempts + cast(s.item_hash IS NOT NULL OR k.item_hash IS NOT NULL AS int) AS attempts,
          {_fmt(f'CASE WHEN s.item_hash IS NOT NULL OR k.item_hash IS NOT NULL THEN {AS_OF} ELSE m.last_processed END')} AS last_processed
        FROM ma m LEFT JOIN singles s ON s.item_hash = m.item_hash LEFT JOIN status k ON k.item_hash = m.item_hash""",
        _SINGLES, _PACKS, _STATUS,
    ),
    "page_after_outputs": _sql(
        f"""SELECT item_hash, catalog_id, output_type, size_bytes, file_index, season, episode, {_fmt('created_at')} AS created_at
        FROM (SELECT * FROM out WHERE created_at < TIMESTAMP '1995-06-15' OR (created_at = TIMESTAMP '1995-06-15' AND item_hash > repeat('0', 40))
              ORDER BY created_at DESC, item_hash, file_index NULLS FIRST LIMIT 200)""",
        _OUT,
    ),
    "pending_rows": _sql(f"SELECT name, {_STATE} FROM src WHERE {_ELIGIBLE}"),
    "pending_batch": _sql(f"SELECT name, {_STATE} FROM (SELECT * FROM src WHERE {_ELIGIBLE} ORDER BY last_processed, name LIMIT 5000)"),
    "touch": _marks("CASE WHEN c.name IS NULL THEN 0 ELSE 1 END", "false"),
    "complete": _marks("0", "c.name IS NOT NULL"),
    "finish_batch": _marks("CASE WHEN c.name IS NULL THEN 0 WHEN c.bad THEN 2 ELSE 1 END", "coalesce(c.good, false)"),
    "reset_attempts": _sql(
        f"""SELECT name, completed, CASE WHEN NOT completed THEN 0 ELSE attempts END AS attempts,
        {_fmt(f'CASE WHEN NOT completed AND attempts > 0 THEN {AS_OF} ELSE last_processed END')} AS last_processed FROM src"""
    ),
    "count_resettable": _sql(
        "SELECT 'sources' AS name, count(*) FILTER (NOT completed AND attempts > 0) AS changed FROM src UNION ALL SELECT 'outputs', 0"
    ),
    "queue_depths": _sql(
        f"""SELECT *, CASE WHEN completed + unresolved + exhausted > 0 THEN cast(floor(100.0 * completed / (completed + unresolved + exhausted) + 0.5) AS int) ELSE 0 END AS percent
        FROM ({_DEPTHS})"""
    ),
    "parse_name": _sql(
        """SELECT item_hash, filename, p_title AS title, CASE WHEN p_title IS NOT NULL THEN p_year END AS year, CASE WHEN p_title IS NOT NULL THEN p_season END AS season,
           CASE WHEN p_title IS NOT NULL THEN p_episode END AS episode, CASE WHEN p_title IS NOT NULL THEN kind END AS content_type FROM pn""",
        *_PARSED,
    ),
    "parse_stage_unparsed": _sql(
        f"""SELECT item_hash, filename FROM pn WHERE p_title IS NULL AND NOT completed AND (attempts = 0 OR last_processed < {AS_OF} - INTERVAL 20 MINUTE)""",
        *_PARSED,
    ),
    "file_episode": _sql(
        f"""SELECT key, path, cast(size % 7 AS int) AS parent, size, base AS name, CASE WHEN kind = 'episode' THEN p_season WHEN {_BARE} IS NOT NULL THEN cast(size % 7 AS int) END AS season,
           CASE WHEN kind = 'episode' THEN p_episode ELSE {_BARE} END AS episode FROM fp""",
        *_FILES_PARSED,
    ),
    "title_file_episode": _sql(
        f"""SELECT DISTINCT path, CASE WHEN own THEN p_title ELSE 'Parent' END AS title, CASE WHEN own THEN p_season ELSE 4 END AS season, CASE WHEN own THEN p_episode ELSE bare END AS episode
           FROM (SELECT *, kind = 'episode' AND p_title IS NOT NULL AS own, {_BARE} AS bare FROM fp) WHERE own OR bare IS NOT NULL""",
        *_FILES_PARSED,
    ),
    "media_filter": _sql(f"SELECT * FROM fi WHERE {_MEDIA}"),
    "key_format": f"""SELECT key, length(key) = 40 AND length(translate(lower(key), '0123456789abcdef', '')) = 0 AS well_formed FROM (
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN replace({I.HASH}, '0', 'G') WHEN o_orderkey % 5 = 0 THEN concat({I.HASH}, '0') ELSE replace({I.HASH}, '1', 'A') END AS key FROM orders)""",
    "simplify_name": _sql(f"SELECT query_id, {_simple('title')} AS simple FROM qry", _QRY),
    "name_scores": _sql(
        f"""SELECT query_id, round({_sim('a', 'b')}, 9) AS similarity, {_almost('a', 'b')} AS almost, year IS NULL OR cyear IS NULL OR abs(year - cyear) <= 1 AS year_similar
        FROM (SELECT query_id, {_simple('name')} AS a, {_simple('title')} AS b, qry.year AS year, cat.year AS cyear FROM cat JOIN qry ON pos = query_id)""",
        _CAT, _QRY,
    ),
    "first_year": r"""SELECT page_id, coalesce(try_cast(regexp_extract(url, '((?:19|20)\d{2})', 1) AS int), try_cast(regexp_extract(concat('x', page_id * 37), '((?:19|20)\d{2})', 1) AS int)) AS year FROM pages""",
    "type_rules": _sql(
        f"""SELECT hint, qid, n, {_TYPE} AS content_type, {_ADMITS} AS series_ok,
        coalesce(qid IN ('movie','feature','short','video','tvMovie','tvSpecial'), false) AS movie_ok FROM (SELECT hint, qid, count(*) AS n FROM cand GROUP BY 1, 2)""",
        *_LINK,
    ),
    "size_text": _sql(
        """SELECT item_hash, CASE WHEN s IS NULL OR s = 0 THEN '0 B'
             WHEN s >= 1073741824 THEN printf('%.2f GB', round(s / 1073741824, 2)) WHEN s >= 1048576 THEN printf('%.1f MB', round(s / 1048576, 1))
             ELSE printf('%.0f KB', round(s / 1024)) END AS size_text
        FROM (SELECT item_hash, CASE attempts WHEN 0 THEN size_bytes WHEN 1 THEN size_bytes // 100 WHEN 2 THEN size_bytes // 1000000 END AS s FROM it)"""
    ),
    "rfc3339": """SELECT event_id, CASE WHEN us = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') WHEN us % 1000 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.%g+00:00')
        ELSE strftime(t, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS text
        FROM (SELECT event_id, t, epoch_us(t) % 1000000 AS us FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS t FROM events))""",
    "lookup_keys": _sql("SELECT * FROM keys", _KEYED, _KEYS),
    "distinct_keys": _sql("SELECT count(DISTINCT lookup_key) AS unique_keys FROM keyed", _KEYED),
    "group_by_key": _sql("SELECT lookup_key, item_hash, count(*) OVER (PARTITION BY lookup_key) AS members FROM keyed", _KEYED),
    "candidate_filters": _sql(f"SELECT lookup_key, list, pos, id FROM scored WHERE {_ADMITS}", *_LINK),
    "link_provider_a": _sql(
        "SELECT k.lookup_key, pk.id AS catalog_id FROM keys k LEFT JOIN pk USING (lookup_key)",
        *_LINK, *_pick("scored", "lookup_key", "false", "pk"),
    ),
    "link_provider_b": _sql(
        f"SELECT k.lookup_key, pk.id AS catalog_id, CASE WHEN pk.id IS NOT NULL THEN {_TYPE} END AS content_type FROM keys k LEFT JOIN pk USING (lookup_key)",
        *_LINK, *_pick(f"(SELECT * FROM scored WHERE {_ADMITS})", "lookup_key", "true", "pk"),
    ),
    "link_cascade": _sql("SELECT lookup_key, stage, catalog_id, content_type FROM resolved", *_CASCADE),
    "link_fan_out": _sql("SELECT item_hash, catalog_id, content_type FROM fanned", *_CASCADE),
    "link_with_memo": _sql(
        """SELECT item_hash, CASE WHEN length(lookup_key) % 4 = 0 THEN 'tt0' WHEN length(lookup_key) % 2 = 0 THEN NULL ELSE catalog_id END AS catalog_id,
           CASE WHEN length(lookup_key) % 4 = 0 THEN coalesce(hint, 'movie') WHEN length(lookup_key) % 2 = 0 THEN NULL ELSE content_type END AS content_type
           FROM fanned JOIN (SELECT lookup_key, hint FROM keys) USING (lookup_key)""",
        *_CASCADE,
    ),
    "link_tally": _sql("SELECT count(catalog_id) AS resolved, count(*) - count(catalog_id) AS missed FROM fanned", *_CASCADE),
    "link_catalog": _sql(
        "SELECT q.query_id, pk.id AS catalog_id FROM qry q LEFT JOIN pk USING (query_id)",
        _CAT, _QRY,
        f"""scored AS (SELECT query_id, pos, id, cast(NULL AS varchar) AS qid, {_sim('q', 'c')} AS sim, {_almost('q', 'c')} AS almost FROM
            (SELECT query_id, {_simple('title')} AS q, year AS qyear FROM qry) JOIN (SELECT pos, id, {_simple('name')} AS c, year AS cyear FROM cat)
            ON qyear IS NULL OR cyear IS NULL OR abs(qyear - cyear) <= 1)""",
        *_pick("scored", "query_id", "false", "pk"),
    ),
    "year_similar_join": _sql(
        """SELECT query_id, count(*) AS n, min(pos) AS first_pos FROM qry JOIN cat ON qry.title = cat.name
        AND (qry.year IS NULL OR cat.year IS NULL OR abs(qry.year - cat.year) <= 1) GROUP BY query_id""",
        _CAT, _QRY,
    ),
    "route_singles": _sql("SELECT * FROM singles", _SINGLES),
    "route_packs": _sql("SELECT * FROM packs", _PACKS),
    "unrouted": _sql(
        f"""SELECT m.item_hash, m.catalog_id, m.content_type, p.season, p.episode FROM ma m JOIN pi p ON m.item_hash = p.item_hash WHERE NOT {_SINGLE} AND NOT {_PACK}"""
    ),
    "expand_packs": _sql("SELECT * FROM expanded", _PACKS, *_WON_PARSED, _EXPANDED),
    "pack_status": _sql("SELECT * FROM status", _PACKS, _STATUS),
    "pack_tally": _sql(
        "SELECT cast(coalesce(sum(outputs), 0) AS bigint) AS outputs_created, count(*) FILTER (completed) AS packs_resolved, count(*) FILTER (outputs = 0) AS packs_missed FROM status",
        _PACKS, _STATUS,
    ),
    "union_outputs": _sql(
        "SELECT output_type, count(*) AS n, cast(sum(size_bytes) AS bigint) AS bytes FROM (SELECT * FROM singles UNION ALL SELECT * FROM expanded) GROUP BY output_type",
        _SINGLES, _PACKS, *_WON_PARSED, _EXPANDED,
    ),
    "parse_and_route": _sql(
        f"""SELECT m.item_hash, m.catalog_id, m.content_type AS output_type, p.size_bytes, cast(NULL as int) AS file_index, p.season, p.episode
        FROM ma m JOIN (SELECT item_hash, size_bytes, p_season AS season, p_episode AS episode FROM pn WHERE p_title IS NOT NULL) p ON m.item_hash = p.item_hash
        WHERE {_elig('m')} AND {_SINGLE}""",
        *_PARSED,
    ),
    "outputs_page": _sql(
        f"""SELECT item_hash, catalog_id, output_type, size_bytes, file_index, season, episode, {_fmt('created_at')} AS created_at, coalesce(filename, '') AS filename
        FROM (SELECT o.*, t.filename FROM out o LEFT JOIN (SELECT * FROM it WHERE attempts < 2) t USING (item_hash) ORDER BY created_at DESC, item_hash, file_index NULLS FIRST LIMIT 200 OFFSET 400)""",
        _OUT,
    ),
    "items_page": _sql(f"SELECT item_hash, filename, size_bytes, {_STATE} FROM (SELECT * FROM it ORDER BY last_processed DESC, item_hash LIMIT 50)"),
    "deep_page": _sql(f"SELECT name, {_STATE} FROM (SELECT * FROM src ORDER BY last_processed DESC, name LIMIT 200 OFFSET 1000)"),
    "page_total": _sql("SELECT count(*) AS total, 2 AS page, 200 AS per_page FROM it"),
    "page_after": _sql(f"SELECT name, {_STATE} FROM (SELECT * FROM src ORDER BY last_processed DESC, name LIMIT 200 OFFSET 200)"),
    "record_counts": _sql(
        "SELECT 'sources' AS table_name, count(*) AS records FROM src UNION ALL SELECT 'items', count(*) FROM it UNION ALL SELECT 'parsed_items', count(*) FROM pi UNION ALL SELECT 'mappings', count(*) FROM ma UNION ALL SELECT 'outputs', count(*) FROM out",
        _OUT,
    ),
    "counter_totals": "SELECT event_type AS counter, cast(sum(user_id) AS bigint) AS total FROM events GROUP BY 1",
    "minute_counters": _sql(f"SELECT counter, {_fmt('minute')} AS minute, cast(n AS bigint) AS n FROM pts", _POINTS),
    "last_n_minutes": _sql(
        "SELECT counter, "
        + ", ".join(
            f"cast(coalesce(sum(n) FILTER (minute <= {_E} AND minute > date_trunc('minute', {_E}) - INTERVAL {n} MINUTE), 0) AS bigint) AS last_{n}" for n in (1, 5, 30, 60)
        )
        + " FROM pts GROUP BY counter",
        _POINTS,
    ),
    "rolling_sum": _sql(
        f"SELECT counter, {_fmt('minute')} AS minute, cast(sum(n) OVER (PARTITION BY counter ORDER BY minute RANGE BETWEEN INTERVAL 59 MINUTE PRECEDING AND CURRENT ROW) AS bigint) AS rolling FROM pts",
        _POINTS,
    ),
    "zero_filled_history": _sql(
        f"""SELECT counter, string_agg(cast(coalesce(n, 0) AS string), ',' ORDER BY slot) AS points, any_value(total) AS total, cast(coalesce(sum(n) FILTER (slot = 59), 0) AS bigint) AS last
        FROM (SELECT c.counter, slot, cast(p.n AS bigint) AS n, total FROM
          (SELECT counter, cast(sum(n) AS bigint) AS total FROM pts WHERE minute <= {_E} GROUP BY counter) c
          CROSS JOIN (SELECT unnest(range(0, 60)) AS slot) s
          LEFT JOIN pts p ON p.counter = c.counter AND p.minute = date_trunc('minute', {_E}) - to_minutes(59 - slot)) GROUP BY counter""",
        _POINTS,
    ),
    "named_history": _sql(
        f"""SELECT counter, string_agg(cast(coalesce(n, 0) AS string), ',' ORDER BY slot) AS points, cast(any_value(coalesce(total, 0)) AS bigint) AS total,
          cast(coalesce(sum(n) FILTER (slot = 59), 0) AS bigint) AS last
        FROM (SELECT c.counter, slot, cast(p.n AS bigint) AS n, (SELECT sum(q.n) FROM pts q WHERE q.counter = c.counter AND q.minute <= {_E}) AS total FROM
          (SELECT unnest(['click', 'never seen']) AS counter) c CROSS JOIN (SELECT unnest(range(0, 60)) AS slot) s
          LEFT JOIN pts p ON p.counter = c.counter AND p.minute = date_trunc('minute', {_E}) - to_minutes(59 - slot)) GROUP BY counter""",
        _POINTS,
    ),
    "stream_minute_counters": _sql(
        f"""SELECT counter, {_fmt('minute')} AS minute, cast(n AS bigint) AS n FROM pts
        WHERE minute + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
        _POINTS,
    ),
    "stream_parse": _sql(
        """SELECT key AS item_hash, path AS filename, p_title AS title, CASE WHEN p_title IS NOT NULL THEN p_year END AS year, CASE WHEN p_title IS NOT NULL THEN p_season END AS season,
           CASE WHEN p_title IS NOT NULL THEN p_episode END AS episode, CASE WHEN p_title IS NOT NULL THEN kind END AS content_type FROM pp""",
        *_parse_ctes("fi", "path", "pp"),
    ),
}


# --- stages over link results -------------------------------------------------

_LINKED = f"""(SELECT pi.*, {_ELIGIBLE} AS due, f.catalog_id FROM pi JOIN ({ORACLES['link_fan_out']}) f ON f.item_hash = pi.item_hash)"""
ORACLES["stage_link"] = _sql(
    f"""SELECT item_hash, completed OR (due AND catalog_id IS NOT NULL) AS completed,
      attempts + CASE WHEN NOT due THEN 0 WHEN catalog_id IS NULL THEN 2 ELSE 1 END AS attempts,
      {_fmt(f'CASE WHEN due THEN {AS_OF} ELSE last_processed END')} AS last_processed FROM {_LINKED}"""
)
ORACLES["stage_counters"] = _sql(
    f"""SELECT 'names_parsed' AS counter, count(*) AS total FROM pn WHERE {_ELIGIBLE} AND p_title IS NOT NULL
    UNION ALL SELECT 'names_unparsed', count(*) FROM pn WHERE {_ELIGIBLE} AND p_title IS NULL
    UNION ALL SELECT 'links_found', count(*) FROM {_LINKED} WHERE due AND catalog_id IS NOT NULL
    UNION ALL SELECT 'links_missed', count(*) FROM {_LINKED} WHERE due AND catalog_id IS NULL
    UNION ALL SELECT 'pack_outputs', cast(coalesce(sum(outputs), 0) AS bigint) FROM status
    UNION ALL SELECT 'packs_done', count(*) FILTER (completed) FROM status
    UNION ALL SELECT 'packs_waiting', count(*) FILTER (NOT completed) FROM status""",
    *_PARSED, _PACKS, _STATUS,
)


# --- streams: no row is too young or too old to be taken ------------------------

_ANY = [x.replace(_elig("m"), "true") for x in (_SINGLES, _PACKS)]
_BAD = "k % 31 = 0 OR shape IN ('lost', 'tail') OR (hole AND shape <> 'empty')"
ORACLES |= {
    "link_text_years": ORACLES["link_provider_b"],
    "snapshot_pending": _sql(f"SELECT item_hash, filename, size_bytes, {_STATE} FROM it WHERE {_ELIGIBLE}"),
    "stream_discover": f"SELECT DISTINCT name, false AS completed, cast(0 AS int) AS attempts FROM ({ORACLES['listing_filter']})",
    "stream_extract": _sql(f"SELECT source, NOT ({_BAD}) AS completed, cast(1 + cast({_BAD} AS int) AS int) AS attempts FROM docs", _DOCS),
    "stream_link": f"""SELECT item_hash, catalog_id IS NOT NULL AS completed, cast(CASE WHEN catalog_id IS NULL THEN 2 ELSE 1 END AS int) AS attempts
        FROM ({ORACLES['link_fan_out']})""",
    "stream_link_retry": f"SELECT lookup_key, catalog_id FROM ({ORACLES['link_cascade']})",
    "stream_route": _sql(
        """SELECT item_hash, file_index, catalog_id, output_type, size_bytes, season, episode FROM (SELECT * FROM singles UNION ALL SELECT * FROM expanded)
        QUALIFY row_number() OVER (PARTITION BY item_hash, file_index ORDER BY size_bytes DESC, season DESC NULLS LAST, episode DESC NULLS LAST) = 1""",
        *_ANY, *_WON_PARSED, _EXPANDED,
    ),
    "stream_route_retry": _sql(
        """SELECT item_hash, true AS completed, cast(1 AS int) AS attempts FROM singles
        UNION ALL SELECT item_hash, completed, cast(2 AS int) FROM status""",
        *_ANY, _STATUS,
    ),
}

# --- streams with state -----------------------------------------------------------

_CLOSED = """closed AS (SELECT p.*, date_trunc('minute', w) - INTERVAL 1 MINUTE AS as_of
  FROM pts p, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS w FROM events) WHERE minute + INTERVAL 1 MINUTE <= w)"""
ORACLES |= {
    "stream_claims": _sql(
        f"""SELECT item_hash, cast(attempts AS int) AS attempts, {_fmt('due_at')} AS due_at FROM (
          SELECT name AS item_hash, 1 AS attempts, last_processed AS due_at FROM src WHERE NOT completed AND attempts = 0
          UNION ALL SELECT name, greatest(attempts, 1) + 1, last_processed + INTERVAL 1 DAY FROM src
          WHERE NOT completed AND attempts < 3 AND last_processed + INTERVAL 1 DAY <= (SELECT max(last_processed) FROM src))"""
    ),
    "stream_relink": ORACLES["stream_link_retry"],
    "stream_link_memo": _sql(f"""SELECT item_hash, catalog_id IS NOT NULL AS completed, cast(CASE WHEN catalog_id IS NULL THEN 2 ELSE 1 END AS int) AS attempts, catalog_id
        FROM (SELECT item_hash, CASE length(lookup_key) % 4 WHEN 0 THEN 'tt0' WHEN 2 THEN NULL ELSE catalog_id END AS catalog_id FROM fanned)""", *_CASCADE),
    "stream_names": f"SELECT * FROM ({ORACLES['stream_discover']}) WHERE name IS NOT NULL",
    "stream_history": _sql(
        f"""SELECT counter, {_fmt('as_of')} AS as_of, string_agg(cast(coalesce(n, 0) AS string), ',' ORDER BY slot) AS points, any_value(total) AS total, cast(coalesce(sum(n) FILTER (slot = 59), 0) AS bigint) AS last
        FROM (SELECT c.counter, c.as_of, slot, cast(p.n AS bigint) AS n, total FROM
          (SELECT counter, as_of, cast(sum(n) AS bigint) AS total FROM closed GROUP BY counter, as_of) c
          CROSS JOIN (SELECT unnest(range(0, 60)) AS slot) s
          LEFT JOIN closed p ON p.counter = c.counter AND p.minute = c.as_of - to_minutes(59 - slot)) GROUP BY counter, as_of""",
        _POINTS, _CLOSED,
    ),
}


# --- tables that cost what a batch or page touches ---------------------------------

_DONE = "completed OR coalesce(c.good, false)"
_TRIES = "CASE WHEN completed THEN attempts ELSE 0 END + CASE WHEN c.name IS NULL THEN 0 WHEN c.bad THEN 2 ELSE 1 END"
ORACLES |= {
    "link_tiers": ORACLES["link_cascade"],
    "first_nonempty_tiers": ORACLES["first_nonempty_source"],
    "upsert_touched": ORACLES["upsert_nullable_key"],
    "stored_page": ORACLES["deep_page"],
    "maintained_depths": _sql(
        f"""SELECT 'sources' AS stage, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done AND tries < 2) AS unresolved, count(*) FILTER (NOT done AND tries >= 2) AS exhausted
        FROM (SELECT {_DONE} AS done, {_TRIES} AS tries FROM src LEFT JOIN c ON src.name = c.name)""",
        _CLAIMED,
        "c AS (SELECT name, bool_or(l_quantity > 25) AS good, bool_or(l_quantity <= 5) AS bad FROM cl GROUP BY name)",
    ),
}
ORACLES |= {"polled_listing": ORACLES["listing_filter"], "stream_polled_listing": ORACLES["listing_filter"]}
