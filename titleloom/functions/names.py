"""Release-style names to title, year, season and episode, as Column expressions.

Everything here stays inside Catalyst. The noise patterns are one alternation
behind a lazy prefix, so the first noise position costs one regex pass, and the
six season/episode rules are one anchored alternation, so rule order is kept in
one pass as well: the regex engine finishes rule 1 over the whole text before it
tries rule 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as V
from titleloom.functions.barrier import pinned

_MARK = "\u0001"
_EDGE = r"[\s\-()\[\]]"

# Patterns for ASCII text; ``_anywhere`` gives the Unicode form.
_EXTENSION = r"(?i)\.(?:" + "|".join(V.VIDEO_EXTENSIONS) + r")\z"
_NOISE = (
    r"(?s)\A(.*?)(?:"
    + r"\b(?:(?i)(?:" + "|".join(V.NOISE_WORDS) + r"))\b"
    + "".join(f"|(?:{p})" for p in V.NOISE_SHAPES)
    + r"|\z)"
)
_YEAR = rf"\s({V.YEAR})\b"
_TITLE_EDGES = rf"\A{_EDGE}+|\s+{V.YEAR}{_EDGE}*\z|{_EDGE}+\z"

# Groups per rule: prefix, season[, episode]. The NxNN rule looks at its first
# occurrence only (atomic look-ahead) and gives way when that season is zero.
_NO_ZERO_SEASON = r"(?!(?>.*?(?=\b\d{1,2}x\d{2,3}\b))0+x)"
_SEASON_EPISODE = (
    r"(?is)\A(?:"
    + "|".join((_NO_ZERO_SEASON if "x(" in rule else "") + "(.*?)" + rule for rule in V.SEASON_EPISODE)
    + r").*\z"
)
# Season, episode and prefix groups of the six rules; unmatched groups are empty.
_SE_CELLS = f"{_MARK}$2$5$8$11$14$16{_MARK}$3$6$9$12{_MARK}$1$4$7$10$13$15"


def _anywhere(pattern: str) -> str:
    return "(?U)" + pattern


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _match(plain: Column, act: Callable[[str], Column], pattern: str) -> Column:
    """Apply a pattern; Unicode classes, several times slower, only where the text needs them."""
    return F.when(plain, act(pattern)).otherwise(act(_anywhere(pattern)))


def normalise_name(name: Column) -> Column:
    """Drop one video extension, then turn dots and underscores into spaces."""
    return F.translate(F.regexp_replace(name, _anywhere(_EXTENSION), ""), "._", "  ")


def split_season_episode(text: Column, plain: Column) -> Column:
    """['', season, episode, prefix] of the first matching rule, or the text unchanged in one cell."""
    marked = _match(plain, lambda p: F.regexp_replace(text, p, _SE_CELLS), _SEASON_EPISODE)
    return F.split(marked, _MARK, 4)


def _has_season(text: Column, parts: Column) -> Column:
    # A text that itself starts with the mark is told apart by a second look.
    return (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "") & (
        ~text.startswith(_MARK) | text.rlike(_anywhere(_SEASON_EPISODE))
    )


def name_year(text: Column, plain: Column) -> Column:
    """First 19xx/20xx that follows white space."""
    return _match(plain, lambda p: F.regexp_extract(text, p, 1), _YEAR).try_cast("int")


def before_noise(text: Column, plain: Column) -> Column:
    """Text before the first noise token, or all of it."""
    return _match(plain, lambda p: F.regexp_extract(text, p, 1), _NOISE)


def trim_title(raw: Column, plain: Column) -> Column:
    """Trim white space, hyphens and brackets; drop a trailing year."""
    return _match(plain, lambda p: F.regexp_replace(raw, p, ""), _TITLE_EDGES)


def clean_title(raw: Column) -> Column:
    """Trimmed title, NULL below two bytes."""
    title = trim_title(raw, is_ascii(raw))
    return F.when(F.octet_length(title) >= V.MIN_TITLE_BYTES, title)


def type_label(has_season: Column, episode_text: Column) -> Column:
    return (
        F.when(has_season & (episode_text != ""), "episode")
        .when(has_season, "season")
        .otherwise("unknown")
    )


def with_season_episode(df: DataFrame, name: Column, prefix: str) -> DataFrame:
    """Add the intermediate columns the name parser and the file parser share."""
    text, plain, parts = (F.col(f"{prefix}{c}") for c in ("text", "plain", "parts"))
    return (
        df.withColumn(f"{prefix}text", normalise_name(name))
        .withColumn(f"{prefix}plain", is_ascii(text))
        .withColumn(f"{prefix}parts", split_season_episode(text, plain))
        .withColumn(f"{prefix}se", _has_season(text, parts))
    )


def with_parsed_name(df: DataFrame, name: str, struct: str = "parsed") -> DataFrame:
    """Add ``struct<title,year,season,episode,content_type>``; NULL when no title is left.

    Written as stacked projections: Catalyst keeps them apart because each
    regex result is used more than once, so no regex runs twice per row. The
    struct is pinned, so filters on it do not copy the regexes.
    """
    p = "_n_"
    text, plain, parts, se = (F.col(f"{p}{c}") for c in ("text", "plain", "parts", "se"))
    raw = F.when(se, F.get(parts, F.lit(3))).otherwise(before_noise(text, plain))
    out = (
        with_season_episode(df, F.col(name), p)
        .withColumn(f"{p}raw", raw)
        .withColumn(f"{p}title", trim_title(F.col(f"{p}raw"), plain))
    )
    title = F.col(f"{p}title")
    value = F.struct(
        title.alias("title"),
        name_year(text, plain).alias("year"),
        F.when(se, F.get(parts, F.lit(1)).try_cast("int")).alias("season"),
        F.when(se, F.get(parts, F.lit(2)).try_cast("int")).alias("episode"),
        type_label(se, F.get(parts, F.lit(2))).alias("content_type"),
    )
    parsed = F.when(F.octet_length(title) >= V.MIN_TITLE_BYTES, value)
    return out.select(*df.columns, pinned(parsed).alias(struct))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def with_file_episode(
    df: DataFrame,
    path: str,
    parent_season: str,
    struct: str = "file_episode",
    strict: bool = False,
    parent_title: str | None = None,
) -> DataFrame:
    """Add ``struct<season,episode>`` of a file inside a pack, or NULL.

    First season and episode from the file's own name, else a bare ``E05``
    under the parent's season. ``strict`` also asks the own name for a title.
    With ``parent_title`` the struct carries the title as well, falling back to
    the parent's.
    """
    p = "_f_"
    parts, se = F.col(f"{p}parts"), F.col(f"{p}se")
    out = with_season_episode(df.withColumn(f"{p}base", basename(F.col(path))), F.col(f"{p}base"), p)
    own_title = clean_title(F.get(parts, F.lit(3)))
    own = se & (F.get(parts, F.lit(2)) != "")
    if strict:
        own = own & own_title.isNotNull()
    bare = F.regexp_extract(F.col(f"{p}base"), "(?iU)" + V.BARE_EPISODE, 1)

    def cell(season: Column, episode: Column, title: Column | None) -> Column:
        cols = [season.alias("season"), episode.alias("episode")]
        return F.struct(*([title.alias("title")] if title is not None else []), *cols)

    parent = F.col(parent_title) if parent_title else None
    own_cell = cell(
        F.get(parts, F.lit(1)).try_cast("int"),
        F.get(parts, F.lit(2)).try_cast("int"),
        F.coalesce(own_title, parent) if parent is not None else None,
    )
    out = out.withColumn(f"{p}bare", bare)
    bare_cell = cell(F.col(parent_season), F.col(f"{p}bare").try_cast("int"), parent)
    found = F.when(own, own_cell).when(F.col(f"{p}bare") != "", bare_cell)
    return out.select(*df.columns, pinned(found).alias(struct))
