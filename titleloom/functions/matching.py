"""Name comparison and candidate predicates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleloom import fixed_values as V


def simplify_name(name: Column) -> Column:
    """Lower case, no trailing parenthesis, ``&`` spelled out, only ``[0-9a-z]`` words."""
    text = F.regexp_replace(F.lower(name), r"\([^(]+\)\z", "")
    text = F.replace(text, F.lit("&"), F.lit("and"))
    return F.trim(F.regexp_replace(text, "[^0-9a-z]+", " "))


def similarity_of_simple(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on simplified names; 0.0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longer
    )


def name_similarity(a: Column, b: Column) -> Column:
    return similarity_of_simple(simplify_name(a), simplify_name(b))


def almost_similar_simple(a: Column, b: Column) -> Column:
    """One simplified name starts or ends with the other; an empty one always does."""
    return a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a)


def name_almost_similar(a: Column, b: Column) -> Column:
    return almost_similar_simple(simplify_name(a), simplify_name(b))


def year_similar(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= 1)


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, f"(?U)({V.YEAR})", 1).try_cast("int")


def candidate_year(year_text: Column, release_info: Column) -> Column:
    """Year field first, else the first year of the release text."""
    return F.coalesce(first_year(year_text), first_year(release_info))


def id_ok(candidate_id: Column, prefix: str = V.ID_PREFIX) -> Column:
    return candidate_id.startswith(prefix)


def type_allowed(hint: Column, qid: Column) -> Column:
    """A movie or series hint admits its own types only; any other hint admits all."""
    known = F.coalesce(qid, F.lit(""))
    return (
        F.when(hint == "movie", known.isin(V.HINT_TYPES["movie"]))
        .when(hint == "series", known.isin(V.HINT_TYPES["series"]))
        .otherwise(F.lit(True))
    )


def normalise_type(qid: Column) -> Column:
    return F.when(qid.isin(V.SERIES_TYPES), "series").otherwise("movie")


def type_hint(season: Column, episode: Column) -> Column:
    return F.when(season.isNotNull() | episode.isNotNull(), "series")


def lookup_key(title: Column, year: Column, hint: Column) -> Column:
    """Text form of (title, year, hint). Never NULL for a title, so joins on it are null-safe."""
    return F.concat_ws(
        "|",
        F.regexp_replace(F.lower(title), r"(?U)\A\s+|\s+\z", ""),
        F.coalesce(year, F.lit(0)).cast("string"),
        F.coalesce(hint, F.lit("any")),
    )


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    """Title, year and hint a lookup key was made of. The title may hold bars itself."""
    tail = F.substring_index(key, "|", -2)
    year, hint = F.substring_index(tail, "|", 1), F.substring_index(tail, "|", -1)
    return (
        F.substring(key, F.lit(1), F.length(key) - F.length(tail) - 1),
        F.when(year != "0", year.try_cast("int")),
        F.when(hint != "any", hint),
    )
