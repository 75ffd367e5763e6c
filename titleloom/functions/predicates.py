"""Row filters of the queue, routing and file stages."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleloom import fixed_values as V


def at(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def eligible(
    as_of: datetime | str | Column,
    max_attempts: int = V.MAX_ATTEMPTS,
    cooldown_minutes: int = V.COOLDOWN_MINUTES,
) -> Column:
    """Not done, attempts left, and either untried or past the cooldown (strictly)."""
    waited = F.col("last_processed") < at(as_of) - F.expr(f"INTERVAL {int(cooldown_minutes)} MINUTES")
    return (
        ~F.col("completed")
        & (F.col("attempts") < max_attempts)
        & ((F.col("attempts") == 0) | waited)
    )


def media_file(
    path: Column,
    size: Column,
    extensions: list[str] = V.VIDEO_EXTENSIONS,
    sample_below: int = V.SAMPLE_BELOW_BYTES,
) -> Column:
    low = F.lower(path)
    ending = low.rlike(r"\.(?:" + "|".join(re.escape(e) for e in extensions) + r")\z")
    return ending & ~(low.contains(V.SAMPLE_WORD) & (size < sample_below))


def is_single(content_type: Column, season: Column, episode: Column) -> Column:
    return (content_type == "movie") | (
        (content_type == "series") & season.isNotNull() & episode.isNotNull()
    )


def is_pack(content_type: Column, season: Column, episode: Column) -> Column:
    return (content_type == "series") & season.isNotNull() & episode.isNull()


def is_unrouted(content_type: Column, season: Column, episode: Column) -> Column:
    """Neither single nor pack: these wait forever unless reported."""
    routed = is_single(content_type, season, episode) | is_pack(content_type, season, episode)
    return ~F.coalesce(routed, F.lit(False))


def key_well_formed(key: Column) -> Column:
    """40 hex digits. A quality column, not an ingest filter."""
    return F.coalesce(key.rlike(V.KEY_FORMAT), F.lit(False))
