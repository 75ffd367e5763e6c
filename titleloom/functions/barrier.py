"""Keep an expensive value computed once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinned(value: Column) -> Column:
    """The value itself, behind a one-row generator.

    The optimizer moves a filter on a computed column below its projection by
    copying the whole expression, once per use: a filter on a parsed name would
    run the regexes again, and a chain of projections would multiply them. It
    does not move filters on generated columns; filters and pruning of all
    other columns still pass.
    """
    return F.explode(F.array(value))
