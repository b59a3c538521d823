"""Lists of strings and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STRINGS = "array<string>"


def clean_list(values: Column) -> Column:
    """Without nulls and empty strings; null as the empty list."""
    return F.coalesce(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.array().cast(NO_STRINGS))


def distinct_folded(values: Column) -> Column:
    """Values that no earlier one equals but for case, in order, in their first spelling."""
    own = clean_list(values)
    folded = F.transform(own, F.lower)
    return F.filter(own, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two lists share a value; never null."""
    return F.coalesce(F.arrays_overlap(clean_list(a), clean_list(b)), F.lit(False))


def holds(values: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(clean_list(values), x), F.lit(False))


def join_ids(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), " ")


def split_ids(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
