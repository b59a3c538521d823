"""Structured filters: hard masks, tri-state matches and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_list, holds, overlaps


def combo_key(category: Column, subcategories: Column, subjects: Column, booking: Column) -> Column:
    """The filters of an event as one comparable value."""
    return F.struct(F.coalesce(category, F.lit("")).alias("category"), F.array_sort(clean_list(subcategories)).alias("subcategories"), F.array_sort(clean_list(subjects)).alias("subjects"), F.coalesce(booking, F.lit(False)).alias("booking"))


def hard_mask(category: Column, subcategories: Column, subjects: Column, booking: Column, item_category: Column, item_subcategory: Column, item_subjects: Column, item_booking: Column) -> Column:
    """All filters that are set hold, exactly; several values of one are alternatives. Never null."""
    return (
        ((F.coalesce(category, F.lit("")) == "") | F.coalesce(item_category == category, F.lit(False)))
        & ((F.size(clean_list(subcategories)) == 0) | holds(subcategories, item_subcategory))
        & ((F.size(clean_list(subjects)) == 0) | overlaps(subjects, item_subjects))
        & (~F.coalesce(booking, F.lit(False)) | F.coalesce(item_booking, F.lit(False)))
    )


def _folded(values: Column) -> Column:
    return F.transform(clean_list(values), F.lower)


def as_list(value: Column) -> Column:
    """A single value as a list; null and empty as none."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value))


def match(wanted: Column, have: Column) -> Column:
    """True, false, or null where nothing is wanted; case doesn't matter. wanted, have: lists."""
    return F.when(F.size(clean_list(wanted)) > 0, overlaps(_folded(wanted), _folded(have)))


def match_filters(category: Column, subcategories: Column, subjects: Column, booking: Column, item_category: Column, item_subcategory: Column, item_subjects: Column, item_booking: Column) -> dict[str, Column]:
    return {
        "category": match(as_list(category), as_list(item_category)),
        "subcategory": match(subcategories, as_list(item_subcategory)),
        "subject": match(subjects, item_subjects),
        "online_booking": F.when(F.coalesce(booking, F.lit(False)), F.coalesce(item_booking, F.lit(False))),
    }


def filter_features(category: Column, subcategories: Column, subjects: Column, booking: Column, item_category: Column, item_subcategory: Column, item_subjects: Column, item_booking: Column) -> dict[str, Column]:
    """1, 0, or null where the filter isn't set (exact matches), and how many are set."""
    has = {
        "flt_category": F.coalesce(category, F.lit("")) != "",
        "flt_subcategory": F.size(clean_list(subcategories)) > 0,
        "flt_subject": F.size(clean_list(subjects)) > 0,
        "flt_booking": F.coalesce(booking, F.lit(False)),
    }
    hit = {
        "flt_category": F.coalesce(item_category == category, F.lit(False)),
        "flt_subcategory": holds(subcategories, item_subcategory),
        "flt_subject": overlaps(subjects, item_subjects),
        "flt_booking": F.coalesce(item_booking, F.lit(False)),
    }
    out = {k: F.when(has[k], hit[k].cast("double")) for k in has}
    return out | {"flt_n_filters": sum((v.cast("int") for v in has.values()), F.lit(0))}


def at_most(df: DataFrame, by: str, most: int) -> DataFrame:
    """Rows of groups of 1 to `most` rows."""
    few = df.groupBy(by).count().filter(F.col("count") <= most).select(by)
    return df.join(few, by, "left_semi")


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = (41.0, 70.0, 19.0, 180.0)) -> Column:
    """Within latitude and longitude bounds (low, high, west, east)."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])
