"""Features of items, queries and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import category_code, haversine_km, valid_price_log
from ..functions.text import word_count
from .rank import gap_to_best

#: Columns of a feature table that no model reads.
SERVICE = ("qid", "item_idx", "label", "fold", "val_part")
CATEGORICAL = ("it_microcat", "it_category", "cat_query_category", "cat_item_loc", "cat_query_loc")


def item_features(items: DataFrame, loc: str = "item_location_id") -> DataFrame:
    """items (an id first, then the processed item columns with title_len and desc_len) with the item features."""
    c = F.col
    size = items.groupBy(loc).agg(F.count("*").alias("_n"))
    flag = lambda x: F.coalesce(c(x).cast("int"), F.lit(0))
    return items.join(size, loc, "left").withColumns({
        "it_rating": c("item_rating").cast("double"),
        "it_reviews_log": F.log1p(F.coalesce(c("item_rating_reviews_count"), F.lit(0)).cast("double")),
        "it_price_log": valid_price_log(c("item_price")),
        "it_microcat": c("item_microcat_id"),
        "it_category": category_code(c("item_category")),
        "it_is_service": flag("item_is_service"),
        "it_phone_hidden": flag("item_is_phone_hidden"),
        "it_msg_forbidden": flag("item_is_message_forbidden"),
        "it_title_len": c("title_len"),
        "it_desc_len_log": F.log1p(c("desc_len").cast("double")),
        "geo_loc_size_log": F.log1p(F.coalesce("_n", F.lit(0)).cast("double")),
    }).drop("_n")


def query_features(text: Column) -> dict[str, Column]:
    return {"q_words": word_count(text), "q_chars": F.length(text)}


def score_gaps(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("qid",)) -> DataFrame:
    return df.withColumns({f"{c}_gap": gap_to_best(c, by) for c in columns})


def geo_features(df: DataFrame, search_loc: str, item_loc: str, near: DataFrame, centres: DataFrame, lat: str, lon: str) -> DataFrame:
    """df with geo_same_loc, geo_is_neighbor (near: loc, nb) and geo_dist_km from the search location's centre (loc, lat, lon), null without one."""
    pairs = near.select(F.col("loc").alias(search_loc), F.col("nb").alias(item_loc), F.lit(1).alias("_near")).distinct()
    at = centres.select(F.col("loc").alias(search_loc), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"))
    return df.join(pairs, [search_loc, item_loc], "left").join(at, search_loc, "left").withColumns({
        "geo_same_loc": F.coalesce((F.col(search_loc) == F.col(item_loc)).cast("int"), F.lit(0)),
        "geo_is_neighbor": F.coalesce("_near", F.lit(0)),
        "geo_dist_km": haversine_km(F.col("_clat"), F.col("_clon"), F.col(lat), F.col(lon)),
    }).drop("_near", "_clat", "_clon")


def feature_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """What a model reads: all but service, categorical and dropped columns."""
    return [c for c in df.columns if c not in (*SERVICE, *CATEGORICAL, *drop)]
