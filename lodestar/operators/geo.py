"""Locations: centroids, neighbours within a radius, regions by covered share, bridges from queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import EARTH_KM, haversine_km


def centroids(points: DataFrame, loc: str = "loc", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(loc, lat, lon): exact medians over points that are known and not (0, 0)."""
    good = points.filter((F.col(lat) != 0) | (F.col(lon) != 0)).dropna(subset=[loc, lat, lon])
    return good.groupBy(loc).agg(F.median(lat).alias(lat), F.median(lon).alias(lon))


def neighbours(places: DataFrame, radius_km: float, loc: str = "loc", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(loc, nb, dist_km, nb_rank): other places within the radius, nearest first.

    Places meet only in equal or touching cells of a latitude-longitude grid as wide as the radius, so this is an
    equi-join. A row of cells is as wide in longitude as its own latitude needs.
    """
    if radius_km <= 0:
        return places.select(loc, F.col(loc).alias("nb"), F.lit(0.0).alias("dist_km"), F.lit(1).alias("nb_rank")).limit(0)
    step = math.degrees(radius_km / EARTH_KM) * 1.0001
    row = F.floor((F.col(lat) + 90) / step).cast("long")
    # degrees of longitude that the radius spans at the far edge of the row next to a place's own
    edge = F.least(F.abs((F.col("_y") + 2) * step - 90), F.lit(90.0))
    other = F.least(F.abs((F.col("_y") - 1) * step - 90), F.lit(90.0))
    far = F.greatest(edge, other)
    half = F.lit(math.sin(radius_km / EARTH_KM / 2))
    ratio = half / F.greatest(F.cos(F.radians(far)), F.lit(1e-9))
    width = F.when(ratio >= 1, 360.0).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001)
    cells = F.greatest(F.floor(360.0 / F.least(width, F.lit(360.0))), F.lit(1)).cast("long")
    at = places.select(F.col(loc).alias("_loc"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), row.alias("_y"))
    spread = at.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_dy")).withColumn("_row", F.col("_y") + F.col("_dy"))

    def cell_of(rows: DataFrame, y: str) -> DataFrame:
        named = rows.withColumn("_y", F.col(y))
        n = named.withColumn("_n", cells)
        return n.withColumn("_x", F.least(F.floor((F.col("_lon") + 180) / 360 * F.col("_n")), F.col("_n") - 1).cast("long"))

    one = cell_of(spread, "_row").select("_loc", "_lat", "_lon", "_row", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_x") + d, F.col("_n"))))).alias("_cell"))
    two = cell_of(at, "_y").select(F.col("_loc").alias("nb"), F.col("_lat").alias("_lat2"), F.col("_lon").alias("_lon2"), F.col("_y").alias("_row"), F.col("_x").alias("_cell"))
    near = one.join(two, ["_row", "_cell"]).filter(F.col("_loc") != F.col("nb")).withColumn("dist_km", haversine_km(F.col("_lat"), F.col("_lon"), F.col("_lat2"), F.col("_lon2")))
    order = Window.partitionBy("_loc").orderBy("dist_km", "nb")
    return near.filter(F.col("dist_km") <= radius_km).select(F.col("_loc").alias(loc), "nb", "dist_km", F.row_number().over(order).alias("nb_rank"))


def region_cover(pairs: DataFrame, known: DataFrame, cover: float, search: str = "search_location_id", item: str = "item_location_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, region, loc, n): the most frequent item locations that cover a share of each region's pairs.

    A region is a search location that is no location of `known` (column loc). by: further grouping columns.
    """
    regional = pairs.join(known.select(F.col("loc").alias(search)).distinct(), search, "left_anti")
    counts = regional.groupBy(*by, F.col(search).alias("region"), F.col(item).alias("loc")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by, "region")
    before = F.coalesce(F.sum("n").over(group.orderBy(F.desc("n"), "loc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.withColumns({"_before": before, "_all": F.sum("n").over(group)})
    return shares.filter((F.col("_before") / F.col("_all") < cover - 1e-9) & F.lit(cover > 0)).select(*by, "region", "loc", "n")


def region_cover_by_fold(pairs: DataFrame, known: DataFrame, cover: float, fold: str = "fold", folds: int = 5) -> DataFrame:
    """The cover of each fold as learnt from all other folds, in one job (R08): counts of a fold are taken off the totals."""
    out = pairs.select("search_location_id", "item_location_id", F.col(fold).alias("_f"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_f"))
    return region_cover(out.withColumn(fold, F.explode(others)), known, cover, by=(fold,))


def query_locations(queries: DataFrame, query: str, location: str, corpus_locations: DataFrame, regions: DataFrame, near: DataFrame, mode: str = "city") -> DataFrame:
    """(query, loc): where a query may find items. mode: city, city+neighbors or neighbors.

    A location of the corpus (column loc) is a city: itself, or with or only its neighbours in the corpus (loc, nb); others are
    regions: their cover's locations in the corpus (region, loc), nothing in mode neighbors.
    """
    if mode not in ("city", "city+neighbors", "neighbors"):
        raise ValueError(f"unknown mode: {mode}")
    known = corpus_locations.select("loc").distinct()
    asked = queries.select(query, F.col(location).alias("_at"))
    city = asked.join(known.withColumnRenamed("loc", "_at"), "_at", "left_semi")
    parts = []
    if mode != "neighbors":
        region = asked.join(known.withColumnRenamed("loc", "_at"), "_at", "left_anti")
        parts += [city.select(query, F.col("_at").alias("loc")), region.join(regions.select(F.col("region").alias("_at"), "loc"), "_at").join(known, "loc", "left_semi").select(query, "loc")]
    if mode != "city":
        parts.append(city.join(near.select(F.col("loc").alias("_at"), F.col("nb").alias("loc")), "_at").join(known, "loc", "left_semi").select(query, "loc"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
