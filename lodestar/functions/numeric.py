"""Scalar numbers: distances, buckets, codes, guarded shares, standardisation, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Modulus of category codes (a fixed value).
CATEGORY_CODES = 1_000_003


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2.0) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2.0)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def crc_bucket(text: Column, n: int) -> Column:
    """crc32 of the UTF-8 bytes modulo n: folds and halves."""
    return (F.crc32(F.encode(text, "UTF-8")) % n).cast("int")


def category_code(name: Column) -> Column:
    """The same code for a name in any corpus; null as the empty name."""
    return crc_bucket(F.coalesce(name, F.lit("")), CATEGORY_CODES)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole)


def valid_price_log(price: Column, most: float = 1e9) -> Column:
    """log1p of a price between 0 and `most`, else null."""
    return F.when((price > 0) & (price < most), F.log1p(price.cast("double")))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(idf: Column, tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def rrf_weight(rank: Column, k: int = 60) -> Column:
    """rank from 1."""
    return F.lit(1.0).cast("double") / (k + rank)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def standardise(x: Column, median: float, mean: float, std: float, limit: float = 5.0) -> Column:
    """Median in place of null, then centred, scaled and clipped."""
    return clip((F.coalesce(x, F.lit(float(median))) - mean) / (std or 1.0), -limit, limit)
