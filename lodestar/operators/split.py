"""Split of pairs into training and validation by query text, catalogue sampling, evaluation set."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import at_most
from .rank import hash_order, keep_and_fill, sample_exact, small

UNSEEN, SEEN = "new text", "known text"


@dataclass(frozen=True)
class SplitConfig:
    seed: int = 42
    dedup: bool = True
    val_text_fraction: float = 0.10
    seen_text_share: float = 0.37
    catalog_mode: str = "uniform"  # uniform, keep_positives or full
    catalog_size: int = 189_212
    top_k: int = 50
    max_positives: int = 50

    def to_json(self) -> str:
        return json.dumps({k.upper(): v for k, v in asdict(self).items()}, ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> SplitConfig:
        return cls(**{k.lower(): v for k, v in json.loads(text).items()})


def split_by_text(pairs: DataFrame, config: SplitConfig, event: str = "event_id", text: str = "search_query") -> DataFrame:
    """pairs with part (train or val) and slice (null in train).

    A share of the texts goes to val with all its events. Of other texts, one event stays in train and some of the rest
    join val, so that known texts make up their configured share of val's events. Choices follow hashes, not row order.
    Distinct events, read by several choices, are persisted; spark.catalog.clearCache() frees them.
    """
    # all choices are made on distinct events; pairs themselves are read once more, to be marked
    events = pairs.select(text, event).distinct().persist()
    texts = events.select(text).distinct().persist()
    held = sample_exact(texts, text, int(texts.count() * config.val_text_fraction), config.seed).withColumn("_held", F.lit(True))
    marked = events.join(held, text, "left")
    n_unseen = marked.filter("_held").select(event).distinct().count()
    n_seen = round(n_unseen * config.seen_text_share / (1 - config.seen_text_share))
    rest = marked.filter("_held is null").select(text, event)
    order = hash_order(F.concat_ws("/", F.col(text), F.col(event)), config.seed)
    later = rest.withColumn("_n", F.row_number().over(Window.partitionBy(text).orderBy(order))).filter("_n > 1")
    seen = sample_exact(later.select(event).distinct().persist(), event, n_seen, config.seed + 1).withColumn("_seen", F.lit(True))
    kind = F.when(F.col("_held"), UNSEEN).when(F.col("_seen"), SEEN)
    out = pairs.join(small(held), text, "left").join(seen, event, "left").withColumn("slice", kind)
    return out.withColumn("part", F.when(F.col("slice").isNull(), "train").otherwise("val")).drop("_held", "_seen")


def sample_catalog(pairs: DataFrame, val_pairs: DataFrame, config: SplitConfig, item: str = "item_id") -> DataFrame:
    items = pairs.select(item).distinct().persist()  # read several times; pairs would be made anew each time
    if config.catalog_mode == "full":
        return items
    if config.catalog_mode == "uniform":
        return sample_exact(items, item, config.catalog_size, config.seed)
    if config.catalog_mode == "keep_positives":
        return keep_and_fill(items, item, val_pairs, config.catalog_size, config.seed)
    raise ValueError(f"unknown catalog_mode: {config.catalog_mode}")


def select_eval(val_pairs: DataFrame, catalog: DataFrame, config: SplitConfig, event: str = "event_id", item: str = "item_id") -> DataFrame:
    """Positives in the catalogue of events with 1 to max_positives of them."""
    return at_most(val_pairs.join(catalog, item, "left_semi"), event, config.max_positives)


def report(split: DataFrame, event: str = "event_id", text: str = "search_query") -> DataFrame:
    """Events, pairs and texts of train, of each slice of val, and of val in all."""
    parts = F.when(F.col("part") == "train", F.array(F.lit("train"))).otherwise(F.array(F.concat(F.lit("val: "), "slice"), F.lit("val")))
    return split.withColumn("name", F.explode(parts)).groupBy("name").agg(F.countDistinct(event).alias("events"), F.count("*").alias("pairs"), F.countDistinct(text).alias("texts"))
