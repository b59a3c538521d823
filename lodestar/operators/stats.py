"""Statistics of training pairs, with and without the event itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import share
from .rank import small

#: Counters: name, keys of the pairs, keys under which an event's own share is taken off.
COUNTERS = {
    "text_pos": (("search_query",), ()),
    "text_item": (("search_query", "item_id"), ("item_id",)),
    "text_mc": (("search_query", "item_microcat_id"), ("item_microcat_id",)),
    "item_pop": (("item_id",), ("item_id",)),
    "loc_loc": (("search_location_id", "item_location_id"), ("item_location_id",)),
    "loc_pos": (("search_location_id",), ()),
}


def dedup_repeats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with n_repeats."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_repeats"))


def counters(rows: DataFrame, pairs: DataFrame, leave_one_out: bool, event: str = "event_id") -> DataFrame:
    """rows with the counters of pairs; with leave_one_out less what the row's own event adds to each. Null keys count 0.

    rows are dealt by event once (for what an event adds) and by item once; counters without the item are looked up in a
    table that is broadcast if it is small. An event's and an item's rows meet in one task. pairs may be rows themselves.
    """
    c, keys = F.col, [*dict.fromkeys(k for of, _ in COUNTERS.values() for k in of)]
    both = rows.withColumns({"_w": F.lit(1 if rows is pairs else 0), "_row": F.lit(True)})
    if rows is not pairs:
        both = both.unionByName(pairs.select(event, *keys).withColumns({"_w": F.lit(1), "_row": F.lit(False)}), allowMissingColumns=True)

    def held(by: tuple[str, ...]) -> Column:
        """How many pairs have the row's values of by."""
        known = reduce(Column.__and__, (c(k).isNotNull() for k in by))
        return F.when(known, F.sum("_w").over(Window.partitionBy(*by))).otherwise(0)

    if leave_one_out:
        own = {f"_own_{'_'.join(k)}": (event, *k) for k in dict.fromkeys(k for _, k in COUNTERS.values())}
        for name, by in own.items():  # the event alone comes first, and so deals the rows
            both = both.withColumn(name, held(by))
    by_item = {name: of for name, (of, _) in COUNTERS.items() if "item_id" in of}
    # the item alone deals the rows, so both counters need one exchange
    out = both.repartition("item_id").withColumns({name: held(of) for name, of in by_item.items()}).filter("_row").drop("_w", "_row")
    rest = {name: of for name, (of, _) in COUNTERS.items() if name not in by_item}
    own_keys = list(dict.fromkeys(k for of in rest.values() for k in of))
    # the other counters and each text's events, in one table of one pass: grouping_id tells a counter's rows, -1 an event count's
    sets = pairs.groupingSets([[c(k) for k in of] for of in rest.values()], *map(c, own_keys)).agg(F.grouping_id().cast("int").alias("_g"), F.count("*").alias("_n"))
    texts = pairs.filter(c(event).isNotNull()).select("search_query", event).distinct().groupBy("search_query").agg(F.lit(-1).alias("_g"), F.count("*").alias("_n"))
    few = small(sets.unionByName(texts, allowMissingColumns=True))
    number = {name: sum(1 << i for i, k in enumerate(reversed(own_keys)) if k not in of) for name, of in rest.items()}
    for name, of in (rest | {"text_events": ("search_query",)}).items():
        mine = few.filter(c("_g") == number.get(name, -1)).select(*of, c("_n").alias(name))
        out = out.join(mine, list(of), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if not leave_one_out:
        return out
    less = {name: c(name) - c(f"_own_{'_'.join(k)}") for name, (_, k) in COUNTERS.items()}
    return out.withColumns(less | {"text_events": c("text_events") - (c("_own_") > 0).cast("int")}).drop(*own)


def features() -> dict[str, Column]:
    """The statistics' features, from the counters."""
    c = F.col
    return {
        "st_text_freq_log": F.log1p(c("text_events").cast("double")),
        "st_text_item": c("text_item").cast("double"),
        "st_text_mc_share": share(c("text_mc"), c("text_pos")),
        "st_item_pop_log": F.log1p(c("item_pop").cast("double")),
        "st_loc_share": share(c("loc_loc"), c("loc_pos")),
        "st_loc_pos_log": F.log1p(c("loc_pos").cast("double")),
    }


def train_stats(rows: DataFrame, pairs: DataFrame, leave_one_out: bool, event: str = "event_id") -> DataFrame:
    return counters(rows, pairs, leave_one_out, event).withColumns(features()).drop("text_events", *COUNTERS)
