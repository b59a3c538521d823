"""A training-data pipeline over `documents`: language, toxicity, exact and near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents, further columns of docs
included, whatever their names; an empty table gives no rows in any stage; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common, exact_dedup, langid, minhash, packing, toxicity

#: A document whose language score is below this is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no learned language: predicted `und` (null or empty text, no letter), or with a score below
    LEAST_LANGUAGE_SCORE. If no row has a language to learn from, none can be judged, and all are kept. Ties of machines go to the
    first language; repeated rows are judged each, alike; a null lang or id is only not learned from.
    """
    model = langid.train(docs.filter(~common.held_out(3, 1)))
    if not model.families:
        return docs
    lang, score = (common.fresh(docs, name) for name in ("_lang", "_score"))
    known = langid.identify(docs, model, names=(lang, score))
    return known.filter(f"`{lang}` <> 'und' and `{score}` >= {LEAST_LANGUAGE_SCORE}").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity model rejects (score of THRESHOLD or more; a score equal to it is rejected).

    A null or empty text has no toxic feature and stays, as do all if there are no labels of both kinds. Repeated rows are
    judged each, alike.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels").filter(~common.held_out(4, 2)))
    score, predicted = (common.fresh(docs, name) for name in ("_score", "_toxic"))
    return toxicity.score(docs, model, names=(score, predicted)).filter(f"`{predicted}` = 0").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id, and one row of it if rows repeat. Null and empty texts are equal;
    a null id stays only where the group has no other.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity of 0.8 or more; the smallest id stays.

    Null texts and texts without words have no copies; rows with a null id stay; rows that repeat the id that stays all stay.
    """
    return minhash.drop_near_copies(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 8192 bytes without two pieces of one source or of one text.

    A null or empty text is a piece of one byte; a null source conflicts with nothing; pieces of equal size go by id, then piece.
    """
    return packing.best_fit(docs)


STAGES = [("language_id", language), ("toxicity", toxic), ("exact_dedup", exact_copies), ("minhash_near_dedup", near_copies), ("best_fit_packing", pack)]

#: SQL can't express the fitted models, the packing order or the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
