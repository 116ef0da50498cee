"""A cleaning pipeline over documents: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``docs``. Extra columns pass through, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import id_filter, language, packing, queries, shingle_join, toxicity, work

#: A text whose language holds less than this share of its n-grams is in none of the learned languages.
LEAST_LANGUAGE = 0.1


def _filtered(docs: DataFrame, judge: Callable[[DataFrame, tuple[str, ...]], DataFrame], stays: Column) -> DataFrame:
    """The rows of ``docs`` that stay by the columns ``judge`` adds; its names can't clash with those of ``docs``."""
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own.values()).withColumns({c: F.col(own[c]) for c in ("text",)})
    return judge(plain, tuple(own.values())).where(stays).select(*[F.col(x).alias(c) for c, x in own.items()])


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two language models call toxic go; a text without letters stays."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d, keep: toxicity.score(d, model, 0.3, keep), F.col("predicted") == 0)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (or text), or in no language learned from the rest, go.

    Where no document has a language there is nothing to judge by, and all stay.
    """
    work.ship(spark)
    filters = language.learn(docs)
    if not filters.languages:
        return docs
    stays = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)
    return _filtered(docs, lambda d, keep: language.predict(d, filters, keep), stays)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays (one without comes last).

    Rows are told apart by a number, so repeated or null doc_ids are documents of their own. A number follows
    from how files are cut into tasks, which a lost or new executor can change between jobs: rows are written
    with it once, and all steps read that table.
    Only texts that two filters of fixed size leave open are shuffled: of those that may have to go, the ones
    that may stay all the same.
    """
    work.ship(spark)
    numbered = work.written(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = shingle_join.near_copies(numbered.select(F.col("_row").alias("doc_id"), "text"), shingle_join.Rule(words=5, similar=80, out_of=100))
    ids = numbered.select("_row", F.col("doc_id").alias("id"))
    rank = F.struct(F.col("id").isNull().alias("without"), "id", "_row")
    first = groups.select(F.col("doc_id").alias("_row"), "component_id").join(ids, "_row").groupBy("component_id").agg(F.min(rank).alias("r"))
    stays = work.written(first.select("r._row"))
    goes = id_filter.marked(ids.select("_row").join(stays, "_row", "left_anti"))
    sure = id_filter.held(numbered, goes, "_row", inside=False)
    both = goes & id_filter.marked(stays)  # one look at a text tells whether it may go and may stay
    return sure.unionByName(id_filter.held(numbered, both, "_row").join(stays, "_row", "left_semi")).drop("_row")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents in sequences of at most 2048 ids, one row per piece."""
    work.ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [("toxicity", stage_toxicity), ("language", stage_language), ("near_duplicates", stage_near_duplicates), ("packing", stage_packing)]
#: Learned models and tokenizers have no SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.written(docs)
    return docs
