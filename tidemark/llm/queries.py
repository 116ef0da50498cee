"""The registered queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, embedding_dedup, id_files, language, oracle, packing, prefix_forest, prefix_trie, quality_model, quality_rules, resampling, shingle_join, token_counts, toxicity, work
from tidemark.session import prepare

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    work.ship(spark)
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def fold(parts: int, nth: int) -> Column:
    """Whether crc32 of the doc_id's digits leaves ``nth`` on division by ``parts``; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == nth, F.lit(False))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


@query
def op2_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors with a cosine of 0.9 or more linked."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), least=0.9)


@query
def op3_tree_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded over a tree of halves."""
    return byte_bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_ranked_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's ids written to files and read back."""
    path = work.folder(spark)
    id_files.write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return id_files.read_ids(spark, path, digest=True)


@query
def op5_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every text, and whether its distributions are those of a language."""
    docs = table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs))


@query
def op6_bitmask_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learned from two folds of three."""
    docs = table(spark, folder, "documents").withColumn("held_out", fold(3, 1))
    filters = language.learn(docs.where(~F.col("held_out")))
    return language.predict(docs, filters, keep=("doc_id", "held_out"))


@query
def op7_boosted_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text, learned from the labels of four folds of five."""
    docs = table(spark, folder, "documents").withColumn("held_out", fold(5, 0))
    forest = quality_model.learn(docs.where(~F.col("held_out")), table(spark, folder, "labels"), "quality")
    return quality_model.score(docs, forest, 0.3, keep=("doc_id", "held_out"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from three folds of four: two are counted, the third fits the weights."""
    rows = work.written(toxicity.labelled_texts(docs.where(~fold(4, 2)), labels, "toxic"))
    return toxicity.learn(rows.where(~fold(4, 3)), rows.where(fold(4, 3)))


@query
def op8_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned from the labels of three folds of four."""
    docs = table(spark, folder, "documents")
    model = toxicity_model(docs, table(spark, folder, "labels"))
    return toxicity.score(docs.withColumn("held_out", fold(4, 2)), model, 0.3, keep=("doc_id", "held_out"))


@query
def op9_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    """All documents joined on five-word shingles at a Jaccard similarity of 0.8."""
    return shingle_join.near_copies(table(spark, folder, "documents"), shingle_join.Rule(words=5, similar=80, out_of=100))


@query
def op10_distinct_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text, each distinct pre-token counted once."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op11_halved_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), every=100, most=6)


SQL["op11_halved_prefix_trie"] = oracle.TRIE


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), resampling.Rule())


SQL["op12_importance_resampling"] = oracle.RESAMPLING


@query
def op13_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 vectors nearest to every 20th one, by inner product."""
    return prefix_forest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, prefix_forest.Rule(nearest=20))
