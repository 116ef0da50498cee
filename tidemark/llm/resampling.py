"""A sample of documents that follows a target's distribution, drawn by importance weights.

Features are hashed runs of words. A bucket's gain is the log-ratio of its smoothed shares in the target and
in all documents, in thousandths; a document's weight is the floored mean of its features' gains, looked up
for whole arrays. Adding a Gumbel number that follows from the doc_id makes the highest scores a draw without
replacement. The draw is ordered by a distributed radix sort (``radix.py``).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import radix, spans, work

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Every byte as it stands in a word, a space for those in none.
_PLAIN = np.where(_WORD, spans.LOWER, 0x20).astype(np.uint8)


@dataclass(frozen=True)
class Rule:
    """Features are runs of 1 to ``width`` words in ``buckets`` buckets; of documents with at least ``least_words``
    words ``share`` of ``out_of`` are drawn."""

    width: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    share: int = 10
    out_of: int = 100


def features(c: spans.Chunk, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every length of a run: text number and bucket of each run, and the number of words of each text."""
    data = _PLAIN[c.data]
    start, end, doc = spans.words(data, c.off)
    n_words = np.bincount(doc, minlength=len(c))
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    if len(size):
        inside = np.ones(len(joined), bool)
        inside[at + size] = False
        joined[inside] = spans.gather(data, start, size, np.arange(len(size)))
    for w in range(1, rule.width + 1):
        first = np.flatnonzero(doc[: len(doc) - w + 1] == doc[w - 1 :])
        if not len(first):
            yield doc[first], first, n_words
            continue
        s, e = at[first], at[first + w - 1] + size[first + w - 1]
        one, which, _ = spans.distinct(joined, s, e)
        raw = joined.tobytes()
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(s[one].tolist(), e[one].tolist())), np.int64, len(one))
        yield doc[first], (crc % rule.buckets)[which], n_words


def bucket_counts(texts: DataFrame, rule: Rule) -> np.ndarray:
    """How many features of all ``texts`` (text) lie in each bucket; at most ``rule.buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for c in spans.chunks(batch.column("text")):
                for _, bucket, _ in features(c, rule):
                    total += np.bincount(bucket, minlength=rule.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(rule.buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its counts in the source and the target, both smoothed by one."""
    extra = len(source)
    over, under = float(source.sum() + extra), float(target.sum() + extra)
    return np.array([math.floor(1000 * math.log((t + 1) * over / ((s + 1) * under))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, rule: Rule) -> DataFrame:
    """doc_id, n_features, n_words and weight of every row of ``docs``; a text without features weighs 0."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in spans.chunks(batch.column("text")):
                count, total, words = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
                for doc, bucket, words in features(c, rule):
                    edge = np.searchsorted(doc, np.arange(len(c) + 1))
                    sums = np.concatenate([[0], np.cumsum(shared.value[bucket])])
                    count += np.diff(edge)
                    total += sums[edge[1:]] - sums[edge[:-1]]
                mean = np.where(count > 0, total // np.maximum(count, 1), 0)
                ids = batch.column("doc_id").slice(c.first, len(c))
                yield pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(words.astype(np.int64)), pa.array(mean)], names=["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def gumbel(rule: Rule) -> Column:
    """A Gumbel number in thousandths from the hash of seed and doc_id; a null doc_id counts as empty."""
    key = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _cutoff(scored: DataFrame, rule: Rule) -> tuple[int, int]:
    """How many documents are drawn, and the least score that may be among them.

    Scores are whole thousandths of logarithms of counts and of a 32-bit hash, so they take some 10^5 values at most.
    """
    by_score = scored.where(F.col("n_words") >= rule.least_words).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    n = by_score["n"].to_numpy()
    take = rule.share * int(n.sum()) // rule.out_of
    return take, int(by_score["score"][int(np.searchsorted(np.cumsum(n), take))].as_py()) if take else 0


def resample(docs: DataFrame, target: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Rows not drawn have no rank. Equal scores go to the smaller doc_id (rows without one last), rows that repeat a
    doc_id to the one with fewer features. A null or empty text has no features and weight 0; no rows give no
    rows, an empty target leaves every gain to the smoothing. Further columns are not looked at. Texts are read
    twice, once for the counts and once for the weights, and never shuffled.
    """
    gain = gains(bucket_counts(docs, rule), bucket_counts(target, rule))
    scored = weights(docs, gain, rule).withColumn("score", F.col("weight") + gumbel(rule))
    scored = work.written(scored.withColumn("row", F.monotonically_increasing_id()))
    take, least = _cutoff(scored, rule)
    # scores below the one that the last place has can't be drawn: they need no order
    able = scored.where((F.col("n_words") >= rule.least_words) & (F.col("score") >= least) & F.lit(take > 0))
    keys = able.select("row", (-F.col("score")).alias("k_score"), F.col("doc_id").isNull().cast("long").alias("k_null"), F.coalesce("doc_id", F.lit(0)).alias("k_doc"), F.col("n_features").alias("k_size"))
    drawn = radix.ranked(keys, ["k_score", "k_null", "k_doc", "k_size"]).where(F.col("rank") <= take).select("row", "rank")
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
