"""The draw against a plain reading of its formulas, its SQL, and the radix sort against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, radix
from tidemark.llm import resampling as R


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def runs(text, rule):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % rule.buckets for k in range(1, rule.width + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, rule):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text, rule))
    for text in target:
        t.update(runs(text, rule))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + rule.buckets) / ((s[b] + 1) * (big_t + rule.buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        f = runs(text, rule)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((i for i in range(len(rows)) if len(words(docs[i][1])) >= rule.least_words), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    rank = {i: n + 1 for n, i in enumerate(able[: rule.share * len(able) // rule.out_of])}
    return Counter(tuple(r) + (rank.get(i),) for i, r in enumerate(rows))


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    docs = [(None, None), (5, None), (6, ""), (7, " \n\t"), (8, "Été ÉTÉ été ... x2 3"), (None, "a b c"), (-4, "w1 " * 50)]
    docs += [(i + 10, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.choice([3, 19, 20, 40, 300])))) for i in range(n)]
    docs += [docs[9]] * 5 + [(20, "w1 w2 " * 30), (None, "W3,w4;" * 12), (1 << 40, "w5\x00w6 " * 5000)]
    return docs, ["w1 w2 w3", None, "été w77 w5", ""]


@pytest.mark.parametrize("rule", [R.Rule(), R.Rule(width=2, buckets=97, least_words=3, share=1, out_of=3), R.Rule(least_words=0, share=100)])
def test_draw_equals_formulas(spark, rule):
    docs, target = corpus()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, pos int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in R.resample(frame, goal, rule).collect())
    assert got == expected(docs, target, rule)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [tuple(r) for r in R.resample(one, none, R.Rule(share=100)).collect()][0][4] == 1


def test_query_equals_sql(spark, folder):
    got = queries.QUERIES["op12_importance_resampling"](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.SQL["op12_importance_resampling"])
    names = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("case", ["spread", "equal", "wide", "hot"])
def test_radix_ranks(spark, case, monkeypatch):
    monkeypatch.setattr(radix, "DIGIT", 5)
    rng = random.Random(case)
    pick = {
        "spread": lambda: (rng.randrange(-50, 50), rng.randrange(1 << 30)),
        "equal": lambda: (7, 7),
        "wide": lambda: (rng.choice([-(1 << 63), (1 << 63) - 1, 0]), rng.randrange(-(1 << 62), 1 << 62)),
        "hot": lambda: (rng.choice([1, 1, 1, rng.randrange(1000)]), 0),
    }[case]
    rows = [(i, *pick()) for i in range(700)]
    got = radix.ranked(spark.createDataFrame(rows, "i long, a long, b long"), ["a", "b"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 701))
    assert [(r["a"], r["b"]) for r in got] == sorted((a, b) for _, a, b in rows)


def test_ranks_move_no_whole_table(spark):
    """A block's rows never exceed their share, though all keys are one."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("a"), "id")
    placed = radix.ranked(rows, ["a"])
    assert placed.select(F.max("rank")).first()[0] == 4000
