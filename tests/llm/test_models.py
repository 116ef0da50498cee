"""Statistics by brute force; models on small corpora with held-out rows, and on degenerate ones."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import language, quality_model, quality_rules, spans, toxicity, work
from tidemark.llm.stats import text_stats

WORDS = {"aa": "ka ke ki ko ku".split(), "bb": "zor zan zil zum".split(), "cc": "été çà là où".split()}
ODD = st.text(st.sampled_from(list("abB1# *!\n\té ")), max_size=40)
FAR = ["", None, " \n\t", "123 !!", "日本", "x" * 3000, "w " * 4000]


def brute(text):
    w = [x for x in re.split("[\x20\t-\r]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\t-\r]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct_words": len(set(w))}


@given(st.lists(st.one_of(st.none(), ODD), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_stats(texts):
    for c in spans.chunks(pa.array(texts, pa.string()), 30):
        s = text_stats(c)
        for i in range(len(c)):
            assert {k: int(s[k][i]) for k in s if k != "classes"} == brute(texts[c.first + i])
            assert s["classes"][i].sum() == len((texts[c.first + i] or "").encode())


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([1, 2, 3]))) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    work.ship(spark)
    rng, rows = random.Random(4), []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        text, toxic, quality = prose(rng, lang, rng.choice([8, 60, 150])), int(rng.random() < 0.2), 1
        if toxic:
            text += " " + " ".join(rng.choice(["vile", "vilex", "vilezor", "vileka"]) for _ in range(3))
        if rng.random() < 0.06:
            text, quality = " ".join(x.upper() + "###" for x in text.split()), 0
        rows.append((i, text, lang if i % 11 else None, toxic, quality, "s"))
    rows += [(1000 + i, t, None, None, None, "s") for i, t in enumerate(FAR)] + [(None, "no id", "aa", None, None, "s"), (5, "twice", "aa", None, None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int, score string").repartition(3)


def held(i, parts, nth):
    return zlib.crc32(str(i).encode()) % parts == nth


def test_language(spark, corpus):
    got = language.predict(corpus, language.learn(corpus.where("doc_id % 3 = 0")), keep=("doc_id", "lang", "score")).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.lang and r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 and r.doc_id != 5]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.98 * len(known)
    far = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 1000}
    assert [far[1000 + i].lang_pred == "und" for i in range(7)] == [True, True, True, True, False, False, False]
    assert all(far[1000 + i].score == 0 for i in range(4))
    none = language.predict(corpus, language.learn(corpus.limit(0))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)
    assert language.predict(corpus.limit(0), language.learn(corpus)).count() == 0


def test_language_filter_answers_for_all(spark, corpus):
    filters = language.learn(corpus)
    (c,) = spans.chunks(pa.array(["kakeki zorzan"]))
    h, run, which, doc = language.grams(c)
    bits = filters.bits(filters.lookup(h))
    # both languages' n-grams are told apart in one lookup
    assert bits[run == which[0], 0].mean() > 0.9 and bits[run == which[1], 1].mean() > 0.9
    assert (filters.chance() < 0.01).all()


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return ((s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2).item()


def test_toxicity(spark, corpus):
    labels = corpus.where("doc_id < 600 AND doc_id <> 5").select("doc_id", "toxic", "text").union(spark.createDataFrame([(7, None, ""), (None, 1, "")], "doc_id long, toxic int, text string"))
    rows = toxicity.labelled_texts(corpus.where("doc_id % 4 <> 2"), labels, "toxic")
    assert rows.where("doc_id % 4 = 2").count() == 0
    model = toxicity.learn(rows.where("doc_id % 4 <> 3"), rows.where("doc_id % 4 = 3"))
    got = toxicity.score(corpus, model, keep=("doc_id", "toxic", "score")).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.toxic is not None and r.doc_id % 4 == 2]
    assert auc([r.toxic for r in test], [r.score for r in test]) > 0.98
    bare = toxicity.learn(rows.limit(0), rows.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(corpus, bare).collect())
    assert toxicity.score(corpus.limit(0), model).count() == 0


def test_kneser_ney_by_hand(spark):
    """Every ratio of a tiny corpus equals the formula evaluated directly."""
    work.ship(spark)
    rows = [("abab ba", 1), ("abc ab", 0), ("ca ab", 0), ("abc abc", 1)]
    model = toxicity.learn_counts(spark.createDataFrame(rows, "text string, label int"))
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    counts = {0: Counter(), 1: Counter()}
    for text, label in rows:
        for w in text.split():
            run = " " + w + " "
            for i in range(1, len(run)):
                counts[label][("\0" * n + run)[i + 1 : i + 1 + n]] += 1
    types = [set(counts[0]) | set(counts[1])]
    for _ in range(n - 1):
        types.append({t[1:] for t in types[-1]})

    def shared(s):
        m = len(s)
        if m == 0:
            return 1 / 256
        left = Counter(t[1:] for t in types[n - m - 1])
        same = [t for t in left if t[:-1] == s[:-1]]
        total = sum(left[t] for t in same)
        low = 1 / 256 if m == 1 else shared(s[1:])
        return (left[s] - d + d * len(same) * low) / total

    def p(label, key):
        same = [t for t in counts[label] if t[:-1] == key[:-1]]
        total = sum(counts[label][t] for t in same)
        base = shared(key[1:])
        return base if not total else max(counts[label][key] - d, 0) / total + d * len(same) / total * base

    for key in types[0]:
        packed = int.from_bytes(key.encode(), "big")
        assert model.of(np.array([packed], np.int64))[0] == pytest.approx(np.log(p(1, key) / p(0, key)), rel=1e-4, abs=1e-5)


def test_quality_rules(spark, corpus):
    got = quality_rules.judge(corpus, quality_rules.learn(corpus), keep=("doc_id", "quality", "kept", "text")).collect()
    assert len(got) == corpus.count()
    for r in got:
        want = brute(r.text)
        assert all(r[k] == want[k] for k in quality_rules.BASE)
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.kept and r.base_failed)
    long = [r for r in got if not r.base_failed and r.quality is not None and r.doc_id != 5]
    assert sum(r.kept == (r.quality == 1) for r in long) >= 0.95 * len(long), [(r.quality, r.kept, r.n_words, r.class_distance, r.word_distance) for r in long if r.kept != (r.quality == 1)][:8]
    bare = quality_rules.judge(corpus, quality_rules.learn(corpus.limit(0))).collect()
    assert all(r.kept == (not r.base_failed) and r.class_distance is None for r in bare)
    assert quality_rules.judge(corpus.limit(0), quality_rules.learn(corpus)).count() == 0


def test_jensen_shannon():
    p, q = np.array([[0.5, 0.5, 0], [1, 0, 0], [0, 0, 0]]), np.array([0, 0, 1.0])
    assert quality_rules.js_distance(p[0], p[0]) == 0
    assert quality_rules.js_distance(p[1], q) == pytest.approx(1)
    m = (p[0] + p[1]) / 2
    want = np.sqrt((0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1]) + np.log2(1 / m[0])) / 2)
    assert quality_rules.js_distance(p[0], p[1]) == pytest.approx(want)


def test_quality_model(spark, corpus):
    labels = corpus.where("doc_id < 600 AND doc_id <> 5").select("doc_id", "quality")
    forest = quality_model.learn(corpus.where("doc_id % 5 <> 0"), labels, "quality")
    got = quality_model.score(corpus, forest, keep=("doc_id", "quality", "score")).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.quality is not None and r.doc_id % 5 == 0 and r.doc_id != 5]
    assert auc([r.quality for r in test], [r.score for r in test]) > 0.99
    bare = quality_model.learn(corpus, labels.limit(0), "quality")
    assert {round(r.score, 9) for r in quality_model.score(corpus, bare).collect()} == {0.5}
    assert quality_model.score(corpus.limit(0), forest).count() == 0


def test_forest_walk_equals_one_row_at_a_time():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((800, 5)), None
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = quality_model.fit(x, y, trees=60)
    walked = []
    for row in x:
        total = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(forest.score(x), walked)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_every_counted_expression_is_kept(spark):
    """Expressions that one class has seen once count for that class, however many there are."""
    work.ship(spark)
    letters = np.random.default_rng(12).integers(97, 123, (60_000, 7)).astype(np.uint8)
    words = [bytes(x).decode() for x in letters]
    rows = [(" ".join(words[i : i + 100]), 1) for i in range(0, len(words), 100)] + [("the and of with", 0)]
    labelled = spark.createDataFrame(rows, "text string, label int")
    key = toxicity.gram_counts(labelled).where("c0 = 0").toArrow()["key"].to_numpy()
    ctx, n = np.unique(key >> 8, return_counts=True)
    alone = key[np.isin(key >> 8, ctx[n == 1])]
    assert len(alone) > 100_000
    assert (toxicity.learn_counts(labelled).of(alone) > 0).all()
