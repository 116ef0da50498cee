"""Joins and components against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import embedding_dedup as E
from tidemark.llm import shingle_join as S
from tidemark.llm import spans, work
from tidemark.llm.components import components


def reach(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    w = [x for x in re.split("[\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def families(seed, n=40):
    """Texts in chains of small changes, so that links lie on both sides of the threshold."""
    rng, out = random.Random(seed), [None, "", " \n", "One", "one", "ONE  two", "one two three four five"]
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 9, 15, 30, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 4, 8])):
            out.append(" ".join(words))
            for _ in range(max(1, len(words) // rng.choice([30, 60, 120]))):
                at = rng.randrange(len(words))
                words = words[:at] + [f"w{rng.randrange(400)}"] * rng.choice([0, 1, 1, 2]) + words[at + 1 :] or ["w"]
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 18, 80]))) for _ in range(25)]
    return out + out[-3:]


@pytest.mark.parametrize("seed,width,tile", [(1, 5, S.TILE), (2, 3, S.TILE), (1, 5, 2)])
def test_shingle_join(spark, monkeypatch, seed, width, tile):
    """Equal to all pairs by brute force, also where nearly every group is cut into tiles."""
    work.ship(spark)
    monkeypatch.setattr(S, "TILE", tile)
    texts = dict(enumerate(families(seed)))
    sets = {i: shingles(t, width) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    label = reach(texts, links)
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in texts.items()], "doc_id long, text string, class int, size string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_copies(docs, S.Rule(width)).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in texts}


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    rule = S.Rule()
    for size in [*range(4, 40), 77, 150, 400, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            cut = rng.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), cut, replace=False)), rng.integers(0, 2**64, rng.integers(0, size // 5 + 1), np.uint64)]))
            if not S.linked(a, b, rule) or a.tolist() == b.tolist():
                continue
            both = S.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.zeros(2, np.uint64))
            sig, owner = S.signatures(both, np.array([0, 1]), rule)
            assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size
            x, y = S.folded([S.sketch(a), S.sketch(b)])
            assert S.may_link(x, y, np.array(len(a) + len(b)), rule)


def test_no_rows_and_rows_without_ids(spark):
    work.ship(spark)
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "A B c d e f"), (3, "z")], "doc_id long, text string")
    got = sorted(map(tuple, S.near_copies(docs).collect()), key=str)
    assert got == [(3, 1, 3), (3, 2, 3), (None, 2, 3), (None, 2, 3)]
    assert S.near_copies(docs.limit(0)).count() == 0


def test_words_of_a_chunk():
    import pyarrow as pa

    (c,) = spans.chunks(pa.array(["a bb", None, "\tbb\n", "a"]))
    start, end, doc = spans.words(c.data, c.off)
    assert [bytes(c.data[a:b]) for a, b in zip(start, end)] == [b"a", b"bb", b"bb", b"a"] and doc.tolist() == [0, 0, 2, 3]
    h = spans.span_hash(c.data, start, end)
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert (spans.span_hash(c.data, start, end, block=1) == h).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500), (1, 0), (0, 1)]
    links_apart = [p for p in links if p[0] != p[1]]
    want = reach({x for p in links_apart for x in p}, links_apart)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest(spark):
    work.ship(spark)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 16))
    rows = np.concatenate([base, base[:40] + 0.1 * rng.standard_normal((40, 16)), base[:20] * 3, np.repeat(base[:1], 30, 0)]).astype(np.float32)
    extra = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [], [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    vectors = [*[[float(y) for y in x] for x in rows], *extra]
    data = [(i, v, i % 3, 0) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, dim int")).collect()}
    fine = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {i: np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in fine}
    links = [(a, b) for a, b in combinations(fine, 2) if len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9]
    label = reach(range(len(vectors)), links)
    want_links = {i: sum(i in p for p in links) for i in range(len(vectors))}
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= want_links[i] for i in got) and found >= 0.9 * 2 * len(links)
    assert sum(got[i].component_id != label[i] for i in got) <= 0.1 * len(got)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(len(vectors)) if want_links[i] == 0)
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_forest_leaves_and_tiles(spark, monkeypatch):
    """Small leaves and tiles: recall stays, and every pair of a large group is found."""
    work.ship(spark)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 24))
    rows = np.concatenate([base, base[:300] + 0.15 * rng.standard_normal((300, 24))])
    near = rng.standard_normal(24) + 0.02 * rng.standard_normal((60, 24))
    rows = np.concatenate([rows, near])
    monkeypatch.setattr(E, "LEAF", 50)
    monkeypatch.setattr(E, "TILE", 32)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    u = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum()
    assert all(got[i] == want[i] for i in range(1800, 1860))


def test_forest_keeps_a_dense_group_whole():
    """A third of 50,000 vectors is one group of distinct near copies: its pairs meet, the others stay apart."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((50_000, 32))
    group = rng.permutation(50_000)[:16_667]
    x[group] = rng.standard_normal(32) + 0.2 * rng.standard_normal((len(group), 32))
    x = E.unit(x)
    a, b = rng.choice(group, (2, 20_000))
    a, b = (p[(x[a] * x[b]).sum(1) >= 0.9] for p in (a, b))
    assert len(a) > 10_000
    together, compared = np.zeros(len(a), bool), 0
    for seed in range(E.TREES):
        row, leaf = E.grow(x[: E.SAMPLE], 9, seed).leaves(x)
        for k in np.unique(leaf):
            held = np.zeros(len(x), bool)
            held[row[leaf == k]] = True
            together |= held[a] & held[b]
            compared += int(held.sum()) ** 2
    print(together.mean(), compared / E.TREES / len(group) ** 2)
    assert together.mean() > 0.995
    assert compared < 4 * E.TREES * len(group) ** 2


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_gathered_keeps_rows_in_fewer_tasks(spark, rows):
    dealt = spark.range(rows).repartition(400, "id")
    fewer = work.gathered(dealt)
    assert sorted(r.id for r in fewer.collect()) == list(range(rows))
    few = max(work.WAVES * spark.sparkContext.defaultParallelism, -(-work.slots(spark) // work.SHARED))
    assert fewer.rdd.getNumPartitions() <= few < 400


def test_signatures_travel_in_few_bytes_and_groups_do_not_depend_on_ranges(spark, monkeypatch):
    """A class's key is sent once for several ranges, and a signature's place costs nothing; any number of ranges gives the same groups."""
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(60)]
    texts += [[*t[:200], "x", *t[201:]] for t in texts[:20]]
    work.ship(spark)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    kind, dealt = type(docs), []
    group_by = kind.groupBy

    def spy(self, *keys):
        dealt.append(self)
        return group_by(self, *keys)

    monkeypatch.setattr(kind, "groupBy", spy)
    groups = {n: {(r.gid, r["class"]) for r in S.shared_signatures(docs, S.Rule(), n).collect()} for n in (1, 5, 16)}
    rows = next(d for d in reversed(dealt) if "high" in d.columns).collect()
    signatures = sum(len(r.high) // 4 for r in rows)
    size = sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray)))
    assert signatures > 80 * 100 and size < 6 * signatures
    assert groups[1] == groups[5] == groups[16] and len({c for _, c in groups[1]}) >= 40
