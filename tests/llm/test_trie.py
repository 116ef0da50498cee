"""The trie against a plain one, and against its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import prefix_trie as P
from tidemark.llm import queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows, every, most):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, said, len(text)), (role, text)))
    turns = {c: [x for _, x in sorted(t, key=lambda p: p[0])] for c, t in turns.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        giver = c - (c % every if c >= 0 else -(-c % every))
        built[c] = turns.get(giver, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in members.items())


def tables(kind):
    rng = random.Random(kind)
    say = lambda n=3: (rng.choice(["user", "bot", None]), rng.choice(["", None, "é😀", *(f"t{i}" for i in range(n))]))
    if kind == "empty":
        return []
    if kind == "no ids":
        return [(None, 1, "a", "b")] * 3
    if kind == "turnless":  # no giver, and fewer turns than are taken
        return [(c, 0, "a", "b") for c in (101, 102, 103, 104, 105, 150)]
    if kind == "one long":
        return [(7, i, *say()) for i in range(300)] + [(100, i, "a", "b") for i in range(2)] + [(c, i, "a", "b") for c in range(101, 140) for i in range(17)]
    rows = []
    for c in [*rng.sample(range(-250, 900), 120), 0, 100, 200, 1 << 40]:
        rows += [(c, rng.choice([i, i, i, None, 2]), *say()) for i in range(rng.choice([1, 2, 3, 5, 8, 9, 20]))]
    rows += rows[:30] + [(None, 0, "x", "y"), (3, None, None, None)]
    if kind == "hot":
        rows += [(1000 + c, i, "user", "same") for c in range(150) for i in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["empty", "no ids", "turnless", "one long", "mixed", "hot"])
def test_trie_equals_plain_one(spark, kind, monkeypatch):
    monkeypatch.setattr(P, "PART", 3)
    rows = tables(kind)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    got = Counter(tuple(r) for r in P.prefix_trie(frame).select(*COLUMNS).collect())
    assert got == expected(rows, 100, 6)


def test_query_equals_sql(spark, folder):
    got = queries.QUERIES["op11_halved_prefix_trie"](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(queries.SQL["op11_halved_prefix_trie"])
    assert [c[0] for c in want.description] == COLUMNS
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == Counter(want.fetchall())
