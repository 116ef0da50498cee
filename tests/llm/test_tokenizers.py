"""Packing, token counts, byte-level BPE and id files against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, id_files, packing, spans, token_counts, tokens, work

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n", "a", "It's THE 'S I'LL don't", "  lead  and   trail  ", "x <|endoftext|> y<|endoftext|>Z <|startoftext|>q",
         "é ́x ΑΣ ΑΣ. İ K", "\x1c a\x1d b\u0085 c 　　 d", "日本語のテキスト、改行\nなし", "🙂 👩‍👩‍👧 ok", "word " * 3000, "a" * 5000, "x" * 700 + " " + "x" * 700,
         "tab\tand nbsp   em", "1234567890 12,345.67", "a\r\nb\rc"]
ODD = st.text(st.sampled_from(list("aAbé'st rl\n\t  .,!1²日́<|>endoftext ")), max_size=60)


@pytest.fixture(scope="module")
def docs(spark):
    # a clashing and an extra column, a repeated row, a null id
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(4, "a", 7, "x"), (None, "no id", None, None)]
    work.ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, block string").repartition(3)


def library(path, text):
    return tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.one_of(st.none(), ODD), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for path in (WORD, BYTE):
        for rows, ids, begin in tokens.encoded(iter([batch]), path, "text"):
            for i, t in enumerate(rows.column("text").to_pylist()):
                assert ids[begin[i] : begin[i + 1]].tolist() == library(path, t)


@given(ODD, st.integers(2, 9))
@settings(max_examples=300, deadline=None)
def test_tree_equals_whole(text, leaf):
    made = byte_bpe.codec(RANKS, P.PATTERN, leaf)
    ids = made.encode(text)
    assert ids == made.encode_leaf(text)
    assert made.decode(ids) == text.encode()


def test_round_trip(spark, docs):
    whole = byte_bpe.codec(RANKS, P.PATTERN).encode_leaf
    want = sorted(((i, len(x := whole(t or "")), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs.select("doc_id", "text").collect()), key=str)
    got = byte_bpe.round_trip(docs, RANKS, P.PATTERN, leaf=16)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert byte_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((r.doc_id is None, r.doc_id, bytes(r.bytes)) for r in back.collect()) == sorted((r.doc_id is None, r.doc_id, (r.text or "").encode()) for r in docs.collect())


def test_counts(spark, docs):
    want = sorted(((i, len((t or "").encode()), n := len(library(WORD, t)), n > 100) for i, t in docs.select("doc_id", "text").collect()), key=str)
    got = token_counts.token_counts(docs, WORD, limit=100)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert token_counts.token_counts(docs.limit(0), WORD).count() == 0


def test_count_of_a_word_in_every_text(spark):
    work.ship(spark)
    many = spark.range(500).selectExpr("id AS doc_id", "concat('the the ', cast(id as string)) AS text").repartition(2)
    for r in token_counts.token_counts(many, WORD).collect():
        assert r.n_tokens == len(library(WORD, f"the the {r.doc_id}"))


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, docs, capacity):
    ids = {}
    for i, t in docs.select("doc_id", "text").collect():
        ids[i] = np.array(library(WORD, t) + [1], "<u4")
    got = packing.pack(docs, WORD, capacity, 1, with_ids=True).collect()
    covered, sequences = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and bytes(r.ids) == part.tobytes()
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(covered[i] == len(x) * (2 if i == 4 else 1) for i, x in ids.items())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs.limit(0), WORD).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_window_is_filled_best(counts, target):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= target}
    used = packing.fill_window(counts, sorted(counts, reverse=True), target)
    assert sum(k * n for k, n in used.items()) == max(sums)
    assert all(n <= counts[k] for k, n in used.items())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_piece_once(counts):
    total = {}
    for used, times in packing.slack_plan(dict(counts), 64):
        assert times > 0 and sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            total[k] = total.get(k, 0) + n * times
    assert total == counts


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
@settings(max_examples=150, deadline=None)
def test_variable_length_code(lists):
    n = np.array([len(x) for x in lists], np.int64)
    begin = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    ranks = np.array([x for y in lists for x in y], np.uint32)
    control, control_at, data, data_at = id_files.code(ranks, begin)
    assert control_at[-1] == len(control) and data_at[-1] == len(data)
    assert id_files.decode(control, data, n).tolist() == ranks.tolist()


def test_id_files(spark, docs):
    path = work.folder(spark)
    id_files.write_ids(docs, path, BYTE, 0)
    rows = sorted(((i is not None, i, library(BYTE, t) + [0]) for i, t in docs.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or 0, len(r[2])))
    want, at = [], 0
    for _, i, ids in rows:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = {(r.start, r.doc_id): (r.n_tokens, r.ids_crc32) for r in id_files.read_ids(spark, path, digest=True).collect()}
    assert got == {(s, i): (n, c) for i, s, n, c, _ in want}
    assert {(r.start, tuple(r.ids)) for r in id_files.read_ids(spark, path).collect()} == {(s, tuple(x)) for _, s, _, _, x in want}
    ranked = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranked] == sorted((r.n for r in ranked), reverse=True)
    empty = work.folder(spark)
    id_files.write_ids(docs.limit(0), empty, BYTE, 0)
    assert id_files.read_ids(spark, empty, digest=True).count() == 0


def test_id_files_are_ranges_that_meet_their_starts_without_a_shuffle(spark, capsys):
    """Files follow each other by doc_id, nulls first, a repeated one in one file; reading shuffles no ids."""
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else i * 2**40 - 2**47, f"text {i}") for i in range(300)]
    path = work.folder(spark)
    id_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, BYTE, 0)
    found = spark.read.parquet(f"{path}/ids").groupBy("file").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n"), F.count("*").alias("all")).orderBy("file").collect()
    assert len(found) > 1 and all(a.hi < b.lo for a, b in zip(found, found[1:]))
    assert found[0].all - found[0].n == 6 and all(r.all == r.n for r in found[1:])
    got = id_files.read_ids(spark, path)
    assert [r.start for r in got.orderBy("start").collect()][:7] == [sum(r.n_tokens for r in got.orderBy("start").collect()[:k]) for k in range(7)]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, -1)
    try:
        got = id_files.read_ids(spark, path)
        got.explain()
    finally:
        spark.conf.unset(threshold)
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_long_texts_make_chunks_of_their_own():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    parts = list(spans.chunks(column, 20))
    assert [(c.first, len(c)) for c in parts] == [(0, 2), (2, 1), (3, 2)]
    assert [bytes(c.data) for c in parts] == [b"a" * 10, b"b" * 100, b"c"]
