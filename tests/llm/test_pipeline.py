"""The pipeline's stages in order, what each one keeps, and odd tables."""

import itertools
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.test_near import reach, shingles
from tidemark.llm import memory, work


@pytest.fixture(scope="module")
def small(spark, folder, tmp_path_factory):
    """documents with null, empty, repeated and clashing rows and columns, next to the given labels."""
    to = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS predicted", "doc_id AS _0", "1.5D AS score")
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "123 456", None), (None, "the and of with no id at all", "en"), (9004, "the and of in", "en"), (9004, "the and of in", "en")]
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    docs.unionByName(extra, allowMissingColumns=True).coalesce(2).write.parquet(f"{to}/documents.parquet")
    for name in ("labels", "embeddings"):
        os.symlink(f"{folder}/{name}.parquet", f"{to}/{name}.parquet")
    return to


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = work.written(stage(spark, docs, small))
        seen[name] = (before, docs.collect())
        assert docs.columns == columns or name == "packing"
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]

    before, after = seen["toxicity"]
    assert len(after) < len(before) and {r.doc_id for r in after} >= {9001, 9002, 9003, 9004}
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(toxic & gone) > 0.6 * len(toxic & {r.doc_id for r in before})

    before, after = seen["language"]
    left = sorted((r.doc_id for r in before if r not in after), key=str)
    assert left == [9001, 9002, 9003]

    before, after = seen["near_duplicates"]
    sets = {i: shingles(r.text, 5) for i, r in enumerate(before)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    label = reach(sets, links)
    best = {}
    for i, r in enumerate(before):
        best.setdefault(label[i], []).append((r.doc_id is None, r.doc_id or 0))
    want = sorted(min(x) for x in best.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == want

    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)


def test_run_equals_stages(spark, folder):
    got = cp.run(spark, folder).count()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = work.written(stage(spark, docs, folder))
    assert docs.count() == got


def test_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_queries_cover_their_tables(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    table, key = ("embeddings", "vec_id") if name.startswith("op2_") else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(key).collect()]
    found = [r[0] for r in got.select(key).collect()]
    assert sorted(set(found)) == sorted(ids) and (len(found) == len(ids) or name.startswith("op1_"))


def test_near_duplicates_when_files_are_packed_anew(spark, tmp_path, monkeypatch):
    """Rows keep their numbers if later jobs cut the files into other tasks, as with a lost or new executor."""
    work.ship(spark)
    rows = [(i, " ".join(f"w{i % 60}x{k}" for k in range(20))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packing, near_copies = "spark.sql.files.minPartitionNum", cp.shingle_join.near_copies

    def then_packed_anew(*args):
        found = work.written(near_copies(*args))
        spark.conf.set(packing, 1)
        return found

    monkeypatch.setattr(cp.shingle_join, "near_copies", then_packed_anew)
    spark.conf.set(packing, 4)
    try:
        got = cp.stage_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    finally:
        spark.conf.unset(packing)
    assert sorted(r.doc_id for r in got) == list(range(60))


def test_texts_that_go_are_not_shuffled(spark, monkeypatch):
    """Of the texts that may have to go, only those that may stay all the same reach the last join."""
    rows = [(i, " ".join(f"w{i % 60}x{k}" for k in range(20))) for i in range(80)]
    held, kept = cp.id_filter.held, []

    def spy(*args, **more):
        kept.append(held(*args, **more))
        return kept[-1]

    monkeypatch.setattr(cp.id_filter, "held", spy)
    got = cp.stage_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    assert [x for x in kept if "text" in x.columns][-1].count() < 20


def test_language_stage_without_languages(spark):
    """A table whose lang is null throughout, and one without rows, lose nothing."""
    docs = spark.createDataFrame([(1, "some words here", None), (2, None, None), (None, "", None)], "doc_id long, text string, lang string")
    assert sorted(map(str, cp.stage_language(spark, docs, "").collect())) == sorted(map(str, docs.collect()))
    assert cp.stage_language(spark, docs.limit(0), "").count() == 0


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """No step in Python feeds another one within a task: each would hold a worker of its own, with its memory."""
    marked, read = cp.id_filter.marked, []

    def spy(ids):
        read.append(ids)
        return marked(ids)

    monkeypatch.setattr(cp.id_filter, "marked", spy)
    rows = [(i, " ".join(f"w{i % 60}x{k}" for k in range(20))) for i in range(80)]
    got = cp.stage_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert steps(got) == 2  # the two sides of the union
    assert [steps(x) for x in read[-2:]] == [0, 0]


def test_workers_give_back_memory():
    """A worker that has done a task doesn't keep what the task has freed, nor what tasks of another kind remember."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6

    def run(batches):
        junk = [b"%05d" % i * 800 for i in range(60_000)]
        pins.extend(junk[::2000])  # so that the C library can't give back the end of its memory by itself
        yield from batches

    pins, before = [], resident()
    memory.remembered["some"] = {"word": b"ids"}
    assert list(memory.tidy(run, remembers=True)(iter([1, 2]))) == [1, 2] and memory.remembered
    assert resident() - before < 80  # of 240 MB
    assert list(memory.tidy(iter)(iter([3]))) == [3] and not memory.remembered
