"""Small frames with the edge cases that decide semantics."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions.numeric import inverse_normal, two_sided_p
from tidemark.functions.timegrid import DEFAULT_GRID, Grid
from tidemark.operators import mapping as m
from tidemark.operators import normalize as nz
from tidemark.operators import sampling as sm
from tidemark.operators import trajectory as tr
from tidemark.operators.normalize import count_below, position
from tidemark.operators.quantiles import group_quantiles, quantile_table
from tidemark.operators.sliced import Scan, neighbour, sliced_scan, time_slice

T0 = dt.datetime(2024, 1, 1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def events(spark, rows):
    data = [(p, minutes(x), f, float(v) if v is not None else None, i) for i, (p, x, f, v) in enumerate(rows)]
    return spark.createDataFrame(data, "pid long, ts timestamp_ntz, feature string, value double, event_id long")


def base(spark, rows):
    return spark.createDataFrame([(p, minutes(a), minutes(b)) for p, a, b in rows], "pid long, start_ts timestamp_ntz, end_ts timestamp_ntz")


def test_grid_definition():
    assert DEFAULT_GRID.total_steps == 116
    assert DEFAULT_GRID.max_days == 30
    assert [c.lo for c in DEFAULT_GRID.cells][-1] == 79 * 1440  # 7-day cells end at day 86
    assert DEFAULT_GRID.tail.lo == 86 * 1440
    assert all(ok for *_, ok in DEFAULT_GRID.alignment())
    assert not Grid(intervals={"25min": "10min"}, widths=None).alignment()[0][4]


def test_point_cells_are_half_open(spark):
    offsets = [-1, 0, 9.999, 10, 359, 360, 719, 720, 1440, 4320, 20160, 43199, 43200]
    ev = events(spark, [(1, x, "a", 1) for x in offsets])
    got = {r.event_id: r.step for r in m.point_to_step(ev, base(spark, [(1, 0, 100)])).collect()}
    want = {}
    for i, x in enumerate(offsets):
        for cell in DEFAULT_GRID.steps:
            if cell.lo <= x < cell.hi:
                want[i] = cell.step
    assert got == want


def test_random_points_and_intervals_match_range_join(spark):
    rnd = random.Random(3)
    ev = events(spark, [(rnd.randint(1, 5), rnd.choice([rnd.randint(0, 45000), rnd.uniform(-50, 2000)]), "a", 1) for _ in range(400)])
    b = base(spark, [(p, p * 7, 100) for p in range(1, 6)])
    cells = DEFAULT_GRID.cells_frame(spark)
    lo, hi = F.col("start_ts") + F.make_dt_interval(mins=F.col("off_start")), F.col("start_ts") + F.make_dt_interval(mins=F.col("off_end"))
    rj = ev.join(b.drop("end_ts"), "pid").crossJoin(cells).filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    assert sorted(map(tuple, rj.select("event_id", "step").collect())) == sorted(
        map(tuple, m.point_to_step(ev, b).select("event_id", "step").collect())
    )
    iv = ev.withColumn("end_ts", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 700).cast("int")))
    rj = iv.join(b.drop("end_ts"), "pid").crossJoin(cells).filter((F.col("ts") < hi) & (F.col("end_ts") > lo))
    assert sorted(map(tuple, rj.select("event_id", "step").collect())) == sorted(
        map(tuple, m.interval_to_steps(iv, b).select("event_id", "step").collect())
    )


def test_time_to_step_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (10.1,), (360.0,), (361.0,), (43200.0,), (43201.0,)], "x double")
    got = [r[0] for r in df.select(DEFAULT_GRID.time_to_step(F.col("x"))).collect()]
    assert got == [0, 0, 0, 1, 35, 36, 115, None]
    steps = spark.createDataFrame([(0,), (35,), (36,), (115,), (116,), (117,)], "s int")
    assert [r[0] for r in steps.select(DEFAULT_GRID.step_to_time(F.col("s"))).collect()] == [10, 360, 380, 43200, 43200, None]


def test_cell_aggregates_skip_nulls_and_break_ties(spark):
    ev = events(spark, [(1, 1, "a", None), (1, 1, "a", 3), (1, 1, "a", 5), (1, 2, "a", None), (1, 50, "a", 7)])
    cells = m.map_concept(ev, base(spark, [(1, 0, 100)]), list(m.CONTINUOUS))
    rows = {r.step: r.asDict() for r in cells.collect()}
    assert (rows[0]["first"], rows[0]["last"], rows[0]["count"]) == (3.0, 5.0, 2)
    assert rows[5]["std"] is None and rows[5]["mean"] == 7.0


def test_mode_takes_smallest_of_ties(spark):
    rows = [(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, "c")]
    df = spark.createDataFrame([(p, minutes(x), "f", v, x) for p, x, v in rows], "pid long, ts timestamp_ntz, feature string, value string, event_id long")
    mapped = m.point_to_step(df, base(spark, [(1, 0, 100)]))
    got = [m.single_label_cells(mapped, how).first()["value"] for how in ("mode", "first", "last")]
    assert got == ["a", "b", "c"]


def test_sliced_scans_equal_plain_windows(spark):
    rnd = random.Random(5)
    # one entity holds most rows, many rows share a time
    rows = [(1 if rnd.random() < 0.7 else rnd.randint(2, 6), rnd.randint(0, 9000), "a", rnd.choice([None, rnd.randint(0, 9)])) for _ in range(600)]
    ev = events(spark, rows)
    w = Window.partitionBy("pid").orderBy("ts", "event_id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("pid").orderBy(F.desc("ts"), F.desc("event_id"))
    want = ev.select(
        "event_id",
        F.sum(F.coalesce("value", F.lit(0.0))).over(up).alias("s"),
        F.last("value", ignorenulls=True).over(up).alias("l"),
        F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.min("value").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
        F.lag("value").over(w).alias("p"),
        F.lead("ts").over(w).alias("q"),
    )
    v = F.col("value")
    scans = [Scan("s", "sum", F.coalesce("value", F.lit(0.0))), Scan("l", "last", v), Scan("m", "max", v, inclusive=False), Scan("n", "min", v, reverse=True)]
    got = sliced_scan(ev, ["pid"], ["ts", "event_id"], [time_slice(F.col("ts"), "1 hour")], scans)
    got = neighbour(got, ["pid"], ["ts", "event_id"], {"p": "value"}, width="1 hour")
    got = neighbour(got, ["pid"], ["ts", "event_id"], {"q": "ts"}, ahead=True, width="1 hour")
    key = lambda r: r.event_id
    assert sorted(got.select(*want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_islands_follow_previous_end(spark):
    rows = [(1, 0, 60), (1, 120, 130), (1, 125, 126), (1, 190, 200), (1, 189 + 71, 300), (2, 0, None), (2, 500, 510)]
    df = spark.createDataFrame(
        [(p, minutes(a), minutes(b) if b else None, i) for i, (p, a, b) in enumerate(rows)], "pid long, start_ts timestamp_ntz, end_ts timestamp_ntz, event_id long"
    )
    got = {r.event_id: r.island for r in tr.mark_islands(df, 1).collect()}
    # a gap of exactly one hour opens an island, a missing end keeps it open
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0}
    nested = tr.mark_islands(df, 1, running_max=True)
    assert {r.event_id: r.island for r in nested.collect()}[3] == 2


def test_quantiles_match_numpy(spark):
    rnd = random.Random(1)
    data = {k: [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e6), 3.0, -7.5]) for _ in range(n)] for k, n in (("a", 501), ("b", 2), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    probs = {"lo": 0.01, "q": 0.25, "m": 0.5, "hi": 0.99}
    for r in group_quantiles(df, ["k"], "v", probs).collect():
        assert np.allclose([r[n] for n in probs], np.quantile(data[r.k], list(probs.values())))
    rows = quantile_table(df, ["k"], "v", 101).collect()
    for k, vs in data.items():
        q = [r.q for r in sorted(rows, key=lambda r: r.i) if r.k == k]
        n = min(101, len(vs))
        assert np.allclose(q, np.quantile(vs, np.linspace(0, 1, n)) if n > 1 else [vs[0]])


def test_no_quantile_is_null(spark):
    """Totals whose floating step misses the last rank (29,936 and 51 is one), and many others."""
    rnd = random.Random(5)
    sizes = [1, 2, 3, 50, 51, 52, 29_936 // 16, *(rnd.randrange(2, 4000) for _ in range(25))]
    data = {f"k{j}": [float(rnd.randrange(rnd.choice([3, 60, 10**6]))) for _ in range(m)] for j, m in enumerate(sizes)}
    data["big"] = [float(i % 977) for i in range(29_936)]
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").cache()
    for n in (2, 7, 51, 1000):
        got = {}
        for r in quantile_table(df, ["k"], "v", n).collect():
            got.setdefault(r.k, {})[r.i] = r.q
        for k, vs in data.items():
            m = min(n, len(vs))
            assert sorted(got[k]) == list(range(m)) and None not in got[k].values()
            want = np.quantile(vs, np.linspace(0, 1, m)) if m > 1 else [min(vs)]
            assert np.allclose([got[k][i] for i in range(m)], want, rtol=1e-9, atol=1e-9)
    df.unpersist()


def test_search_in_quantiles(spark):
    rnd = random.Random(6)
    cases = []
    for _ in range(300):
        q = sorted(rnd.choice([rnd.random(), 0.25, 0.5]) for _ in range(rnd.choice([0, 1, 2, 3, 8, 100])))
        cases.append((q, rnd.choice([0.25, 0.5, -1.0, 2.0, rnd.random()])))
    df = spark.createDataFrame(cases, "q array<double>, v double")
    v, q = F.col("v"), F.col("q")
    for r in df.select("q", "v", count_below(v, q).alias("a"), count_below(v, q, True).alias("b"), position(v, q).alias("p")).collect():
        assert (r.a, r.b) == (np.searchsorted(r.q, r.v, "left"), np.searchsorted(r.q, r.v, "right"))
        assert (r.p is None) == (not r.q)
    broken = spark.createDataFrame([([0.0, 1.0, None], 0.5)], "q array<double>, v double")
    assert broken.select(position(v, q)).first()[0] is None


def test_normal_functions(spark):
    df = spark.createDataFrame([(x,) for x in (1e-9, 0.01, 0.3, 0.5, 0.9, 0.99999)], "p double")
    got = [r[0] for r in df.select(inverse_normal(F.col("p"))).collect()]
    assert np.allclose(got, [-5.997807015, -2.326347874, -0.524400513, 0.0, 1.281551566, 4.264890794])
    z = spark.createDataFrame([(0.1,), (1.0,), (1.96,), (5.0,), (9.0,)], "z double")
    import math

    assert np.allclose([r[0] for r in z.select(two_sided_p(F.col("z"))).collect()], [math.erfc(x / 2**0.5) for x in (0.1, 1.0, 1.96, 5.0, 9.0)], rtol=1e-9)


def test_power_fit_finds_the_likelihood_maximum(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(0, 1, 400)) - 1

    def yj(v, lam):
        out = np.empty_like(v)
        pos = v >= 0
        out[pos] = np.log1p(v[pos]) if abs(lam) < 1e-12 else ((v[pos] + 1) ** lam - 1) / lam
        out[~pos] = -np.log1p(-v[~pos]) if abs(lam - 2) < 1e-12 else -((1 - v[~pos]) ** (2 - lam) - 1) / (2 - lam)
        return out

    def loglik(lam):
        return -len(x) / 2 * np.log(yj(x, lam).var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    best = max(np.linspace(-2, 2, 4001), key=loglik)
    df = spark.createDataFrame([("a", float(v)) for v in x], "feature string, value double")
    fit = nz.fit_power(df).first()
    assert abs(fit.lam - best) < 5e-3
    assert abs(fit.center - yj(x, fit.lam).mean()) < 1e-8 and abs(fit.scale - yj(x, fit.lam).std()) < 1e-8


def test_quantile_transform_puts_ties_in_the_middle(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 2.0, 9.0)], "feature string, value double")
    out = nz.apply_quantile(rows, nz.fit_quantile(rows), "uniform")
    assert sorted(r.value for r in out.collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]
    normal = nz.apply_quantile(rows, nz.fit_quantile(rows)).agg(F.max("value"), F.min("value")).first()
    assert normal[0] == pytest.approx(nz.NORMAL_LIMIT) and normal[1] == pytest.approx(-nz.NORMAL_LIMIT)


def test_tiny_and_constant_channels_normalise(spark):
    rows = spark.createDataFrame([("two", 5.0), ("two", 9.0), ("flat", 4.0), ("flat", 4.0), ("flat", 4.0)], "feature string, value double")
    fitted = {r.feature: (r.method, r.center, r.scale) for r in nz.fit(rows).collect()}
    assert fitted["two"] == ("standard", 0.0, 1.0)
    flat = spark.createDataFrame([("flat", 4.0, 1, 0), ("flat", None, 1, 1)], "feature string, value double, pid long, step int")
    assert [r.value for r in nz.transform(flat, nz.fit(rows, "standard")).collect()] == [0.0, 0.0]


def test_splits_partition_ids(spark):
    df = spark.range(997).select(F.col("id").alias("pid"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    out = sm.stratified_holdout(df, "label", "pid", 0.2, 7)
    assert out.count() == 997
    counts = {r.label: r.n for r in out.filter("holdout").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 179, 1: 20}
    folds = sm.stratified_folds(df, "label", "pid", 5, 7).groupBy("label", "fold").count().collect()
    assert len(folds) == 10 and max(r["count"] for r in folds if r.label == 1) - min(r["count"] for r in folds if r.label == 1) <= 1


def test_parsers(spark):
    rows = [("<0,5",), ("*4.2",), ("neg",), (None,), ("> 7",), ("120/70 (0)",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(c.lab_number(F.col("t"))).collect()]
    assert got == [0.5, 4.2, None, None, 7.0, None]
    assert df.select(c.strip_score(F.col("t"))).collect()[5][0] == "120/70"
    ts = spark.createDataFrame([("22FEB2018:13:40:02.2750",), ("2018-02-22 13:40:02",), ("x",)], "t string")
    got = [r[0] for r in ts.select(c.parse_timestamp(F.col("t"))).collect()]
    assert got == [dt.datetime(2018, 2, 22, 13, 40, 2, 275000), dt.datetime(2018, 2, 22, 13, 40, 2), None]


def test_end_of_life_mask_keeps_minimum(spark):
    df = base(spark, [(1, 0, 20), (2, 0, 600), (3, 0, 6000)])
    got = {r.pid: (r.end_ts - T0).total_seconds() / 60 for r in tr.mask_end_of_life(df, F.col("pid") < 9).collect()}
    assert got == {1: 30.0, 2: 570.0, 3: 5880.0}


def test_dense_numbers(spark):
    from tidemark.operators.features import category_codes, vocabulary
    from tidemark.operators.numbering import number_distinct

    rnd = random.Random(7)
    rows = [(rnd.choice(["x", "y", None, f"w{rnd.randrange(300)}"]), rnd.choice([1, 1, None, rnd.randrange(500)])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b int")
    got = [tuple(r) for r in number_distinct(df, ["a", "b"], "n").orderBy("n").collect()]
    low = lambda v: (v is not None, v if v is not None else 0)
    want = sorted(set(rows), key=lambda r: ((r[0] is not None, r[0] or ""), low(r[1])))
    assert got == [(*r, i + 1) for i, r in enumerate(want)]
    assert number_distinct(df.limit(0), ["a"], "n").count() == 0
    codes = category_codes(df.withColumn("id", F.monotonically_increasing_id()), ["a", "b"])
    words = {c: {v: i + 1 for i, v in enumerate(sorted({r[j] for r in rows} - {None}))} for j, c in enumerate("ab")}
    assert sorted((r.a, r.b) for r in codes.collect()) == sorted((words["a"].get(a, 0), words["b"].get(b, 0)) for a, b in rows)
    have = {(r.a, r.b): (r.idx, r.n_classes, r.offset) for r in vocabulary(df, "a", "b").filter("a IS NOT NULL").collect()}
    by = {}
    for a, b in sorted({r for r in rows if None not in r}):
        by.setdefault(a, []).append(b)
    assert {k: v[:2] for k, v in have.items()} == {(a, b): (i, len(bs)) for a, bs in by.items() for i, b in enumerate(bs)}
    assert len({v[0] + v[2] for v in have.values()}) == len(have)  # places in the joint dimension
