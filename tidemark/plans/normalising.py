"""Normalisation, distribution statistics, bins, splits and samples."""

from pyspark.sql import functions as F

from tidemark.functions.columns import clip
from tidemark.operators import features as ft
from tidemark.operators import mapping as m
from tidemark.operators import normalize as nz
from tidemark.operators import sampling as sm
from tidemark.plans.registry import query, rounded, with_


def cells_of(t):
    return m.map_concept(t.ev, t.base, ["mean"]).withColumnRenamed("mean", "value")


def measured_of(t):
    cells = cells_of(t)
    return nz.measured(cells, ft.trajectory_lengths(cells, exclude=("view",)))


MEAS = f"""{with_("ev", "base", "seg", "grid", "mapped")}, cl AS MATERIALIZED (SELECT pid, step, feature, avg(value) AS value FROM mapped GROUP BY 1, 2, 3),
    ln AS (SELECT pid, coalesce(max(step) FILTER (feature <> 'view' AND abs(value) > 1e-8) + 1, 0) AS traj_len FROM cl GROUP BY 1),
    ms AS (SELECT cl.* FROM cl JOIN ln USING (pid) WHERE step < traj_len)"""

MOMENTS = """mo AS (SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM ms GROUP BY 1),
    sh AS (SELECT feature, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, any_value(min) AS min, any_value(max) AS max,
      avg(pow((value - mean) / std, 3)) AS skewness, avg(pow((value - mean) / std, 4)) - 3 AS kurtosis,
      greatest(avg(CAST(value >= max - (max - min) * 0.05 AS INT)), avg(CAST(value <= min + (max - min) * 0.05 AS INT))) AS edge FROM ms JOIN mo USING (feature) GROUP BY 1)"""


@query("g1_measured", f"{MEAS} SELECT pid, step, feature, round(value, 6) AS value FROM ms")
def g1(t):
    return rounded(measured_of(t))


METHOD_SQL = """CASE WHEN abs(skewness) < 0.5 AND kurtosis < 3 THEN 'standard' WHEN abs(skewness) < 2 AND kurtosis < 7 THEN 'power'
      WHEN edge >= 0.4 THEN 'robust' ELSE 'quantile' END"""


def many_channels(t):
    """Channels of different shapes from the order lines."""
    line = t.lineitem.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("pid"),
        "l_quantity",
        "l_extendedprice",
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).alias("cubed"),
        F.when(F.col("l_quantity") < 45, 100.0).otherwise(F.col("l_quantity")).alias("ceiling"),
        F.pow(F.col("l_quantity") / 10, F.lit(8)).alias("heavy"),
        F.lit(3.0).alias("constant"),
    )
    return nz.unpivot(line, "pid", ["l_quantity", "l_extendedprice", "cubed", "ceiling", "heavy", "constant"])


CHANNELS = """w AS (SELECT l_quantity, l_extendedprice, l_quantity * l_quantity * l_quantity AS cubed, CASE WHEN l_quantity < 45 THEN 100.0 ELSE l_quantity END AS ceiling,
      pow(l_quantity / 10, 8) AS heavy, 3.0::DOUBLE AS constant FROM lineitem), ms AS MATERIALIZED (SELECT feature, value::DOUBLE AS value FROM (UNPIVOT w ON l_quantity, l_extendedprice, cubed, ceiling, heavy, constant INTO NAME feature VALUE value))"""


@query(
    "g2_adaptive_method",
    f"""WITH {CHANNELS}, mo AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM ms GROUP BY 1),
    sh AS (SELECT feature, avg(CASE WHEN std > 0 THEN pow((value - mean) / std, 3) END) AS skewness, avg(CASE WHEN std > 0 THEN pow((value - mean) / std, 4) END) - 3 AS kurtosis,
      CASE WHEN any_value(max) > any_value(min) THEN greatest(avg(CAST(value >= max - (max - min) * 0.05 AS INT)), avg(CAST(value <= min + (max - min) * 0.05 AS INT))) ELSE 0 END AS edge FROM ms JOIN mo USING (feature) GROUP BY 1)
    SELECT feature, {METHOD_SQL} AS method FROM sh""",
)
def g2(t):
    return nz.adaptive_methods(many_channels(t))


@query(
    "g3_standard",
    f"""{MEAS}, f AS (SELECT feature, avg(value) AS c, stddev_pop(value) AS s FROM ms GROUP BY 1)
    SELECT pid, step, feature, round((value - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM ms JOIN f USING (feature)""",
)
def g3(t):
    rows = measured_of(t)
    return rounded(nz.apply_center(rows, nz.fit_standard(rows)))


@query(
    "g4_robust",
    f"""WITH {CHANNELS} SELECT feature, round(median(value), 6) AS center, round(CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1
      ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END, 6) AS scale FROM ms GROUP BY 1""",
)
def g4(t):
    return rounded(nz.fit_robust(many_channels(t)))


@query(
    "g4_robust_transform",
    f"""{MEAS}, f AS (SELECT feature, median(value) AS c, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM ms GROUP BY 1)
    SELECT pid, step, feature, round((value - c) / s, 6) AS value FROM ms JOIN f USING (feature)""",
)
def g4_apply(t):
    rows = measured_of(t)
    return rounded(nz.apply_center(rows, nz.fit_robust(rows)))


@query(
    "g5_quantile_fit",
    """WITH n AS (SELECT o_orderstatus AS feature, least(count(*), 101) AS nq FROM orders GROUP BY 1), i AS (SELECT feature, nq, unnest(range(0, nq)) AS i FROM n),
    q AS (SELECT o_orderstatus AS feature, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY 1),
    p AS (SELECT feature, i, v, i * (len(v) - 1) / (nq - 1)::DOUBLE AS pos FROM i JOIN q USING (feature))
    SELECT feature, CAST(i AS INT) AS i, round(v[CAST(floor(pos) AS INT) + 1] + (v[CAST(ceil(pos) AS INT) + 1] - v[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)), 4) AS q FROM p""",
)
def g5_fit(t):
    """Evenly spaced exact quantiles per channel."""
    from tidemark.operators.quantiles import quantile_table

    rows = t.orders.select(F.col("o_orderstatus").alias("feature"), F.col("o_totalprice").alias("value"))
    out = quantile_table(rows, ["feature"], "value", 101)
    return rounded(out.select("feature", "i", "q"), 4)


@query(
    "g5_quantile_uniform",
    """WITH v AS (SELECT l_linestatus AS f, list(l_quantity ORDER BY l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1),
    q AS (SELECT f, i, i * (n - 1) / 50.0::DOUBLE AS pos, v FROM v, UNNEST(range(0, 51)) u(i)),
    k AS MATERIALIZED (SELECT f, i, v[CAST(floor(pos) AS INT) + 1] + (v[CAST(ceil(pos) AS INT) + 1] - v[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)) AS q FROM q),
    d AS (SELECT DISTINCT l_linestatus AS f, l_quantity AS x FROM lineitem),
    e AS (SELECT f, x, max(i) FILTER (q <= x) AS j, min(i) FILTER (q >= x) AS i, min(q) FILTER (q > x) AS b, max(q) FILTER (q <= x) AS a, min(q) AS lo, max(q) AS hi FROM d JOIN k USING (f) GROUP BY 1, 2),
    u AS (SELECT f, x, CASE WHEN x <= lo THEN 0 WHEN x >= hi THEN 1 WHEN a = x THEN (i + j) / 100.0 ELSE (j + (x - a) / (b - a)) / 50.0 END AS u FROM e)
    SELECT l_orderkey, l_linenumber, round(u::DOUBLE, 6) AS value FROM lineitem JOIN u ON x = l_quantity AND f = l_linestatus""",
)
def g5_uniform(t):
    """Quantile transform to uniform scores, 51 quantiles."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("feature"), F.col("l_quantity").alias("value"))
    fitted = nz.fit_quantile(rows, 51)
    out = nz.apply_quantile(rows, fitted, "uniform")
    return rounded(out.select("l_orderkey", "l_linenumber", "value"))


@query("g5_quantile_normal")
def g5(t):
    """Quantile transform to normal scores (inverse normal has no SQL counterpart)."""
    rows = measured_of(t)
    return rounded(nz.apply_quantile(rows, nz.fit_quantile(rows)))


@query("g6_power_fit")
def g6(t):
    """Yeo-Johnson lambda by maximum likelihood per channel."""
    return rounded(nz.fit_power(measured_of(t)), 4)


@query("g6_power_transform")
def g6_apply(t):
    rows = measured_of(t)
    return rounded(nz.apply_power(rows, nz.fit_power(rows)))


@query(
    "g7_clip",
    f"""{MEAS}, f AS (SELECT feature, avg(value) AS c, stddev_pop(value) AS s FROM ms GROUP BY 1)
    SELECT pid, step, feature, round(greatest(-1, least(1, (value - c) / s)), 6) AS value FROM ms JOIN f USING (feature)""",
)
def g7(t):
    rows = measured_of(t)
    out = nz.apply_center(rows, nz.fit_standard(rows))
    return rounded(out.withColumn("value", clip(F.col("value"), -1.0, 1.0)))


@query(
    "g8_apply_padded",
    f"""{MEAS}, f AS (SELECT feature, avg(value) AS c, stddev_pop(value) AS s FROM ms WHERE pid % 2 = 0 GROUP BY 1),
    g AS (SELECT p.pid, x.feature, grid.step FROM (SELECT pid FROM base) p CROSS JOIN (SELECT DISTINCT feature FROM ms) x CROSS JOIN grid)
    SELECT g.pid, g.step, g.feature, coalesce(round((ms.value - c) / s, 6), 0) AS value FROM g LEFT JOIN ms ON ms.pid = g.pid AND ms.step = g.step AND ms.feature = g.feature LEFT JOIN f ON f.feature = g.feature""",
)
def g8(t):
    """Statistics fitted on one half of the users applied to full series: gaps and padding are 0."""
    cells = cells_of(t)
    lengths = ft.trajectory_lengths(cells, exclude=("view",))
    fitted = nz.fit(nz.measured(cells.filter(F.col("pid") % 2 == 0), lengths), method="standard")
    full = m.scaffold(t.base, ["click", "error", "purchase", "signup", "view"]).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(115)))
    )
    rows = full.join(cells, ["pid", "feature", "step"], "left")
    return rounded(nz.transform_padded(rows, lengths, fitted))


@query("g8_adaptive_all_methods")
def g8_all(t):
    """Adaptive fit and transform over channels of five shapes; each picks its own method."""
    rows = many_channels(t)
    fitted = nz.fit(rows)
    out = nz.transform(rows, fitted)
    return rounded(out.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), 4)


@query(
    "g9_tabular",
    """WITH c AS (SELECT c_custkey AS pid, c_acctbal AS bal, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey::DOUBLE END AS nat FROM customer),
    tr AS (SELECT avg(bal) AS bm, stddev_pop(bal) AS bs, avg(nat) AS nm, stddev_pop(nat) AS ns FROM c WHERE pid % 4 <> 0)
    SELECT pid, round((bal - bm) / bs, 6) AS bal, round((coalesce(nat, nm) - nm) / ns, 6) AS nat FROM c, tr""",
)
def g9(t):
    c = t.customer.select(
        F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("bal"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey").cast("double")).alias("nat")
    )
    return rounded(nz.normalise_table(c, "pid", ["bal", "nat"], c.filter(F.col("pid") % 4 != 0)))


@query(
    "g10_distribution_report",
    f"""{MEAS}, {MOMENTS}, p AS (SELECT feature, {", ".join(f"quantile_cont(value, {v}) AS {k}" for k, v in nz.PERCENTILES.items())} FROM ms GROUP BY 1)
    SELECT feature, n, {", ".join(f"round({c}, 5) AS {c}" for c in ["mean", "std", "min", "max", "skewness", "kurtosis", *nz.PERCENTILES])},
      CASE WHEN abs(skewness) < 0.5 AND kurtosis < 3 THEN 'normal-ish' WHEN abs(skewness) < 2 AND kurtosis < 7 THEN 'moderate skew'
      WHEN edge >= 0.4 THEN 'boundary-concentrated' ELSE 'heavy skew/tails' END AS distribution_class,
      CASE WHEN abs(skewness) < 0.5 AND kurtosis < 3 THEN 'StandardScaler' WHEN abs(skewness) < 2 AND kurtosis < 7 THEN 'PowerTransformer'
      WHEN edge >= 0.4 THEN 'RobustScaler' ELSE 'QuantileTransformer' END AS recommendation FROM sh JOIN p USING (feature)""",
)
def g10(t):
    return rounded(nz.distribution_report(measured_of(t)), 5)


@query(
    "g11_fit_on_train",
    f"""{MEAS}, b AS (SELECT user_id AS pid, min(ts) <= TIMESTAMP '2024-01-01 12:00:00' AS train FROM events GROUP BY 1),
    f AS (SELECT feature, avg(value) AS c, stddev_pop(value) AS s FROM ms JOIN b USING (pid) WHERE train GROUP BY 1)
    SELECT pid, step, feature, train, round((value - c) / s, 6) AS value FROM ms JOIN b USING (pid) JOIN f USING (feature)""",
)
def g11(t):
    """Statistics from the training split only, applied to both splits."""
    rows = measured_of(t)
    cut = F.expr("timestamp_ntz'2024-01-01 12:00:00'")
    tagged = rows.join(t.base.select("pid", (F.col("start_ts") <= cut).alias("train")), "pid")
    return rounded(nz.apply_center(tagged, nz.fit_standard(tagged.filter("train"))))


# ---- bins ------------------------------------------------------------------------------


@query(
    "f7_quantile_bins",
    """WITH e AS (SELECT quantile_cont(o_totalprice, 1 / 3.0::DOUBLE) AS a, quantile_cont(o_totalprice, 2 / 3.0::DOUBLE) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 ELSE 2 END AS bin FROM orders, e""",
)
def f7(t):
    return sm.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 3, "bin").select("o_orderkey", "bin")


@query(
    "f7_equal_width_bins",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity BETWEEN 5 AND 45 THEN greatest(0, least(7, ceil((l_quantity - 5) / 5) - 1)) END AS INT) AS bin FROM lineitem",
)
def f7_width(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", sm.equal_width_bins(F.col("l_quantity"), 5.0, 45.0, 8).alias("bin"))


@query(
    "f9_reverse_cumulative_min",
    """SELECT p_partkey, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey DESC ROWS UNBOUNDED PRECEDING) AS low FROM part""",
)
def f9(t):
    """Running minimum from the end of each group, by value slices of the key."""
    from tidemark.operators.sliced import Scan, sliced_scan

    part = t.part.select("p_brand", "p_partkey", "p_retailprice")
    out = sliced_scan(part, ["p_brand"], ["p_partkey"], [F.floor(F.col("p_partkey") / 500)], [Scan("low", "min", F.col("p_retailprice"), reverse=True)])
    return out.select("p_partkey", "low")


# ---- splits and samples ----------------------------------------------------------------


@query("h1_temporal_split", "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-07-01' THEN 'train' ELSE 'holdout' END AS split FROM orders")
def h1(t):
    train, test = sm.temporal_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-07-01")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("holdout"))).drop("o_orderdate")


@query(
    "h2_stratified_holdout",
    """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':2024'), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
    SELECT doc_id, toxic, r <= round(n * 0.2) AS holdout FROM r""",
)
def h2(t):
    return sm.stratified_holdout(t.labels.select("doc_id", "toxic"), "toxic", "doc_id", 0.2, 2024)


@query(
    "h3_stratified_folds",
    """SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':7'), doc_id) - 1) % 5 AS INT) AS fold FROM labels""",
)
def h3(t):
    return sm.stratified_folds(t.labels.select("doc_id", "toxic"), "toxic", "doc_id", 5, 7)


COHORT = """co AS (SELECT doc_id AS pid, toxic AS label, CAST(n_chars % 116 AS INT) AS traj_len, lang, n_chars FROM labels JOIN documents USING (doc_id))"""


def scored_docs(t):
    d = t.documents.select("doc_id", "n_chars", "lang")
    return t.labels.join(d, "doc_id").select(
        F.col("doc_id").alias("pid"), F.col("toxic").alias("label"), (F.col("n_chars") % 116).cast("int").alias("traj_len"), "lang", "n_chars"
    )


CASES = f"""WITH {COHORT}, a AS (SELECT *, unnest([5, 20, 60]) AS step FROM co), x AS (SELECT * FROM a WHERE traj_len >= step),
    r AS (SELECT *, row_number() OVER (PARTITION BY step, label ORDER BY md5(pid || ':42'), pid) AS r, sum(label) OVER (PARTITION BY step) AS nc FROM x),
    s AS (SELECT pid, label, CAST(step AS INT) AS step FROM r WHERE label = 1 OR r <= nc)"""


@query("h4_case_control", f"{CASES} SELECT pid, label, step FROM s")
def h4(t):
    return sm.case_control(scored_docs(t), [5, 20, 60], 42).select("pid", "label", "step")


@query(
    "h4_case_control_report",
    f"""{CASES}, n AS (SELECT step, count(*) AS n_sampled FROM s GROUP BY 1)
    SELECT CAST(x.step AS INT) AS step, count(*) AS n_active, CAST(sum(label) AS BIGINT) AS n_cases, any_value(n_sampled) AS n_sampled, round(sum(label) * 100.0 / count(*), 6) AS prevalence
    FROM x JOIN n USING (step) GROUP BY 1""",
)
def h4_report(t):
    docs = scored_docs(t)
    return rounded(sm.case_control_report(docs, sm.case_control(docs, [5, 20, 60], 42), [5, 20, 60]))


SAMPLE = f"""{COHORT}, e AS (SELECT quantile_cont(traj_len, 1 / 3.0::DOUBLE) AS a1, quantile_cont(traj_len, 2 / 3.0::DOUBLE) AS a2, quantile_cont(n_chars, 1 / 3.0::DOUBLE) AS b1, quantile_cont(n_chars, 2 / 3.0::DOUBLE) AS b2 FROM co),
    z AS (SELECT co.*, CASE WHEN traj_len <= a1 THEN 0 WHEN traj_len <= a2 THEN 1 ELSE 2 END AS tb, CASE WHEN n_chars <= b1 THEN 0 WHEN n_chars <= b2 THEN 1 ELSE 2 END AS ab FROM co, e),
    q AS (SELECT *, row_number() OVER (PARTITION BY label, tb, lang, ab ORDER BY md5(pid || ':42'), pid) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY label, tb, lang, ab) * 100.0::DOUBLE / count(*) OVER (), 0)) AS k FROM z),
    sp AS (SELECT * FROM q WHERE r <= k)"""


def representative(t):
    docs = scored_docs(t)
    binned = sm.quantile_bins(docs, "traj_len", 3, "tb")
    binned = sm.quantile_bins(binned, "n_chars", 3, "ab")
    return docs, sm.proportional_sample(binned, ["label", "tb", "lang", "ab"], "pid", 100, 42)


@query("h5_proportional_sample", f"WITH {SAMPLE} SELECT pid, label, tb, lang, ab FROM sp")
def h5(t):
    return representative(t)[1].select("pid", "label", "tb", "lang", "ab")


@query(
    "h6_sample_comparison",
    f"""WITH {SAMPLE}, u AS (SELECT 'cohort' AS part, label, traj_len, n_chars, lang FROM co UNION ALL SELECT 'sample', label, traj_len, n_chars, lang FROM sp)
    SELECT part, count(*) AS n, round(avg(traj_len), 6) AS traj_len_mean, round(stddev_samp(traj_len), 6) AS traj_len_std, round(avg(n_chars), 6) AS n_chars_mean, round(stddev_samp(n_chars), 6) AS n_chars_std,
      round(avg(label) * 100, 6) AS label_pct, round(avg(CAST(lang = 'en' AS INT)) * 100, 6) AS en_pct FROM u GROUP BY 1""",
)
def h6(t):
    docs, sample = representative(t)
    shares = {"label": F.col("label") == 1, "en": F.col("lang") == "en"}
    return rounded(sm.compare_sample(docs, sample.select(*docs.columns), ["traj_len", "n_chars"], shares))
