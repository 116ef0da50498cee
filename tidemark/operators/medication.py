"""Drug signals, tiers and profiles per cell.

``doses(pid, step, code, dose, unit)``: coded, dosed events already on the grid; ``dose`` may be text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import drug_tables as T
from tidemark.functions.classify import longest_prefix
from tidemark.functions.columns import lookup, to_number

# ---- tier maps -------------------------------------------------------------------------


@dataclass(frozen=True)
class TierMap:
    """Code to ordinal tier: exact code, else longest prefix, else fallback prefix, else NULL."""

    name: str
    exact: dict[str, int]
    prefix: dict[str, int] = field(default_factory=dict)
    default: dict[str, int] = field(default_factory=dict)

    def tier(self, code: Column) -> Column:
        parts = [lookup(code, self.exact)] if self.exact else []
        parts += [longest_prefix(code, p) for p in (self.prefix, self.default) if p]
        return F.when(F.length(code) >= 4, F.coalesce(*parts).cast("int"))


TIER_MAPS: dict[str, TierMap] = {}


def register_tiers(tiers: TierMap) -> None:
    TIER_MAPS[tiers.name] = tiers


for _name, _table in T.TIER_TABLES.items():
    register_tiers(TierMap(_name, **{part: _table.get(part, {}) for part in ("exact", "prefix", "default")}))


def check_tiers(codes: DataFrame) -> DataFrame:
    """Spot checks of the registered maps on the codes in use: ``(mapping, code, n, expected, tier, ok)``."""
    checks = F.array(
        *[
            F.struct(F.lit(name).alias("mapping"), F.lit(code).alias("code"), F.lit(level).alias("expected"))
            for name, table in T.TIER_SPOT_CHECKS.items()
            for code, level in table.items()
        ]
    )
    used = codes.groupBy("code").agg(F.count("*").alias("n"))
    hits = used.withColumn("c", F.explode(F.filter(checks, lambda c: c["code"] == F.col("code"))))
    tier = F.lit(None).cast("int")
    for name in T.TIER_SPOT_CHECKS:
        tier = F.when(F.col("mapping") == name, TIER_MAPS[name].tier(F.col("code"))).otherwise(tier)
    out = hits.select("c.mapping", "code", "n", "c.expected").withColumn("tier", tier)
    return out.withColumn("ok", F.col("tier").eqNullSafe(F.col("expected")))


# ---- signals ---------------------------------------------------------------------------


def strongest_dose(doses: DataFrame) -> DataFrame:
    """One row per (pid, step, code): the highest dose, missing doses count as 0, ties by unit."""
    size = F.coalesce(to_number(F.col("dose")), F.lit(0.0))
    best = F.max(F.struct(size.alias("s"), F.col("dose").alias("dose"), F.col("unit").alias("unit"))).alias("m")
    return doses.groupBy("pid", "step", "code").agg(best).select("pid", "step", "code", "m.dose", "m.unit")


def signal_columns() -> dict[str, Column]:
    """Condition per signal name over ``code, dose, unit``; never NULL."""
    code, dose = F.col("code"), to_number(F.col("dose"))
    unit = F.lower(F.trim(F.col("unit")))
    running, bolus = unit.isin(*T.INFUSION_UNITS), unit == "mg"
    out = {name: code.isin(*codes) for name, codes in T.SIGNAL_CODES.items()}
    for name, prefixes in T.SIGNAL_PREFIXES.items():
        out[name] = reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])
    running, bolus = F.coalesce(running, F.lit(False)), F.coalesce(bolus, F.lit(False))
    over = [(code == c) & (dose > t) for c, t in T.PROPHYLACTIC_CEILING.items()]
    therapeutic = F.coalesce(reduce(lambda a, b: a | b, over), F.lit(False))
    lmwh = code.isin(*T.PROPHYLACTIC_CEILING)
    prokinetic = F.coalesce((code == T.PROKINETIC_CODE) & (dose <= T.PROKINETIC_DOSE) & bolus, F.lit(False))
    propofol = code == T.PROPOFOL
    relaxed = (code == T.CISATRACURIUM) | ((code == T.ROCURONIUM) & running)
    out |= {
        "antibiotic": code.startswith("J01") & ~prokinetic,
        "propofol_sedation": propofol & ~bolus,
        "propofol_surgical": propofol & bolus,
        "nmba_infusion": relaxed,
        "nmba_bolus": code.isin(T.SUXAMETHONIUM, T.ROCURONIUM) & ~relaxed,
        "prophylactic_lmwh": lmwh & ~therapeutic,
        "therapeutic_lmwh": lmwh & therapeutic,
        "iv_heparin": (code == T.HEPARIN) & running,
        "continuous_loop": code.isin(*T.SIGNAL_CODES["loop_diuretic"]) & running,
        "iv_insulin": code.isin(*T.RAPID_INSULIN) & running,
        "strong_or_icu_opioid": code.isin(*T.SIGNAL_CODES["strong_opioid"])
        | reduce(lambda a, b: a | b, [code.startswith(p) for p in T.SIGNAL_PREFIXES["icu_opioid"]]),
    }
    out["therapeutic_anticoag"] = out["therapeutic_lmwh"] | out["iv_heparin"] | out["doac"] | out["vka"]
    return {name: F.coalesce(cond, F.lit(False)) for name, cond in out.items()}


def tag_signals(doses: DataFrame) -> DataFrame:
    """All signal flags plus the antibiotic tier, as columns of every record."""
    cols = signal_columns()
    tagged = doses.withColumns(cols)
    tier = TIER_MAPS["antibiotic_escalation"].tier(F.col("code"))
    return tagged.withColumn("abx_level", F.when(F.col("antibiotic"), tier))


def roll_up_signals(tagged: DataFrame) -> DataFrame:
    """Signals per cell. After the dose de-duplication a code occurs once per cell, so summing a
    flag counts distinct codes and any() is a positive sum: one pass, no distinct aggregates.

    The level is a struct's, for which Spark aggregates by order: records come ordered by cell from the
    de-duplication, so one cell is held at a time, not some sixty sums of every cell in a hash table."""
    names = list(signal_columns())
    rolled = tagged.groupBy("pid", "step").agg(
        *[F.sum(F.col(n).cast("int")).cast("int").alias(n) for n in names], F.max(F.struct("abx_level")).alias("__level")
    )
    return rolled.withColumn("abx_level", F.col("__level.abx_level")).drop("__level")


def _level(*rules: tuple[Column, int]) -> Column:
    """Highest rule that applies; rules are given in rising order, later ones override."""
    out = F.lit(0)
    for cond, level in rules:
        out = F.when(cond, level).otherwise(out)
    return out


def composite_tiers(s: DataFrame) -> DataFrame:
    """Twelve ordinal features per cell from the rolled-up signals."""
    n = F.col

    def on(*names: str) -> Column:
        return reduce(lambda a, b: a | b, [n(x) > 0 for x in names])

    deep = on("propofol_sedation", "deep_benzo")
    salts = n("electrolyte") >= 2
    support = ["loop_diuretic", "iv_insulin", "albumin", "tpn", "bicarbonate", "metolazone", "continuous_loop"]
    n_support = reduce(lambda a, b: a + b, [(n(x) > 0).cast("int") for x in support]) + salts.cast("int")
    chronic = ["beta_blocker", "sc_insulin", "antiplatelet_broad", "oral_anticoag_broad", "cv_comorbidity"]
    out = s.withColumns(
        {
            "abx_tier": F.coalesce("abx_level", F.lit(0)),
            "abx_n_concurrent": n("antibiotic"),
            "hemodynamic_tier": _level(
                (on("periop_vaso"), 1), (on("icu_vaso"), 2), ((n("icu_vaso") >= 2) | (on("icu_vaso") & on("amiodarone")), 3)
            ),
            "sedation_tier": _level(
                (on("ward_sed"), 1),
                (on("icu_light_sed"), 2),
                (deep, 3),
                (deep & on("nmba_bolus"), 4),
                (deep & on("nmba_infusion"), 5),
            ),
            "coagulation_tier": _level(
                (on("prophylactic_lmwh", "txa", "antiplatelet"), 1),
                (on("therapeutic_anticoag") | (n("antiplatelet") >= 2), 2),
                (on("fibrinogen", "pcc", "vitamin_k", "desmopressin", "protamine"), 3),
                (on("rfviia") | (n("hemostatic") >= 2), 4),
            ),
            "organ_support_tier": _level(
                (on("oral_diuretic", "sc_insulin", "electrolyte"), 1),
                (on("loop_diuretic", "iv_insulin") | salts, 2),
                (on("albumin", "tpn", "metolazone") | (on("loop_diuretic") & (on("iv_insulin") | salts)), 3),
                (on("continuous_loop", "bicarbonate") | (n_support >= 3), 4),
            ),
            "opioid_tier": _level(
                (on("mild_opioid"), 1), (on("strong_or_icu_opioid"), 2), (n("strong_or_icu_opioid") >= 2, 3)
            ),
            "surgical_tier": _level(
                (on("regional"), 1),
                (
                    on("esketamine", "propofol_surgical", "volatile")
                    | (on("icu_opioid") & on("propofol_sedation", "propofol_surgical")),
                    2,
                ),
                (on("thiopental"), 3),
            ),
            "acute_deterioration": F.least(n("reversal"), F.lit(2)),
            "comorbidity_med_count": reduce(lambda a, b: a + b, [(n(x) > 0).cast("int") for x in chronic]),
        }
    )
    active = [*T.COMPOSITE_TOP, "comorbidity_med_count"]
    out = out.withColumn("n_active_dimensions", reduce(lambda a, b: a + b, [(n(x) > 0).cast("int") for x in active]))
    return out.withColumn("max_severity_signal", F.greatest(*[n(x) / top for x, top in T.COMPOSITE_TOP.items()]))


COMPOSITE_FEATURES = [
    "abx_tier",
    "abx_n_concurrent",
    *[x for x in T.COMPOSITE_TOP if x != "abx_tier"],
    "comorbidity_med_count",
    "n_active_dimensions",
    "max_severity_signal",
]


def composite_features(doses: DataFrame) -> DataFrame:
    """Doses to long composite features ``pid, step, feature, value``."""
    wide = composite_tiers(roll_up_signals(tag_signals(strongest_dose(doses))))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in COMPOSITE_FEATURES]
    )
    return wide.select("pid", "step", F.explode(pairs).alias("p")).select("pid", "step", "p.feature", "p.value")


# ---- tier features, rules, exclusions ----------------------------------------------------


def exclude_doses(doses: DataFrame, rules: list[dict]) -> DataFrame:
    """Drop rows by rules ``{code, threshold[, unit]}``: code prefix and dose at most the threshold."""
    out = doses
    for r in rules:
        hit = F.col("code").startswith(r["code"]) & (to_number(F.col("dose")) <= r["threshold"])
        if r.get("unit"):
            hit = hit & (F.trim(F.col("unit")) == r["unit"])
        out = out.filter(~F.coalesce(hit, F.lit(False)))
    return out


def tier_features(doses: DataFrame, categories: dict[str, dict]) -> DataFrame:
    """``max_level`` and ``n_distinct`` per cell and category.

    ``categories``: ``{name: {prefixes, mapping?, exclusions?}}``. Without a mapping every match is
    level 1; a code a mapping does not know has no level but counts as distinct only when it has one.
    """
    tags = []
    for name, cfg in categories.items():
        hit = reduce(lambda a, b: a | b, [F.col("code").startswith(p) for p in cfg["prefixes"]])
        level = TIER_MAPS[cfg["mapping"]].tier(F.col("code")) if cfg.get("mapping") else F.lit(1)
        for r in cfg.get("exclusions", []):
            low = F.col("code").startswith(r["code"]) & (to_number(F.col("dose")) <= r["threshold"])
            if r.get("unit"):
                low = low & (F.trim(F.col("unit")) == r["unit"])
            hit = hit & ~F.coalesce(low, F.lit(False))
        tags.append(F.when(hit & level.isNotNull(), F.struct(F.lit(name).alias("category"), level.alias("level"))))
    rows = doses.select("pid", "step", "code", F.explode(F.array_compact(F.array(*tags))).alias("t"))
    # distinct codes first, so the second group only counts
    per_code = rows.groupBy("pid", "step", "t.category", "code").agg(F.max("t.level").alias("level"))
    return per_code.groupBy("pid", "step", "category").agg(
        F.max("level").alias("max_level"), F.count("*").alias("n_distinct")
    )


def profile_levels(labels: DataFrame, rules: dict[str, list[dict]]) -> DataFrame:
    """Rule level per (pid, step, category) from distinct sub-codes; the highest matching level wins.

    ``labels(pid, step, value, sub_code)``. Rules: ``{level, type: count, min, max}`` or
    ``{level, type: codes, required}``. Only the codes some rule names are collected, others are counted.
    """
    named = sorted({c for rs in rules.values() for r in rs if r.get("type") == "codes" for c in r["required"]})
    one = labels.filter(F.col("value").isin(*rules) & F.col("sub_code").isNotNull())
    one = one.select("pid", "step", "value", "sub_code").distinct()
    seen = F.collect_set(F.when(F.col("sub_code").isin(*named), F.col("sub_code"))) if named else F.array().cast("array<string>")
    cells = one.groupBy("pid", "step", F.col("value").alias("category")).agg(F.count("*").alias("n"), seen.alias("codes"))
    level = F.lit(0)
    for category, rs in rules.items():
        per = F.lit(0)
        for r in sorted(rs, key=lambda r: r["level"]):
            if r.get("type", "count") == "count":
                ok = (F.col("n") >= r.get("min", 0)) & (F.col("n") <= r.get("max", 2**31))
            else:
                ok = F.size(F.array_except(F.lit(r["required"]), F.col("codes"))) == 0
            per = F.when(ok, r["level"]).otherwise(per)
        level = F.when(F.col("category") == category, per).otherwise(level)
    return cells.select("pid", "step", "category", level.alias("level"))


def strip_profiled(labels: DataFrame, profiled: list[str]) -> DataFrame:
    """Labels that have their own profile channel leave the multi-hot source."""
    return labels.filter(~F.col("value").isin(*profiled))
