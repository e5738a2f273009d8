"""Rule candidates, overlays and alerts from the latest feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import clip, rn

# fixed label values
STATUS = (("held", "庫存"), ("watch", "觀察"), ("hit", "本週命中"))
NO_VALUE, TRIPLE, DASH = "估值缺", "✓三重", "—"


def rule_candidates(snap: DataFrame, rules: Sequence[tuple[str, str, str, float, str]], low_pct: float, ceiling: float, top_n: int) -> DataFrame:
    """Best rule per entity by z x room, all hit rules, top n per label.

    ``rules``: (name, label, z column, threshold, extra condition).  The top-n
    row limit runs before the shuffle on the label.
    """
    room = clip(1 - F.col("above_low_60d_pct") / ceiling, 0.0, 1.0)
    hits = []
    for i, (name, label, z, th, extra) in enumerate(rules):
        cond = F.col(z) > th
        if extra == "low":
            cond = cond & (F.col("above_low_60d_pct") <= low_pct)
        elif extra:
            cond = cond & F.expr(extra)
        score = rn(F.col(z) * room, 3)
        hits.append(F.when(cond, F.struct(score.alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("name"), F.lit(label).alias("label"), F.col(z).alias("z"))))
    d = snap.withColumn("_h", F.array_compact(F.array(*hits))).where(F.size("_h") > 0)
    d = d.withColumn("_b", F.array_max("_h")).select(
        "entity", "date", F.col("_b.label").alias("primary_label"), F.array_join(F.transform("_h", lambda x: x["name"]), "/").alias("rules"),
        F.col("_b.score").alias("cp_score"), rn(F.col("_b.z"), 2).alias("flow_z"))
    w = Window.partitionBy("primary_label").orderBy(F.desc_nulls_last("cp_score"), F.desc_nulls_last("flow_z"), "entity")
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n).drop("_k")


#: Fixed display names of the candidate types.
LABELS = {"ambush": "埋伏", "breakout": "追突破", "reversal": "反轉"}


def candidate_table(
    snap: DataFrame, confirm: DataFrame, rules: Sequence[dict], low_pct: float = 15.0, drawdown_pct: float = 20.0, ceiling: float = 60.0, top_n: int = 40,
    laggard_labels: Sequence[str] = (), laggard_boost: float = 0.0, laggard_threshold: float = 0.0,
) -> DataFrame:
    """One row per entity that a rule hits: best rule, all labels and rules, score, freshness, distances, confirmation.

    A rule has name, label, flow_z_col, z_threshold, modifier (low: near the
    60-row low, mom: the column ``mom`` is positive, none) and require_confirm.
    A reversal also needs a drop of ``drawdown_pct`` from the high and, unless
    the rule says otherwise, a confirmed purchase.  The score of a laggard of
    its group (rs_subind_20d below the threshold) is raised by the boost for
    the named labels.  The first ``top_n`` of each label stay, by score, then
    by flow; not positive keeps all.
    """
    c = F.col
    room = clip(1 - c("above_low_60d_pct") / ceiling, 0.0, 1.0)
    d = snap.join(confirm.select("entity", "confirm_buy"), "entity", "left").withColumn("confirm_buy", F.coalesce("confirm_buy", F.lit(False)))
    hits = []
    for i, r in enumerate(rules):
        z = c(r["flow_z_col"])
        cond = z > r["z_threshold"]
        if r.get("modifier") == "low":
            cond = cond & (c("above_low_60d_pct") <= low_pct)
        elif r.get("modifier") == "mom":
            cond = cond & (c(r["mom"]) > 0)
        if r["label"] == "reversal":
            cond = cond & (c("above_high_60d_pct") <= -drawdown_pct)
            if r.get("require_confirm", True):
                cond = cond & c("confirm_buy")
        parts = {"name": F.lit(r["name"]), "label": F.lit(r["label"]), "col": F.lit(r["flow_z_col"]), "z": z}
        hits.append(F.when(cond, F.struct(rn(z * room, 3).alias("score"), F.lit(-i).alias("o"), *[v.alias(k) for k, v in parts.items()])))
    d = d.withColumn("_h", F.array_compact(F.array(*hits))).where(F.size("_h") > 0).withColumn("_b", F.array_max("_h"))
    shown = F.coalesce(*[F.when(c("_b.label") == k, v) for k, v in LABELS.items()], c("_b.label"))
    name_of = lambda x: F.coalesce(*[F.when(x["label"] == k, v) for k, v in LABELS.items()], x["label"])
    rs, score = c("rs_subind_20d"), c("_b.score")
    boosted = F.coalesce(score.isNotNull() & (rs < laggard_threshold) & c("_b.label").isin(*laggard_labels), F.lit(False)) if laggard_boost > 0 and laggard_labels else F.lit(False)
    mom = F.coalesce("flow_momentum_20d", F.lit(0))
    d = d.select(
        "entity", "date", c("_b.label").alias("primary_label"), shown.alias("primary_name"), F.array_join(F.array_distinct(F.transform("_h", name_of)), "/").alias("labels"),
        F.array_join(F.array_distinct(F.transform("_h", lambda x: x["name"])), "/").alias("rules"), F.when(boosted, rn(score * (1 + laggard_boost), 3)).otherwise(score).alias("cp_score"),
        c("_b.col").alias("flow_z_col"), rn(c("_b.z"), 2).alias("flow_z"), F.when(mom > 0, "加速").when(mom < 0, "放緩").alias("freshness"),
        rn("above_low_60d_pct", 1).alias("above_low_pct"), rn("above_high_60d_pct", 1).alias("above_high_pct"), "confirm_buy", rn("rs_subind_20d", 2).alias("rs_subind"), boosted.alias("cp_boosted"))
    w = Window.partitionBy("primary_label").orderBy(F.desc_nulls_last("cp_score"), F.desc_nulls_last("flow_z"), "entity")
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n).drop("_k") if top_n > 0 else d


def early_inflow(snap: DataFrame, pairs: Sequence[tuple[str, str]], z_min: float = 1.0, long_max: float = 0.5, decel_floor: float = 0.0) -> DataFrame:
    """Strongest short-window z whose long window is still cold, with flow not slowing."""
    c = F.array_compact(F.array(*[F.when((F.col(s) > z_min) & (F.col(lg) < long_max), F.struct(F.col(s).alias("z"), F.lit(s).alias("sig"), F.col(lg).alias("lz"))) for s, lg in pairs]))
    d = snap.where(F.col("flow_decel") >= decel_floor).withColumn("_b", F.array_max(c)).where(F.col("_b").isNotNull())
    return d.select("entity", F.col("_b.sig").alias("early_signal"), rn(F.col("_b.z"), 2).alias("short_z"), rn(F.col("_b.lz"), 2).alias("long_z"))


def overheat(snap: DataFrame, near_high: float = 8.0) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("price_flow_div_5d") > 0, F.lit("量價背離")), F.when(F.col("volume_z_5d") < 0, F.lit("量縮"))))
    d = snap.where((F.col("above_high_60d_pct") >= -near_high) & (F.col("flow_decel") < 0)).withColumn("_r", reasons).where(F.size("_r") > 0)
    return d.select("entity", rn("above_high_60d_pct", 1).alias("above_high_pct"), F.array_join(F.concat(F.array(F.lit("短窗減速")), "_r"), "＋").alias("reasons"))


def status_tags(cands: DataFrame, held: DataFrame, watch: DataFrame, hit: DataFrame) -> DataFrame:
    d = cands
    for (k, _), src in zip(STATUS, (held, watch, hit)):
        d = d.join(src.select("entity").distinct().withColumn(f"_{k}", F.lit(1)), "entity", "left")
    tags = F.concat_ws("/", *[F.when(F.col(f"_{k}").isNotNull(), t) for k, t in STATUS])
    return d.withColumn("watch_status", tags).drop(*[f"_{k}" for k, _ in STATUS])


def triple_filter(pctile: Column, cheap: float = 30.0) -> Column:
    return F.when(pctile.isNull(), NO_VALUE).when(pctile <= cheap, TRIPLE).otherwise(DASH)


def quadrant_text(cands: DataFrame, membership: DataFrame, rotation: DataFrame) -> DataFrame:
    """grp(quadrant) of every own group joined in name order."""
    g = membership.join(rotation.select("grp", "quadrant", F.lit(1).alias("_k")), "grp", "left")
    t = g.join(cands.select("entity"), "entity", "left_semi").groupBy("entity").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("grp", F.lit("("), F.when(F.col("_k").isNull(), "榜外").otherwise(F.coalesce("quadrant", F.lit("None"))), F.lit(")")))), "; ").alias("subind_quadrant"))
    return cands.join(t, "entity", "left").withColumn("subind_quadrant", F.coalesce("subind_quadrant", F.lit("未標次產業")))
