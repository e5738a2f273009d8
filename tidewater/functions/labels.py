"""Ordered classification rules as native case expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.exprs import rn

# fixed label values
TURN_BUY, STALL, ACCEL_SELL, TURN_SELL, ACCEL_BUY, FLAT = "轉買", "熄火", "加速賣", "轉賣", "加速買", "平穩"
AT_LOW, NEAR_LOW, MID, HIGH = "在低", "貼低", "中段", "高檔"
STRONG, SOLID, DECEL, WORSE, UNKNOWN = "強化", "穩健", "減速", "轉差", "待查"
STATE_ACCEL = "加速"
FALLEN, STALLED, EXTENDED = "價格已跌", "籌碼熄火", "價格延伸"
AT_BASE = "貼底"


def _known(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def flow_inflection(n20: Column, n5: Column, min_shares: float, stall_pct: float = 5.0, accel: float = 1.0) -> Column:
    big = F.greatest(F.abs(n20), F.abs(n5)) >= min_shares
    faster = F.abs(n5) / 5.0 > F.abs(n20) / 20.0 * accel
    near = F.when(n20 == 0, F.lit(100.0)).otherwise(F.abs(n5) / F.nullif(F.abs(n20).cast("double"), F.lit(0.0)) * 100.0)
    down = F.when(n5 > 0, TURN_BUY).when(faster, ACCEL_SELL).when(near < stall_pct, STALL).otherwise(FLAT)
    up = F.when(n5 < 0, F.when(faster, ACCEL_SELL).otherwise(TURN_SELL)).when(faster, ACCEL_BUY).otherwise(FLAT)
    return F.when(n20.isNotNull() & n5.isNotNull() & big, F.when(n20 < 0, down).otherwise(up))


def dist_to_low(close: Column, low: Column) -> Column:
    return F.when(low > 0, rn((close - low) / F.nullif(low, F.lit(0.0)) * 100.0, 1))


def base_proximity(d: Column, at: float = 2.0, near: float = 5.0, mid: float = 20.0) -> Column:
    return F.when(d.isNull(), "").when(d <= at, AT_LOW).when(d <= near, NEAR_LOW).when(d <= mid, MID).otherwise(HIGH)


def fundamental_health(yoy: Column, d: Column, dp: Column, margin: Column, strong: float = 20.0, weak: float = 5.0,
                       deep: float = -30.0, thin: float = 5.0) -> Column:
    grade = (
        F.when(yoy < weak, DECEL).when(_known(d <= deep), DECEL)
        .when((yoy >= strong) & _known(d >= 0), STRONG).otherwise(SOLID)
    )
    demoted = F.when(grade == STRONG, SOLID).when(grade == SOLID, DECEL).otherwise(WORSE)
    return (
        F.when(yoy.isNull(), UNKNOWN).when(yoy < 0, WORSE).when(_known((d <= deep) & (dp <= deep)), WORSE)
        .when(_known(margin < thin), demoted).otherwise(grade)
    )


def is_contrarian(health: Column, inflection: Column, proximity: Column) -> Column:
    return _known(health.isin(STRONG, SOLID) & (inflection == TURN_BUY) & proximity.isin(AT_LOW, NEAR_LOW))


def contrarian_ready(flag: Column, streak: Column, dist_low: Column, min_streak: int = 2, eps: float = 0.0) -> Column:
    return _known(flag & (streak >= min_streak) & (dist_low > eps))


def near_flow_state(f20: Column, f5: Column, t20: Column, t5: Column, min_shares: float, stall: float = 5.0, accel: float = 40.0) -> Column:
    """Worst of the two sides: (state(side), share), as a struct."""
    def side(s20: Column, s5: Column, order: int, label: str) -> Column:
        sh = s5 / F.nullif(s20.cast("double"), F.lit(0.0)) * 100
        worst = F.when(s5 < 0, 0).when(sh < stall, 1).when(sh >= accel, 2).otherwise(3)
        name = F.element_at(F.array(*[F.lit(x) for x in (TURN_SELL, STALL, STATE_ACCEL, FLAT)]), worst + 1)
        ok = s20.isNotNull() & s5.isNotNull() & (s20 >= min_shares)
        return F.when(ok, F.struct(worst.alias("o"), F.lit(order).alias("k"), F.concat(name, F.lit(f"({label})")).alias("state"),
                                   rn(sh, 1).alias("share")))

    return F.array_min(F.array_compact(F.array(side(f20, f5, 0, "外資"), side(t20, t5, 1, "投信"))))


def risk_kind(state: Column, ma60: Column, ma20: Column, mom5: Column, ext: float = 15.0, down: float = -5.0) -> Column:
    return (
        F.when(_known((mom5 < down) & (ma20 < 0)), FALLEN)
        .when(_known(state.contains(STALL) | state.contains(TURN_SELL)), STALLED)
        .when(_known(ma60 > ext), EXTENDED).otherwise("")
    )


def flow_diff_5_20(n5: Column, n20: Column) -> Column:
    return rn(n5 - n20 / 4.0, 1)


def margin_slimming(chg: Column, mom: Column, flat: float = -1.0) -> Column:
    return F.when(chg.isNotNull() & mom.isNotNull(), (chg < 0) & (mom >= flat))


def ambush_checks(health: Column, zone: Column, dist_low: Column, days: Column, lots: Column, near: float = 10.0,
                  day_range: Sequence[int] = (1, 5), max_lots: float = 5000.0) -> dict[str, Column]:
    """The four legs of the early-inflection rule, each never null."""
    return {
        "fund": _known(health.isin(STRONG, SOLID)),
        "position": _known(zone == AT_BASE) | _known(dist_low <= near),
        "days": _known(days.between(day_range[0], day_range[1])),
        "flow": _known(lots <= max_lots),
    }


def deep_value_growth(pctile: Column, yoy: Column, gross: Column, ma60: Column, zone: Column, max_pctile: float = 20.0,
                      min_yoy: float = 30.0, min_gross: float = 25.0) -> Column:
    return _known(pctile <= max_pctile) & _known(yoy >= min_yoy) & _known(gross >= min_gross) & (_known(ma60 < 0) | _known(zone == AT_BASE))
