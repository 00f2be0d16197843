"""Forward-looking targets: returns, excursions, and labels by which barrier is hit first.

First hits are places in the array of the next bars, so a barrier's label is an expression of the row. A target needs
all bars of its horizon unless the function says otherwise, and is NULL without them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..frames import Panel, clip, col, log, ratio


def forward_return(p: Panel, horizon: int, entry="close", use_log: bool = True) -> Column:
    later = p.lead("close", horizon)
    return log(ratio(later, entry)) if use_log else ratio(later, entry) - 1


def mfe(p: Panel, horizon: int, entry="close", partial: bool = False) -> Column:
    """Best move of the high over the entry."""
    return ratio(p.next_high("high", horizon, partial), entry) - 1


def mae(p: Panel, horizon: int, entry="close", partial: bool = False) -> Column:
    return ratio(p.next_low("low", horizon, partial), entry) - 1


class Hits:
    """Numbers (1, 2, ...) of the next bars that first reach the upper and the lower barrier, NULL for none."""

    def __init__(self, p: Panel, horizon: int, up: float, down: float, entry="close", partial: bool = False) -> None:
        entry = col(entry)
        bars = p.next_rows(F.struct(F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l")), horizon)
        self.horizon, self.up_pct, self.down_pct, self.entry, self.bars = horizon, up, down, entry, bars
        self.full = p.lead(F.lit(1), horizon).isNotNull() if not partial else F.size(bars) > 0
        top, bottom = entry * (1 + up), entry * (1 - down)
        self.up = p.let(F.nullif(F.array_position(F.transform(bars, lambda b: F.coalesce(b["h"] >= top, F.lit(False))), True), F.lit(0)))
        self.down = p.let(F.nullif(F.array_position(F.transform(bars, lambda b: F.coalesce(b["l"] <= bottom, F.lit(False))), True), F.lit(0)))
        self.known = self.full & entry.isNotNull()
        self.up_first = self.up.isNotNull() & (self.down.isNull() | (self.up < self.down))
        self.down_first = self.down.isNotNull() & (self.up.isNull() | (self.down < self.up))
        self.tie = self.up.isNotNull() & (self.up == self.down)
        #: Of a bar that hits both: whether its open lies nearer to the upper barrier, and to the lower one.
        o = F.get(bars, (self.up - 1).cast("int"))["o"]
        self.nearer_up, self.nearer_down = F.abs(top - o) < F.abs(o - bottom), F.abs(o - bottom) < F.abs(top - o)


def barrier_label(h: Hits, tie: str = "conservative") -> Column:
    """1 for the upper barrier first, -1 for the lower, 0 for none; a tie is 0, or by the bar's open (``proximity``)."""
    tied = F.when(h.nearer_up, 1).when(h.nearer_down, -1).otherwise(0) if tie == "proximity" else F.lit(0)
    return F.when(h.known, F.when(h.up_first, 1).when(h.down_first, -1).when(h.tie, tied).otherwise(0))


def tp_before_sl(h: Hits, tie: str = "conservative") -> Column:
    return F.when(h.known, (barrier_label(h, tie) == 1).cast("int"))


def r_multiple(p: Panel, h: Hits) -> Column:
    """Gain over the stop: take profit, stop (also in a tie), or the return at the horizon."""
    natural = (ratio(p.lead("close", h.horizon), h.entry) - 1) / h.down_pct
    return F.when(h.known, F.when(h.up_first, F.lit(h.up_pct / h.down_pct)).when(h.down_first | h.tie, -1.0).otherwise(natural))


def r_multiple_name(tp: float, sl: float, label: str) -> str:
    """Percents are cut to whole numbers, as names have always been."""
    return f"y_r_u{int(tp * 100)}_d{int(sl * 100)}_{label}"


def is_large_move(p: Panel, horizon: int, up: float, down: float, entry="close") -> Column:
    best, worst = mfe(p, horizon, entry), mae(p, horizon, entry)
    return F.when(best.isNotNull() & worst.isNotNull(), ((best >= up) | (worst <= -down)).cast("int"))


def first_hit_direction(h: Hits) -> Column:
    """1 or 0 for the barrier that is hit first; NULL for a tie or none."""
    return F.when(h.known & h.up_first, 1).when(h.known & h.down_first, 0)


def time_difference(h: Hits) -> Column:
    """How much earlier the upper barrier is hit, in horizons; no hit is one bar after the horizon."""
    never = F.lit(h.horizon + 1)
    gap = F.coalesce(h.down, never) - F.coalesce(h.up, never)
    return F.when(h.known & (h.up.isNotNull() | h.down.isNotNull()), clip(gap.cast("double"), -h.horizon, h.horizon) / h.horizon)


def mfe_mae_ratio(p: Panel, horizon: int, entry="close") -> Column:
    best, worst = mfe(p, horizon, entry), F.abs(mae(p, horizon, entry))
    return (best - worst) / (best + worst + 1e-8)


def strategy_return(p: Panel, h: Hits) -> Column:
    """Gain of holding to the first barrier, the upper one in a tie, or else to the horizon's close."""
    natural = ratio(p.lead("close", h.horizon), h.entry) - 1
    return F.when(h.up_first | h.tie, F.lit(h.up_pct)).when(h.down_first, F.lit(-h.down_pct)).when(h.known, natural)


def triple_barrier(p: Panel, horizon: int, tp: float, sl: float) -> Column:
    """1, -1 or 0; a tie is 1, and the last bars are labelled by what is left of their horizon."""
    h = Hits(p, horizon, tp, sl, partial=True)
    return F.when(h.up.isNotNull() & (h.down.isNull() | (h.up <= h.down)), 1).when(h.down.isNotNull(), -1).otherwise(0)


def direction_label(p: Panel, horizon: int, threshold: float = 0.0) -> Column:
    """1 where the forward return is above the threshold, else 0, also where it is unknown."""
    return F.coalesce(forward_return(p, horizon, use_log=False) > threshold, F.lit(False)).cast("int")


def hit_flag(base, condition: Column) -> Column:
    return F.when(col(base).isNotNull(), condition.cast("tinyint"))


def hit_columns(columns: list[str], up: list[float] = (0.02, 0.03, 0.05), down: list[float] = (0.01, 0.02, 0.03)) -> dict[str, Column]:
    """Flags of excursions beyond thresholds for every horizon that the column names have (``y_mfe_24h``)."""
    horizons = [m[1] for c in columns if (m := re.fullmatch(r"y_mfe_((?:(?!__).)+)", c))]
    name = lambda x: f"{x:.4f}".rstrip("0").rstrip(".") if x != int(x) else str(int(x))
    found = {f"y_hit_up_{h}_ge_{name(t)}": hit_flag(f"y_mfe_{h}", F.col(f"y_mfe_{h}") >= t) for h in horizons for t in up}
    return found | {f"y_hit_down_{h}_ge_{name(t)}": hit_flag(f"y_mae_{h}", F.col(f"y_mae_{h}") <= -t) for h in horizons for t in down}


def horizon_labels(freq: str | None, horizons: list[int]) -> list[str]:
    """24 hourly bars are '24h', minutes 'min', days 'd'; without a frequency '24b'."""
    unit = {"H": "h", "T": "min", "D": "d"}
    m = re.fullmatch(r"(\d*)(H|T|min|D)", freq or "", flags=re.IGNORECASE)
    if not m:
        return [f"{h}b" for h in horizons]
    step = int(m[1] or 1)
    return [f"{h * step}{unit.get(m[2].upper(), 'min')}" for h in horizons]


def barrier_pairs(text: str) -> list[tuple[float, float]]:
    """'0.04:0.02,0.02:0.01' as pairs of take profit and stop loss."""
    return [tuple(map(float, pair.split(":"))) for pair in text.split(",") if pair.strip()]


def thresholds(text: str | None, fallback: list[float]) -> list[float]:
    found = [float(x) for x in (text or "").split(",") if x.strip()] or list(fallback)
    if any(x <= 0 for x in found):
        raise ValueError("thresholds are above zero")
    return found


def target_set(bars, horizons=(3, 6, 12, 24), pairs=(), freq: str | None = "1H", entry: str = "close_t", tie: str = "conservative"):
    """The default targets of a table of bars: returns, excursions and, for each pair of barriers, both labels."""
    p = Panel(bars)
    start = "close" if entry == "close_t" else p.lead("open", 1)
    found: dict[str, Column] = {}
    for h, label in zip(horizons, horizon_labels(freq, list(horizons))):
        found[f"y_logret_{label}"] = forward_return(p, h, start)
        found[f"y_mfe_{label}"], found[f"y_mae_{label}"] = mfe(p, h, start), mae(p, h, start)
        for up, down in pairs:
            hits = Hits(p, h, up, down, start)
            found[f"y_tb_label_u{up}_d{down}_{label}"], found[f"y_tp_before_sl_u{up}_d{down}_{label}"] = barrier_label(hits, tie), tp_before_sl(hits, tie)
    return p.select(**found)


