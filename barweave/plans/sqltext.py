"""Building blocks of the checking SQL (DuckDB): bars from the events and window expressions as text."""

from __future__ import annotations

#: Means of prices in cents often end in exactly half a unit of the last digit, where engines round either way on the
#: last bit of a sum; results are moved by this part of a unit before rounding.
SHIFT = 0.137

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
         sum(1 + event_id % 4)::DOUBLE AS volume, count(*)::DOUBLE AS trades, sum(value) AS quote_volume,
         coalesce(sum(1 + event_id % 4) FILTER (user_id % 2 = 0), 0)::DOUBLE AS taker_buy, (1 + count(*) FILTER (event_id % 3 = 0))::DOUBLE AS spot_volume,
         (1000 + sum(user_id % 97))::DOUBLE AS oi, avg(value) / 1000 - 0.05 AS premium
  FROM events GROUP BY 1, 2
)"""


def over(first: int | str, last: int = 0, by: str = "symbol", order: str = "ts") -> str:
    def end(k):
        return "UNBOUNDED PRECEDING" if k == "all" else "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {end(first)} AND {end(last)})"


def gated(aggregate: str, x: str, n: int, least: int | None = None) -> str:
    w = over(1 - n)
    return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {aggregate} {w} END"


def mean(x: str, n: int, least: int | None = None) -> str:
    return gated(f"avg({x})", x, n, least)


def total(x: str, n: int, least: int | None = None) -> str:
    return gated(f"sum({x})", x, n, least)


def std(x: str, n: int, least: int | None = None) -> str:
    return gated(f"stddev_samp({x})", x, n, max(2, n if least is None else least))


def var(x: str, n: int, least: int | None = None) -> str:
    return gated(f"var_samp({x})", x, n, max(2, n if least is None else least))


def high(x: str, n: int, least: int | None = None) -> str:
    return gated(f"max({x})", x, n, least)


def low(x: str, n: int, least: int | None = None) -> str:
    return gated(f"min({x})", x, n, least)


def quantile(x: str, n: int, q: float, least: int | None = None) -> str:
    return gated(f"quantile_cont({x}, {q})", x, n, least)


def zscore(x: str, n: int, least: int | None = None) -> str:
    return f"({x} - ({mean(x, n, least)})) / nullif({std(x, n, least)}, 0)"


def corr(x: str, y: str, n: int, least: int | None = None) -> str:
    """Over pairs; a constant side gives NULL."""
    a, b, w = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)", over(1 - n)
    return f"CASE WHEN count({a}) {w} >= {max(2, n if least is None else least)} THEN covar_samp({a}, {b}) {w} / nullif(stddev_samp({a}) {w} * stddev_samp({b}) {w}, 0) END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def ewm(x: str, alpha: float, least: int = 0) -> str:
    """Recursive mean in closed form, for a series without gaps that begins at row ``_first`` of ``_row``."""
    whole = over("all")
    keep = 1 - alpha
    return (
        f"CASE WHEN _row - _first + 1 >= {max(1, least)} THEN pow({keep!r}, _row - _first) * sum(CASE WHEN _row = _first THEN {x} ELSE {alpha!r} * {x} * pow({keep!r}, _first - _row) END) {whole} END"
    )


def clip(x: str, least: float, most: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least({x}, {most}), {least}) END"


def rounded(columns: dict[str, str], digits: int = 6) -> str:
    return ",\n  ".join(f"round({x} + {SHIFT / 10**digits!r}, {digits}) + 0.0 AS {name}" for name, x in columns.items())


def staged(columns: dict[str, str], *stages: dict[str, str], base: str = BARS, source: str = "bars", keys: str = "symbol, ts", where: str = "TRUE", digits: int = 6) -> str:
    """Named stages over the bars, then the rounded columns."""
    parts, last = [base], source
    for n, stage in enumerate(stages):
        made = ", ".join(f"{x} AS {name}" for name, x in stage.items())
        parts.append(f"s{n} AS (SELECT *, {made} FROM {last})")
        last = f"s{n}"
    return f"WITH {', '.join(parts)}\nSELECT {keys},\n  {rounded(columns, digits)}\nFROM {last} WHERE {where}"
