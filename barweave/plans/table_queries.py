"""Queries over the business tables: joins, grouping, windows, sets, scalars, stored tables, splits, models, streams."""

from __future__ import annotations

import tempfile
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..frames import Panel, log, ratio
from ..functions import primitives as pr, sessions as se
from ..operators import backtest as bt, bars as ba, evaluate as ev, joins as jo, models as mo, store as st
from ..sources import committed, readers as rd
from ..sources.shared import written
from ..streaming import closed_bars as stream
from . import sqltext as q
from .feature_queries import hourly, panel, rounded, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# -- joins


@query("join_inner_suffix", "SELECT c_custkey, n_name, c_acctbal, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner_suffix(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_acctbal", F.col("r_name").alias("region"))


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(sum(o_totalprice), 0)::DECIMAL(18,2)::DOUBLE AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


_TWO = f"{q.BARS}, a AS (SELECT * FROM bars WHERE volume > 4), b AS (SELECT * FROM bars WHERE oi > 1100)"


@query("join_full_outer", f"WITH {_TWO} SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, a.volume, b.oi FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def join_full_outer(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return bars.where("volume > 4").select("symbol", "ts", "volume").join(bars.where("oi > 1100").select("symbol", "ts", "oi"), ["symbol", "ts"], "full")


@query("join_semi_anti", f"WITH {_TWO} SELECT symbol, ts, 'both' AS kind FROM a SEMI JOIN b ON a.symbol = b.symbol AND a.ts = b.ts UNION ALL SELECT symbol, ts, 'only' FROM a ANTI JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def join_semi_anti(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    a, b = bars.where("volume > 4").select("symbol", "ts"), bars.where("oi > 1100").select("symbol", "ts")
    return a.join(b, ["symbol", "ts"], "left_semi").withColumn("kind", F.lit("both")).unionByName(a.join(b, ["symbol", "ts"], "left_anti").withColumn("kind", F.lit("only")))


@query("join_merged", f"WITH {q.BARS} SELECT symbol, ts, close, volume, volume * 2 AS volume__dup1, oi FROM bars")
def join_merged(spark, sf_dir):
    """A column that both tables have in equal values stays once, one that differs stays twice."""
    bars = hourly(spark, sf_dir).select("symbol", "ts", "close", "volume", "oi")
    other = bars.select("symbol", "ts", "close", (F.col("volume") * 2).alias("volume"), "oi")
    return jo.join_merged([bars.drop("oi"), other], ["symbol", "ts"]).select("symbol", "ts", "close", "volume", "volume__dup1", "oi")


@query("join_one_to_one", f"WITH {q.BARS} SELECT symbol, ts, close, close * 2 AS close_target FROM bars")
def join_one_to_one(spark, sf_dir):
    bars = hourly(spark, sf_dir).select("symbol", "ts", "close")
    return jo.one_to_one(bars, bars.withColumn("close", F.col("close") * 2), ["symbol", "ts"], suffix="_target")


@query("join_lookup_later", f"WITH {q.BARS} SELECT a.symbol, a.ts, a.close, b.close AS settle, CASE WHEN b.close > a.close THEN 1 WHEN b.close IS NOT NULL THEN 0 END AS outcome FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.ts = a.ts + INTERVAL 180 MINUTE")
def join_lookup_later(spark, sf_dir):
    bars = hourly(spark, sf_dir).select("symbol", "ts", "close")
    return jo.lookup_later(bars, bars, F.lit(180), {"close": "settle"}, keys=["symbol"]).withColumn("outcome", F.when(F.col("settle") > F.col("close"), 1).when(F.col("settle").isNotNull(), 0))


@query("join_range_pool", f"WITH {q.BARS}, d AS (SELECT DISTINCT ts::DATE AS score_date FROM bars WHERE day(ts) % 7 = 0) SELECT score_date, symbol, count(*) AS n, round(sum(volume), 6) AS v FROM d JOIN bars ON ts >= score_date - INTERVAL 7 DAY AND ts < score_date::TIMESTAMP - INTERVAL 15 MINUTE GROUP BY 1, 2")
def join_range_pool(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    dates = bars.where(F.dayofmonth("ts") % 7 == 0).select(F.to_date("ts").alias("score_date")).distinct()
    pool = se.z_pool(bars.withColumn("z", F.struct("symbol", "volume")), dates)
    return pool.groupBy("score_date", F.col("z.symbol").alias("symbol")).agg(F.count("*").alias("n"), F.round(F.sum("z.volume"), 6).alias("v"))


@query("join_range_buckets", "WITH r AS (SELECT p_partkey, p_partkey * 10 AS lo, p_partkey * 10 + 25 AS hi FROM part) SELECT o_orderkey, p_partkey FROM orders JOIN r ON o_orderkey >= lo AND o_orderkey < hi")
def join_range_buckets(spark, sf_dir):
    ranges = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + 25).alias("hi"))
    return jo.range_join(table(spark, sf_dir, "orders").select("o_orderkey"), ranges, "o_orderkey", "lo", "hi", 50).select("o_orderkey", "p_partkey")


@query("join_on_hour", f"WITH {q.BARS} SELECT symbol, close, date_trunc('hour', e.ts) AS hour, e.ts, b.ts AS ts_b, event_id, value FROM events e JOIN bars b ON date_trunc('hour', e.ts) = date_trunc('hour', b.ts)")
def join_on_hour(spark, sf_dir):
    """Each event beside the bars of its hour."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return jo.on_hour(events, hourly(spark, sf_dir).select("symbol", "ts", "close"))


@query("join_by_place", "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) SELECT o_orderkey, c_custkey FROM a JOIN b USING (p)")
def join_by_place(spark, sf_dir):
    return jo.by_place(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "customer").select("c_custkey"), "o_orderkey", "c_custkey")


@query("join_grid", "SELECT n_name, s.stop, e.expiry FROM nation, (VALUES (-1.0), (-2.0)) s(stop), (VALUES (5), (10)) e(expiry)")
def join_grid(spark, sf_dir):
    grid = bt.grid(spark, stop=[-1.0, -2.0], expiry=[5, 10]).select("stop", "expiry")
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(grid)).select("n_name", F.col("stop").cast("decimal(2,1)").alias("stop"), F.col("expiry").cast("int").alias("expiry"))


@query("reindexed", f"WITH {_TWO}, k AS (SELECT DISTINCT symbol, ts FROM a) SELECT k.symbol, k.ts, b.oi FROM k LEFT JOIN b USING (symbol, ts)")
def reindexed(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return jo.reindexed(bars.where("volume > 4"), bars.where("oi > 1100").select("symbol", "ts", "oi"), ["symbol", "ts"])


# -- grouping, ordering, sets, scalars


@query(
    "grouped_stats",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(DISTINCT l_partkey) AS parts, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2 HAVING count(*) > 10",
)
def grouped_stats(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    found = items.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count_distinct("l_partkey").alias("parts"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 4).alias("p90"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd")
    )
    return found.where("n > 10")


@query("pivot_counts", "SELECT event_type, count(*) FILTER (day(ts) <= 10) AS early, count(*) FILTER (day(ts) > 10 AND day(ts) <= 20) AS middle, count(*) FILTER (day(ts) > 20) AS late FROM events GROUP BY 1")
def pivot_counts(spark, sf_dir):
    part = F.when(F.dayofmonth("ts") <= 10, "early").when(F.dayofmonth("ts") <= 20, "middle").otherwise("late")
    return table(spark, sf_dir, "events").withColumn("part", part).groupBy("event_type").pivot("part", ["early", "middle", "late"]).count().fillna(0)


@query("unpivoted", f"WITH {q.BARS} SELECT symbol, ts, feature, x FROM (SELECT symbol, ts, close, volume FROM bars) UNPIVOT (x FOR feature IN (close, volume))")
def unpivoted(spark, sf_dir):
    return ev.unpivoted(hourly(spark, sf_dir), ["symbol", "ts"], ["close", "volume"])


@query("histogram", "SELECT c_mktsegment, least(floor((c_acctbal + 1000) / 1100), 9)::BIGINT AS bin, count(*) AS n FROM customer GROUP BY 1, 2")
def histogram(spark, sf_dir):
    place = F.least(F.width_bucket("c_acctbal", F.lit(-1000.0), F.lit(10000.0), F.lit(10)) - 1, F.lit(9))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("ranks", "SELECT o_orderkey, rank() OVER w AS r_min, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS r_first, round(rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0, 6) AS r_avg FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey)")
def ranks(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy("o_custkey")
    first = Window.partitionBy("o_orderpriority").orderBy("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r_min"), F.row_number().over(first).cast("long").alias("r_first"), F.round(ev.average_rank("o_custkey", ["o_orderpriority"]), 6).alias("r_avg"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("greatest_per_group", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def greatest_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("set_operations", "SELECT o_custkey AS k, 'both' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_custkey, 'first' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def set_operations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in ("F", "O"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


@query("dedupe_first_last", "WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_id, value FROM events) SELECT hour, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM e GROUP BY 1")
def dedupe_first_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", "value")
    first = ba.dedupe(events, ["hour"], "first", [F.col("event_id")]).select("hour", F.col("value").alias("first_value"))
    return first.join(ba.dedupe(events, ["hour"], "last", [F.col("event_id")]).select("hour", F.col("value").alias("last_value")), "hour")


@query(
    "scalars",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, upper(event_type) AS kind, regexp_extract(event_type, '^(.)', 1) AS initial, hour(ts) AS hour, isodow(ts) - 1 AS dow, day(ts) AS day, month(ts) AS month, date_trunc('day', ts)::DATE AS d, round(ln(value) + 0.000000137, 6) + 0.0 AS ln_value, round(greatest(least(value, 100), 10) + 0.000000137, 6) + 0.0 AS clipped, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, TRY_CAST(event_type AS DOUBLE) AS no_number FROM events",
)
def scalars(spark, sf_dir):
    """Functions of a row, with the results of the SQL also for negative values, numbers that are no integers and letters beyond a to z."""
    events, value = table(spark, sf_dir, "events"), F.col("value")
    ln = F.when(value > 0, F.ln(value)).when(value == 0, float("-inf")).when(value < 0, float("nan"))
    made = rounded({"ln_value": ln, "clipped": F.greatest(F.least("value", F.lit(100.0)), F.lit(10.0))})
    return events.select(
        "event_id", _to_long(F.get_json_object("props", "$.k")).alias("k"), _upper("event_type").alias("kind"), F.regexp_extract("event_type", "(?d)^(.)", 1).alias("initial"), F.hour("ts").cast("long").alias("hour"), F.weekday("ts").cast("long").alias("dow"),
        F.dayofmonth("ts").cast("long").alias("day"), F.month("ts").cast("long").alias("month"), F.to_date("ts").alias("d"), *(c.alias(n) for n, c in made.items()), F.when(value > 50, "high").otherwise("low").alias("band"), _to_double(F.col("event_type")).alias("no_number"),
    )


#: Letters whose upper case is several letters, and the one letter that DuckDB gives for each.
_MANY = "".join(c for c in map(chr, range(0xFFFF)) if len(c.upper()) > 1)
_ONE = "".join("\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in _MANY)


def _upper(x: str) -> Column:
    """Upper case, each letter by one letter as in DuckDB."""
    by_letter = F.transform(F.split(x, ""), lambda c: F.when(F.lit(_MANY).contains(c), F.translate(c, _MANY, _ONE)).otherwise(F.upper(c)))
    return F.when(F.octet_length(x) == F.length(x), F.upper(x)).otherwise(F.array_join(by_letter, ""))


def _digits(text: Column) -> Column:
    """Text without the underscores that DuckDB's numbers may have between digits."""
    return F.when(text.contains("_"), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")).otherwise(text)


def _to_long(text: Column) -> Column:
    """Halves are rounded away from zero; an error for what is no number."""
    return F.coalesce(text.try_cast("long"), F.round(_digits(text).cast("decimal(38,18)")).cast("long"))


def _to_double(text: Column) -> Column:
    """The number that a text is, else NULL; no suffix (1d) and no hexadecimals."""
    text = _digits(text)
    number = text.rlike(r"^(?i)\s*[+-]?(inf(inity)?|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)\s*$")
    return F.when(number, F.coalesce(text.try_cast("double"), F.lit(float("nan"))))  # Spark has no -nan


@query("array_algebra", "SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE)) + 0.000000137, 6) + 0.0 AS norm2, round(list_max(embedding)::DOUBLE + 0.000000137, 6) + 0.0 AS top, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_positive FROM embeddings")
def array_algebra(spark, sf_dir):
    part = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * x.cast("double"))
    made = rounded({"norm2": F.aggregate(part, F.lit(0.0), lambda a, x: a + x), "top": F.array_max("embedding").cast("double")})
    return table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(n) for n, c in made.items()), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n_positive"))


@query("islands", "WITH t AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM t) SELECT conv_id, island::BIGINT AS island, any_value(role) AS role, count(*) AS n, min(turn) AS first_turn FROM s GROUP BY 1, 2")
def islands(spark, sf_dir):
    p = Panel(table(spark, sf_dir, "conversations"), by=("conv_id",), ts="turn")
    fresh = F.when(~p.lag("role").eqNullSafe(F.col("role")), 1).otherwise(0)
    marked = p.with_columns(island=p.running_sum(fresh))
    return marked.groupBy("conv_id", F.col("island").cast("long").alias("island")).agg(F.min("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"))


# -- stored tables


def _versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query("append_if_absent", "SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def append_if_absent(spark, sf_dir):
    kept, fresh = _versions(spark, sf_dir)
    return st.absent(fresh, kept, ["o_orderkey"])


@query("upsert", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0")
def upsert(spark, sf_dir):
    kept, fresh = _versions(spark, sf_dir)
    return st.upserted(kept, fresh, ["o_orderkey"])


@query(
    "committed_table",
    "SELECT o_orderkey, o_orderdate AS ts, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0) "
    "AND NOT (o_orderdate >= DATE '1995-03-10' AND o_orderdate < DATE '1995-06-20' AND o_orderkey % 5 = 0)",
)
def committed_table(spark, sf_dir):
    """A table by commits: created, upserted twice by the same batch, and a range of time replaced."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), "o_totalprice")
    kept = committed.CommittedTable(spark, f"{_shared(spark)}/orders")
    kept.create(orders.where("o_orderkey % 3 <> 0"))
    fresh = orders.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for _ in range(2):
        kept.upsert(fresh, ["o_orderkey", "ts"], batch="fresh")
    start, end = "1995-03-10", "1995-06-20"
    again = kept.read(start=start, end=end).where("o_orderkey % 5 <> 0")
    kept.replace_between(again, start, end)
    return kept.read()


@query("replace_where", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'P'")
def replace_where(spark, sf_dir):
    kept, fresh = _versions(spark, sf_dir)
    return st.replaced(kept, fresh.where("o_orderstatus = 'P'"), F.col("o_orderstatus") == "P")


@query("repeated_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 5")
def repeated_keys(spark, sf_dir):
    return st.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("latest_version", "SELECT event_type AS kind, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def latest_version(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts", "event_id")
    return st.latest_version(events, ["kind"], "ts").select("kind", "event_id")


@query("feature_map", f"WITH {q.BARS} SELECT symbol AS feature_key, ts, close, volume, NULL::DOUBLE AS absent FROM bars")
def feature_map(spark, sf_dir):
    """Features to JSON objects and back; a feature that no object has is NULL."""
    bars = hourly(spark, sf_dir)
    names = [r.symbol for r in bars.select("symbol").distinct().collect()]  # the bars' few symbols
    stored = st.union_of([st.to_feature_map(bars.where(F.col("symbol") == n), n, ["close", "volume"]) for n in names])
    return st.from_feature_map(stored, ["close", "volume", "absent"])


@query("feature_names", f"WITH {q.BARS} SELECT unnest(['close', 'volume']) AS feature, count(*) AS n FROM bars GROUP BY 1")
def feature_names(spark, sf_dir):
    return st.feature_names(st.to_feature_map(hourly(spark, sf_dir), "k", ["close", "volume"]))


@query("model_preflight", f"WITH {q.BARS} SELECT 'k' AS feature_key, ts, ['oi'] AS missing FROM bars WHERE volume > 10")
def model_preflight(spark, sf_dir):
    stored = st.to_feature_map(hourly(spark, sf_dir).where("volume > 10"), "k", ["close", "volume"])
    return st.missing_model_columns(stored, ["close", "oi"])


@query("klines", "SELECT make_timestamp(epoch_ms(date_trunc('second', ts)) * 1000) AS ts, value AS open, value AS close, make_timestamp((epoch_ms(date_trunc('second', ts)) + 3599999) * 1000) AS close_time FROM events")
def klines(spark, sf_dir):
    ms = F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp")))
    raw = table(spark, sf_dir, "events").select(ms.cast("string").alias("open_time"), *(F.col("value").cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")), (ms + 3599999).cast("string").alias("close_time"))
    return st.klines(raw).select("ts", "open", "close", "close_time")


@query("closed_bars", f"WITH {q.BARS}, n AS (SELECT date_trunc('hour', max(ts) - INTERVAL 90 MINUTE) AS f FROM events) SELECT symbol, ts, close FROM bars, n WHERE ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND <= f - INTERVAL 1 MILLISECOND")
def closed_bars_query(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 90 MINUTES")).alias("now")).first().now
    return st.closed_only(hourly(spark, sf_dir), F.lit(now)).select("symbol", "ts", "close")


@query("overlap_faults", f"WITH {q.BARS} SELECT symbol, ts, ['close'] AS changed FROM bars WHERE volume > 12")
def overlap_faults(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    moved = bars.withColumn("close", F.when(F.col("volume") > 12, F.col("close") + 1).otherwise(F.col("close")))
    return st.overlap_faults(moved, bars, ["open", "close"], ["symbol", "ts"])


@query("coverage", f"WITH {q.BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM bars GROUP BY 1")
def coverage(spark, sf_dir):
    return st.coverage(hourly(spark, sf_dir), "symbol")


@query("inspection", "SELECT count(*) AS n, count(*) - count(DISTINCT ts) AS n_repeated, count(*) FILTER (step > INTERVAL 1 HOUR) AS n_gaps, 0::BIGINT AS n_bad FROM (SELECT ts, ts - lag(ts) OVER (ORDER BY ts) AS step FROM events)")
def inspection(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("ts", F.col("value").alias("high"), F.col("value").alias("low"), F.col("value").alias("close"))
    return st.inspection(raw)


@query("zeros_carried", f"WITH {q.BARS} SELECT symbol, ts, last_value(nullif(taker_buy, 0) IGNORE NULLS) {q.over('all')} AS taker_buy, {q.rounded({'premium': 'premium'})} FROM bars")
def zeros_carried(spark, sf_dir):
    found = st.zeros_carried(hourly(spark, sf_dir), ["taker_buy", "premium"])
    return found.select("symbol", "ts", "taker_buy", *(c.alias(n) for n, c in rounded({"premium": "premium"}).items()))


@query("time_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER () AS t FROM orders) SELECT o_orderkey, CASE WHEN n <= floor(t * 0.7) THEN 'train' WHEN n <= floor(t * 0.7) + floor(t * 0.15) THEN 'val' ELSE 'test' END AS split FROM r")
def time_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") / 1e6)).alias("ts"))
    return st.time_split(orders, 0.7, 0.15).select("o_orderkey", "split")


@query("warm_up", "WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) SELECT event_id, value FROM r WHERE n > 720")
def warm_up(spark, sf_dir):
    return st.warm_up_dropped(table(spark, sf_dir, "events").select("ts", "event_id", "value"), 720).select("event_id", "value")


@query("scaled_observations", f"WITH {q.BARS}, m AS (SELECT avg(close) AS a, stddev_pop(close) AS s, avg(volume) AS b, stddev_pop(volume) AS t FROM bars) SELECT symbol, ts, {q.rounded({'close': '(close - a) / s', 'volume': '(volume - b) / t'})} FROM bars, m")
def scaled_observations(spark, sf_dir):
    found = st.scaled(hourly(spark, sf_dir), ["close", "volume"])
    return found.select("symbol", "ts", *(c.alias(n) for n, c in rounded({"close": "close", "volume": "volume"}).items()))


@query("na_report", f"WITH {q.BARS}, l AS (SELECT 'close' AS c, close AS x FROM bars UNION ALL SELECT 'zero', 0.0 FROM bars) SELECT c AS \"column\", count(*) FILTER (x IS NULL) AS n_missing, count(DISTINCT x) AS n_distinct, {q.rounded({'std': 'stddev_samp(x)'})}, count(DISTINCT x) <= 1 AS constant FROM l GROUP BY 1")
def na_report(spark, sf_dir):
    found = st.na_report(hourly(spark, sf_dir).withColumn("zero", F.lit(0.0)), ["close", "zero"])
    return found.select("column", "n_missing", "n_distinct", *(c.alias(n) for n, c in rounded({"std": "std"}).items()), "constant")


@query("compare_tables", f"WITH {q.BARS} SELECT 'close' AS \"column\", count(*) AS n, count(*) FILTER (volume > 12) AS mismatches, {q.rounded({'max_gap': 'max(CASE WHEN volume > 12 THEN 0.5 ELSE 0 END)', 'mean_gap': 'avg(CASE WHEN volume > 12 THEN 0.5 ELSE 0 END)'})} FROM bars")
def compare_tables(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    moved = bars.withColumn("close", F.when(F.col("volume") > 12, F.col("close") + 0.5).otherwise(F.col("close")))
    stats, _ = ev.compare_tables(bars, moved, ["symbol", "ts"], ["close"])
    return stats.select("column", "n", "mismatches", *(c.alias(n) for n, c in rounded({"max_gap": "max_gap", "mean_gap": "mean_gap"}).items()))


@query("target_timestamps", f"WITH {q.BARS}, d AS (SELECT DISTINCT ts FROM bars WHERE day(ts) <= 20) SELECT DISTINCT ts FROM bars WHERE ts > (SELECT max(ts) FROM d)")
def target_timestamps(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return st.target_timestamps(bars, bars.where(F.dayofmonth("ts") <= 20).select("ts").distinct())


@query("last_rows", "SELECT event_id, ts FROM (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 50)")
def last_rows(spark, sf_dir):
    return st.last_rows_before(table(spark, sf_dir, "events").select("event_id", "ts"), 50, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("market_cleaning", "WITH p AS (SELECT 'm' || (conv_id % 40) AS market, turn, (conv_id * 13) % 17 AS t FROM conversations) SELECT market, count(*) AS n_points FROM p GROUP BY 1 HAVING count(DISTINCT CASE WHEN t < 15 THEN t END) < 15")
def market_cleaning(spark, sf_dir):
    """Markets that lack a minute are dropped; the result lists the dropped ones of made-up prices."""
    turns = table(spark, sf_dir, "conversations")
    prices = turns.select(F.concat(F.lit("m"), (F.col("conv_id") % 40).cast("string")).alias("market"), F.lit(0).cast("long").alias("market_ts"), ((F.col("conv_id") * 13) % 17 * 60).alias("t"), F.col("turn").cast("double").alias("p"), F.col("conv_id").alias("pos"))
    return se.clean_markets(prices)[1].select("market", "n_points")


# -- files


_SPAN = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"


def _file_scan(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    path = f"{_shared(spark)}/bars{ending}"
    rd.write_table(hourly(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume", "trades"), path)
    return rd.read_table(spark, path, "2024-01-05", "2024-01-20", ["symbol", "open", "close", "volume"])


@query("csv_scan", f"WITH {q.BARS} SELECT symbol, ts, open, close, volume FROM bars WHERE {_SPAN}")
def csv_scan(spark, sf_dir):
    """Bars written as CSV and read again between two times."""
    return _file_scan(spark, sf_dir, ".csv")


@query("parquet_scan", f"WITH {q.BARS} SELECT symbol, ts, open, close, volume FROM bars WHERE {_SPAN}")
def parquet_scan(spark, sf_dir):
    """Bars written as Parquet and read again between two times."""
    return _file_scan(spark, sf_dir, ".parquet")


# -- models and streams


@query("trained_trees")
def trained_trees(spark, sf_dir):
    """Boosted trees on window features of the bars, a model for each symbol, split by time; metrics of the last parts.

    Models see rows with all features and the target. A symbol without such rows for training has no model; its metrics are NULL.
    """
    p = panel(spark, sf_dir)
    made = p.select(z=pr.zscore(p, "close", 24), vol=pr.parkinson_volatility(p, 24), share=ratio("taker_buy", "volume"), y=log(ratio(p.lead("close", 6), "close")))
    made = written(made, "trees-rows")  # training reads its rows many times
    features = ["z", "vol", "share"]

    def scored(row) -> DataFrame:
        whole = made.where(F.col("symbol").eqNullSafe(row.symbol)).dropna(subset=[*features, "y"])
        split = written(st.time_split(whole, 0.7, 0.15), "trees-split")
        train, test = split.where("split = 'train'"), split.where("split = 'test'")
        if train.isEmpty():  # as where every frame has a bar with a low of zero
            predicted = test.withColumn("y_pred", F.lit(None).cast("double"))
        else:
            predicted = mo.predict(mo.fit_trees(train, features, "y"), test)
        return mo.metrics(predicted, "y").withColumn("symbol", F.lit(row.symbol).cast("string"))

    symbols = made.select("symbol").distinct().orderBy("symbol").collect()
    with ThreadPool(4) as pool:  # a fit is hundreds of short jobs, which leave cores idle
        found = pool.map(inheritable_thread_target(spark)(scored), symbols)
    return st.union_of(found).select("symbol", *(c.alias(n) for n, c in rounded({n: n for n in ("rmse", "mae", "corr", "pinball")}, 4).items()))


@query("regimes")
def regimes(spark, sf_dir):
    """States of a two-state model of volatility and volume, with their probabilities."""
    p = panel(spark, sf_dir)
    made = st.scaled(p.select(vol=pr.parkinson_volatility(p, 24), v=F.log1p("volume")).dropna(), ["vol", "v"])
    model, _ = mo.fit_hmm(made, ["vol", "v"], 2, iterations=5)
    found = mo.hmm_states(made, model, ["vol", "v"])
    return found.select("symbol", "ts", "state", *(c.alias(n) for n, c in rounded({"p_state_0": "p_state_0", "p_state_1": "p_state_1"}, 4).items()))


@query("stream_bars", f"WITH {q.BARS}, last AS (SELECT max(ts) AS m FROM events) SELECT symbol, ts, open, high, low, close FROM bars, last WHERE ts + INTERVAL 1 HOUR <= m - INTERVAL 1 HOUR")
def stream_bars(spark, sf_dir):
    """Closed bars by a stream over the events, appended to a table that a repeated batch does not change."""
    root = _shared(spark)
    source = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")
    source.write.parquet(f"{root}/ticks")
    ticks = stream.ticks_from_files(spark, f"{root}/ticks", source.schema, per_trigger=None)  # files of tasks are in no order of time
    stream.append_stream(stream.closed_bars(ticks), f"{root}/bars", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/bars").select("symbol", "ts", "open", "high", "low", "close")


def _shared(spark: SparkSession) -> str:
    """A new folder for a stream's files: under ``spark.checkpoint.dir`` where it is set, else (in tests) a local one."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or 'file://' + tempfile.mkdtemp(prefix='barweave-stream-')}/stream-{uuid.uuid4().hex}"
