"""Registered queries: one Spark job per operator of the inventory, each with
its DuckDB oracle where SQL can state it.

Every query reads the driver's tables: chart caches are refreshed from them
(``charts.materialize``) and the operators run on those caches.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..functions.dates import date_windows, refresh_cutoff, time_bucket
from ..functions.ordinal import ordinal
from ..operators import audit as AU
from ..operators import ledger as L
from ..operators import serve as S
from ..operators import series as SR
from ..operators import values as V
from ..operators.cohort import cohort_view
from ..operators.schema import classify_columns
from ..session import register_tables
from ..sources import cache as C
from ..sources import manifest as M
from ..sources.query import source_query
from ..spec import ChartSpec, DataRequest, DerivedDim, Dim, Metric
from . import charts as CH
from . import chart_view as CV
from . import dashboard as DB
from . import refresh as RF
from . import rollup as RU

D = _dt.date

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = (fn, sql)
        return fn

    return deco


def serve_query(key: str, spec: ChartSpec, req: DataRequest) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.serve(spec, req, CH.materialize(spark, sf_dir, spec))

    REGISTRY[key] = (run, O.serve_sql(spec, req))


A, SALES, OBM, COH = CH.ACTIVITY, CH.SALES, CH.ORDERS_BY_MARKET, CH.COHORT

# ---- serving (AGG-4/5/6, JOIN-1, FLT-1..4, PRJ-1..3, SRT-1, DRV-1, FRM-2/3)
serve_query("agg_4", A, DataRequest(granularity="week", dimensions=["event_type"], metrics=["value", "dau", "value_per_user"]))
serve_query(
    "agg_4_orders",
    OBM,
    DataRequest(granularity="month", dimensions=["region", "segment"], filters={"priority": ["1-URGENT", "2-HIGH"]}),
)
serve_query("agg_4_sales", SALES, DataRequest(granularity="month"))
serve_query(
    "agg_4_tiers",
    OBM,
    DataRequest(
        granularity="week", dimensions=["country_tier", "priority_tier"], metrics=["orders", "buyers", "amount_per_buyer"],
    ),
)
serve_query("agg_5", OBM, DataRequest(x_axis="segment",
                                      dimensions=[], metrics=["orders", "buyers", "amount_per_buyer"]))
serve_query("agg_5_empty_key", OBM, DataRequest(x_axis="priority", dimensions=[], metrics=["buyers", "orders"]))
serve_query("agg_6", COH, DataRequest(x_axis="install_date", dimensions=["days_since_install"],
                                      metrics=["installs", "retained_users", "retention"]))
serve_query("join_1", A, DataRequest(granularity="day", dimensions=["event_type"], metrics=["dau", "events"]))
serve_query("flt_1", A, DataRequest(from_date=D(2024, 1, 5), to_date=D(2024, 1, 20), dimensions=[]))
serve_query("flt_2", A, DataRequest(dimensions=["event_type"], metrics=["value", "events"],
                                    filters={"event_type": ["click", "purchase"]}))
serve_query("flt_3", A, DataRequest(granularity="week", dimensions=[], metrics=["value", "dau", "value_per_user"],
                                    filters={"event_type": ["click"]}))
serve_query("flt_4", COH, DataRequest(dimensions=["days_since_install"], metrics=["installs"], hide_zero=True))
serve_query("prj_1", SALES, DataRequest(granularity="month", dimensions=[], metrics=["revenue", "quantity", "price_per_unit"]))
serve_query("prj_2", SALES, DataRequest(x_axis="returnflag", dimensions=["linestatus"], metrics=["lines", "revenue"]))
serve_query("prj_3", A, DataRequest(granularity="month", dimensions=[], metrics=["dau", "value"]))
SRT_REQ = DataRequest(metrics=["lines"])


@register("srt_1", f"""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY ship_date, l_returnflag, l_linestatus) AS INTEGER) AS position
FROM ({O.serve_sql(SALES, SRT_REQ)}) r""")
def _srt_1(spark, sf):
    # the place that a row has in the served order
    served = S.serve(SALES, SRT_REQ, CH.materialize(spark, sf, SALES)).withColumn("_at", F.monotonically_increasing_id())
    return ordinal(served, [F.col("_at")]).drop("_at")


serve_query("drv_1", OBM, DataRequest(granularity="month", dimensions=["priority_tier"], metrics=["orders", "amount"]))
serve_query("frm_2", OBM, DataRequest(granularity="month", dimensions=["region"], metrics=["amount_per_buyer"]))
serve_query("src_2", CH.ACTIVITY_TYPES, DataRequest(granularity="week", dimensions=["event_type"]))


# ---- the two aggregation steps and the keyset on their own (AGG-1..3)
@register(
    "agg_1",
    f"SELECT DISTINCT CAST(date_trunc('week', _day) AS DATE) AS event_date, event_type FROM ({O.cache_sql(A)}) b",
)
def _agg_1(spark, sf):
    return S.keyset(A, DataRequest(granularity="week", dimensions=["event_type"]), CH.materialize(spark, sf, A))


@register("agg_2", f"SELECT _day AS event_date, MAX(dau) AS dau FROM ({O.cache_sql(A)}) b GROUP BY _day")
def _agg_2(spark, sf):
    return S.dedupe_to_grain(A, DataRequest(dimensions=["event_type"]), CH.materialize(spark, sf, A), "dau")


@register(
    "agg_3",
    "SELECT CAST(date_trunc('week', event_date) AS DATE) AS event_date, CAST(SUM(dau) AS BIGINT) AS dau "
    f"FROM (SELECT _day AS event_date, MAX(dau) AS dau FROM ({O.cache_sql(A)}) b GROUP BY _day) i GROUP BY 1",
)
def _agg_3(spark, sf):
    return S.roll_up(A, DataRequest(granularity="week", dimensions=["event_type"]), CH.materialize(spark, sf, A), "dau")


# ---------------------------------------------------------------- series

SER_REQ = DataRequest(granularity="day", dimensions=["event_type"], metrics=["value", "events"])
SER_WINDOW = (D(2023, 12, 28), D(2024, 2, 3))
_ROWS_SQL = O.serve_sql(A, SER_REQ)
_SER_SQL = f"""WITH r AS ({_ROWS_SQL}),
s AS (
  SELECT event_date AS x, event_type, COALESCE(CAST(event_type AS VARCHAR), '∅') AS combo, 'value' AS metric, CAST(value AS DOUBLE) AS value FROM r
  UNION ALL
  SELECT event_date AS x, event_type, COALESCE(CAST(event_type AS VARCHAR), '∅') AS combo, 'events' AS metric, CAST(events AS DOUBLE) AS value FROM r
)"""
_GRID_SQL = f"""{_SER_SQL},
k AS (SELECT DISTINCT metric, combo FROM s),
sp AS (SELECT CAST(g AS DATE) AS x FROM generate_series(DATE '{SER_WINDOW[0]}', DATE '{SER_WINDOW[1]}', INTERVAL 1 DAY) t(g)),
grid AS (SELECT k.metric, k.combo, sp.x, s.value FROM k CROSS JOIN sp LEFT JOIN s ON s.metric = k.metric AND s.combo = k.combo AND s.x = sp.x)"""


def _series(spark, sf):
    rows = S.serve(A, SER_REQ, CH.materialize(spark, sf, A))
    return SR.to_series(rows, "event_date", ["event_type"], ["value", "events"])


def _grid(spark, sf):
    return SR.fill_gaps(_series(spark, sf), *SER_WINDOW, "day")


register("ser_1", f"{_SER_SQL} SELECT * FROM s")(_series)
register("ser_2", f"{_GRID_SQL} SELECT * FROM grid")(_grid)
register("win_1", f"""{_GRID_SQL} SELECT metric, combo, x,
  AVG(value) OVER (PARTITION BY metric, combo ORDER BY x ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS value FROM grid""")(
    lambda spark, sf: SR.moving_average(_grid(spark, sf), 7))
_SHARE = """CASE WHEN value IS NOT NULL AND SUM(COALESCE(value, 0)) OVER (PARTITION BY metric, x) > 0
  THEN value / SUM(COALESCE(value, 0)) OVER (PARTITION BY metric, x) * 100 ELSE 0 END"""
register("win_2", f"{_GRID_SQL} SELECT metric, x, combo, {_SHARE} AS value FROM grid")(
    lambda spark, sf: SR.share_of_total(_grid(spark, sf)))
register("flt_6", f"{_GRID_SQL} SELECT metric, x, combo, {_SHARE} AS value FROM grid WHERE combo <> 'click'")(
    lambda spark, sf: SR.share_of_total(SR.hide_series(_grid(spark, sf), ["click"])))
register("ser_5", f"""{_GRID_SQL}, sh AS (SELECT metric, x, combo, {_SHARE} AS value FROM grid)
  SELECT metric, x, combo, AVG(value) OVER (PARTITION BY metric, combo ORDER BY x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM sh""")(
    lambda spark, sf: SR.moving_average(SR.share_of_total(_grid(spark, sf)), 3))
register("agg_8", f"{_SER_SQL} SELECT metric, combo, SUM(COALESCE(value, 0)) AS total FROM s GROUP BY 1, 2")(
    lambda spark, sf: SR.series_totals(_series(spark, sf)))
register("agg_9", f"{_SER_SQL} SELECT x, SUM(value) AS value FROM s WHERE metric = 'events' GROUP BY x")(
    lambda spark, sf: SR.point_total(_series(spark, sf).where(F.col("metric") == "events")))
_PCT = "CASE WHEN {n} IS NOT NULL AND {t} IS NOT NULL AND {t} <> 0 THEN CAST(FLOOR(({n} - {t}) / {t} * 100 + 0.5) AS BIGINT) END"
register("ser_6", f"""{_GRID_SQL}
  SELECT g.metric, g.combo, g.x, g.value,
    {_PCT.format(n='g.value', t='p1.value')} AS short_pct, {_PCT.format(n='g.value', t='p7.value')} AS long_pct
  FROM grid g
  LEFT JOIN grid p1 ON p1.metric = g.metric AND p1.combo = g.combo AND p1.x = g.x - 1
  LEFT JOIN grid p7 ON p7.metric = g.metric AND p7.combo = g.combo AND p7.x = g.x - 7""")(
    lambda spark, sf: SR.deltas(_grid(spark, sf), "day"))
register("ser_7", f"""{_SER_SQL}, t AS (SELECT x, SUM(value) AS value FROM s WHERE metric = 'events' GROUP BY x)
  SELECT t.x, t.value, {_PCT.format(n='t.value', t='p1.value')} AS short_pct, {_PCT.format(n='t.value', t='p7.value')} AS long_pct
  FROM t LEFT JOIN t p1 ON p1.x = t.x - 1 LEFT JOIN t p7 ON p7.x = t.x - 7""")(
    lambda spark, sf: SR.total_deltas(_series(spark, sf).where(F.col("metric") == "events"), "day"))

# weekly and monthly spines across a year end, on the sales chart
SALES_SPAN = (D(1992, 1, 1), D(1999, 12, 31))
SALES_M_REQ = DataRequest(granularity="week", dimensions=["returnflag"], metrics=["lines"])


def _sales_weekly(spark, sf):
    rows = S.serve(SALES, SALES_M_REQ, CH.materialize(spark, sf, SALES))
    s = SR.to_series(rows, "ship_date", ["l_returnflag"], ["lines"])
    return SR.deltas(SR.fill_gaps(s, *SALES_SPAN, "week"), "week")


register("ser_6_week", f"""WITH r AS ({O.serve_sql(SALES, SALES_M_REQ)}),
s AS (SELECT ship_date AS x, COALESCE(CAST(l_returnflag AS VARCHAR), '∅') AS combo, 'lines' AS metric, CAST(lines AS DOUBLE) AS value FROM r),
k AS (SELECT DISTINCT metric, combo FROM s),
sp AS (SELECT CAST(g AS DATE) AS x FROM generate_series(DATE '1991-12-30', DATE '1999-12-27', INTERVAL 7 DAY) t(g)),
grid AS (SELECT k.metric, k.combo, sp.x, s.value FROM k CROSS JOIN sp LEFT JOIN s ON s.metric = k.metric AND s.combo = k.combo AND s.x = sp.x)
SELECT g.metric, g.combo, g.x, g.value,
  {_PCT.format(n='g.value', t='p1.value')} AS short_pct, {_PCT.format(n='g.value', t='p7.value')} AS long_pct
FROM grid g
LEFT JOIN grid p1 ON p1.metric = g.metric AND p1.combo = g.combo AND p1.x = g.x - 7
LEFT JOIN grid p7 ON p7.metric = g.metric AND p7.combo = g.combo AND p7.x = g.x - 28""")(_sales_weekly)

# top series: orders by month split by country (25 combos), cap 20
TOP_REQ = DataRequest(granularity="month", dimensions=["country"], metrics=["orders", "amount"])
_TOP_SER_SQL = f"""WITH r AS ({O.serve_sql(OBM, TOP_REQ)}),
s AS (
  SELECT order_date AS x, country, COALESCE(country, '∅') AS combo, 'orders' AS metric, CAST(orders AS DOUBLE) AS value FROM r
  UNION ALL
  SELECT order_date AS x, country, COALESCE(country, '∅') AS combo, 'amount' AS metric, CAST(amount AS DOUBLE) AS value FROM r
),
tot AS (SELECT combo, SUM(COALESCE(value, 0)) AS total FROM s WHERE metric = 'orders' GROUP BY combo),
keep AS (SELECT combo FROM tot ORDER BY total DESC, {O.natural_sql('combo')}, combo LIMIT 20)"""


def _top_input(spark, sf):
    rows = S.serve(OBM, TOP_REQ, CH.materialize(spark, sf, OBM))
    return SR.to_series(rows, "order_date", ["country"], ["orders", "amount"])


register("win_3", f"{_TOP_SER_SQL} SELECT * FROM s WHERE combo IN (SELECT combo FROM keep)")(
    lambda spark, sf: SR.top_series(_top_input(spark, sf), 20, by_metric="orders"))
register("ser_3", f"""{_TOP_SER_SQL} SELECT CAST(COUNT(DISTINCT combo) AS BIGINT) AS present,
  CAST(LEAST(COUNT(DISTINCT combo), 20) AS BIGINT) AS kept, CAST(GREATEST(COUNT(DISTINCT combo) - 20, 0) AS BIGINT) AS dropped FROM s""")(
    lambda spark, sf: SR.cap_series(_top_input(spark, sf), 20, by_metric="orders")[1])
register("srt_4", f"""{_TOP_SER_SQL}, st AS (SELECT metric, combo, SUM(COALESCE(value, 0)) AS total FROM s GROUP BY 1, 2),
  rk AS (SELECT metric, combo, CAST(ROW_NUMBER() OVER (ORDER BY CASE metric WHEN 'orders' THEN 1 ELSE 2 END, total DESC, {O.natural_sql('combo')}, combo) AS INTEGER) AS series_rank FROM st)
  SELECT s.*, rk.series_rank FROM s JOIN rk USING (metric, combo)""")(
    lambda spark, sf: SR.order_series(_top_input(spark, sf), "metric", ["orders", "amount"]))
register("ser_8", f"""SELECT CAST(COUNT(DISTINCT country) * COUNT(DISTINCT segment) * 2 AS BIGINT) AS combos,
  COUNT(DISTINCT country) * COUNT(DISTINCT segment) * 2 <= 2000 AS allowed FROM ({O.cache_sql(OBM)}) b""")(
    lambda spark, sf: SR.guard_combos(CH.materialize(spark, sf, OBM), ["country", "segment", "priority"], 2000, {"priority": 2}))
register("ser_9", f"SELECT COUNT(install_date) > 0 AS is_date FROM ({O.cache_sql(COH)}) b")(
    lambda spark, sf: SR.axis_is_date(CH.materialize(spark, sf, COH), "install_date"))

COH_REQ = DataRequest(x_axis="install_date", dimensions=["days_since_install"], metrics=["retained_users"],
                      from_date=D(2024, 1, 2), to_date=D(2024, 1, 25))


def _clamped(spark, sf):
    rows = S.serve(COH, COH_REQ, CH.materialize(spark, sf, COH))
    s = SR.to_series(rows, "install_date", ["days_since_install"], ["retained_users"])
    return SR.clamp_to_window(s, D(2024, 1, 2), D(2024, 1, 25))


register("flt_5", f"""WITH r AS ({O.serve_sql(COH, COH_REQ)})
  SELECT install_date AS x, days_since_install, COALESCE(CAST(days_since_install AS VARCHAR), '∅') AS combo,
         'retained_users' AS metric, CAST(retained_users AS DOUBLE) AS value
  FROM r WHERE install_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-25'""")(_clamped)


# ---------------------------------------------------------------- values (SRT-2/3, AGG-7, SET-1)

OBM_NATURAL = OBM.with_(name="orders_by_market", dims=tuple(Dim(d.name, d.column) for d in OBM.dims))

register("srt_3", O.dim_values_sql(OBM, order_metric="orders"))(
    lambda spark, sf: V.dim_values(OBM, CH.materialize(spark, sf, OBM)))
register("srt_2", O.dim_values_sql(OBM_NATURAL, dims=["country", "priority"]))(
    lambda spark, sf: V.dim_values(OBM_NATURAL, CH.materialize(spark, sf, OBM), dims=["country", "priority"]))
register("srt_3_cohort", O.dim_values_sql(COH))(
    lambda spark, sf: V.dim_values(COH, CH.materialize(spark, sf, COH)))
register("srt_3_range", O.dim_values_sql(OBM, dims=["country"], order_metric="orders").replace(
    f"FROM ({O.DUCK_CHARTS['orders_by_market']}) _src)", f"FROM ({O.DUCK_CHARTS['orders_by_market']}) _src WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31')"))(
    lambda spark, sf: V.dim_values(OBM, CH.materialize(spark, sf, OBM), D(1998, 1, 1), D(1998, 3, 31), dims=["country"]))
register("srt_3_extent", f"SELECT MIN(_day) AS date_min, MAX(_day) AS date_max FROM ({O.cache_sql(OBM)}) b")(
    lambda spark, sf: V.date_extent(OBM, CH.materialize(spark, sf, OBM)))
register("agg_7", f"SELECT country AS value, SUM(TRY_CAST(orders AS DOUBLE)) AS total FROM ({O.cache_sql(OBM)}) b GROUP BY 1")(
    lambda spark, sf: V.dim_totals(OBM, CH.materialize(spark, sf, OBM), "country"))
_SET1 = f"""WITH a AS ({O.dim_values_sql(OBM, dims=['country', 'segment'], order_metric='orders')}),
b AS ({O.dim_values_sql(COH, dims=['days_since_install'])}),
u AS (SELECT dimension, value, 0 AS c, position FROM a UNION ALL SELECT dimension, value, 1 AS c, position FROM b),
f AS (SELECT dimension, value, MIN(CAST(c AS BIGINT) * 1000000000000 + position) AS first FROM u GROUP BY 1, 2)
SELECT dimension, value, CAST(ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY
  CASE WHEN dimension = 'country' THEN first END, CASE WHEN dimension <> 'country' THEN {O.natural_sql('value')} END, value) AS INTEGER) AS position
FROM f"""
register("set_1", _SET1)(
    lambda spark, sf: V.filter_values([(OBM, CH.materialize(spark, sf, OBM)), (COH, CH.materialize(spark, sf, COH))],
                                      ["country", "segment", "days_since_install"]))


# ---------------------------------------------------------------- dashboards (DSH-*, SET-2)

TODAY = D(2024, 2, 1)
W_VALUE = DB.ChartWidget("w_value", A, ("value", "dau"), filters={"event_type": ["click"]})
W_SPLIT = DB.ChartWidget("w_split", A, ("events",))
W_COHORT = DB.ChartWidget("w_cohort", COH, ("installs",), offset_days=0)
W_EMPTY = DB.ChartWidget("w_empty", A, ("value",), filters={"event_type": ["purchase"]})
T_DAU = DB.NumberTile("t_dau", A, "dau")
DASH = DB.Dashboard("activity", (W_VALUE, W_SPLIT, W_COHORT, W_EMPTY, T_DAU), filters=("event_type",))
STATE = DB.DashboardState(today=TODAY, from_date=D(2024, 1, 10), filters={"event_type": ["click", "view"]},
                          split_by=("event_type", "segment"))


def _widget(w, state=STATE):
    def run(spark, sf):
        return DB.chart_widget(DASH, w, CH.materialize(spark, sf, w.chart), state)
    return run


register("dsh_2", O.serve_sql(A, DataRequest(from_date=D(2024, 1, 10), to_date=D(2024, 1, 30), dimensions=["event_type"],
                                             metrics=["value", "dau"], filters={"event_type": ["click"]})))(_widget(W_VALUE))
register("dsh_3", O.serve_sql(A, DataRequest(from_date=D(2024, 1, 10), to_date=D(2024, 1, 30), dimensions=["event_type"],
                                             metrics=["events"], filters={"event_type": ["click", "view"]})))(_widget(W_SPLIT))
register("dsh_4", O.serve_sql(COH, DataRequest(from_date=D(2024, 1, 10), to_date=D(2024, 2, 1), x_axis="install_date",
                                               dimensions=[], metrics=["installs"])))(
    _widget(W_COHORT, DB.DashboardState(today=TODAY, from_date=D(2024, 1, 10), filters={"event_type": ["click"]})))
W_BOTH = DB.ChartWidget("w_both", A, ("value", "events"), filters={"event_type": ["click", "purchase"]})


@register("set_2", O.serve_sql(A, DataRequest(from_date=D(2024, 1, 10), to_date=D(2024, 1, 30), dimensions=["event_type"],
                                              metrics=["value", "events"], filters={"event_type": ["click"]})))
def _set_2(spark, sf):
    """A widget filtered by the viewer and by itself keeps the values in both;
    one without any, and one whose global selection is empty, show no rows."""
    none = DB.DashboardState(today=TODAY, from_date=D(2024, 1, 10), filters={"event_type": []}, split_by=("event_type",))
    both, apart, empty = _widget(W_BOTH)(spark, sf), _widget(W_EMPTY)(spark, sf), _widget(W_BOTH, none)(spark, sf)
    return both.unionByName(apart, allowMissingColumns=True).unionByName(empty)


_TILE_ROWS = O.serve_sql(A, DataRequest(from_date=D(2024, 1, 23), to_date=D(2024, 1, 30), dimensions=[], metrics=["dau"],
                                        filters={"event_type": ["click", "view"]}))
register("dsh_5", f"""WITH r AS ({_TILE_ROWS}),
p AS (SELECT MAX(CASE WHEN event_date = DATE '2024-01-30' THEN CAST(dau AS DOUBLE) END) AS value,
             MAX(CASE WHEN event_date = DATE '2024-01-29' THEN CAST(dau AS DOUBLE) END) AS d1,
             MAX(CASE WHEN event_date = DATE '2024-01-23' THEN CAST(dau AS DOUBLE) END) AS d7 FROM r)
SELECT DATE '2024-01-30' AS as_of_date, value,
  CASE WHEN value IS NOT NULL AND d1 IS NOT NULL THEN value - d1 END AS previous_day_abs,
  CASE WHEN value IS NOT NULL AND d1 IS NOT NULL AND d1 <> 0 THEN (value / d1 - 1) * 100 END AS previous_day_pct,
  CASE WHEN value IS NOT NULL AND d7 IS NOT NULL THEN value - d7 END AS last_week_abs,
  CASE WHEN value IS NOT NULL AND d7 IS NOT NULL AND d7 <> 0 THEN (value / d7 - 1) * 100 END AS last_week_pct
FROM p""")(lambda spark, sf: DB.number_tile(DASH, T_DAU, CH.materialize(spark, sf, A), STATE))


# ---------------------------------------------------------------- audits (DQ-1/2, JOIN-5)

_DQ1_A = O.serve_sql(A, DataRequest(granularity="week", dimensions=[], metrics=["dau"]))


def _dq1(spark, sf):
    cache = CH.materialize(spark, sf, A)
    served = S.serve(A, DataRequest(granularity="week", dimensions=[], metrics=["dau"]), cache)
    naive = cache.groupBy(time_bucket(F.col("_day"), "week").alias("event_date")).agg(F.sum("dau").alias("dau"))
    return AU.reconcile(served, naive, ["event_date"], ["dau"])


register("dq_1", f"""WITH a AS ({_DQ1_A}),
b AS (SELECT CAST(date_trunc('week', _day) AS DATE) AS event_date, SUM(dau) AS dau FROM ({O.cache_sql(A)}) c GROUP BY 1)
SELECT COALESCE(a.event_date, b.event_date) AS event_date, a.event_date IS NOT NULL AS in_a, b.event_date IS NOT NULL AS in_b,
       CAST(a.dau AS DOUBLE) AS a_dau, CAST(b.dau AS DOUBLE) AS b_dau
FROM a FULL JOIN b ON a.event_date IS NOT DISTINCT FROM b.event_date
WHERE a.event_date IS NULL OR b.event_date IS NULL OR a.dau IS DISTINCT FROM b.dau""")(_dq1)

@register("dq_1_large", """WITH m AS (SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders)
SELECT o_orderkey, true AS in_a, o_orderdate < hi AS in_b, CAST(o_custkey AS DOUBLE) AS a_o_custkey, CASE WHEN o_orderdate < hi THEN CAST(o_custkey AS DOUBLE) END AS b_o_custkey,
       CAST(o_totalprice AS DOUBLE) AS a_o_totalprice, CASE WHEN o_orderdate < hi THEN CAST(o_totalprice AS DOUBLE) + 1 END AS b_o_totalprice
FROM orders, m WHERE o_orderdate = lo OR o_orderdate = hi""")
def _dq_1_large(spark, sf):
    """Orders against a copy whose prices all differ a little (within the
    tolerance), those of the first day by one, and which lacks the last day."""
    register_tables(spark, sf)
    orders = spark.table("orders")
    ends = spark.sql("SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders").first()
    price, first = F.col("o_totalprice").cast("double"), F.col("o_orderdate") == F.lit(ends["lo"])
    copy = orders.where(F.col("o_orderdate") < F.lit(ends["hi"])).withColumn("o_totalprice", F.when(first, price + 1).otherwise(price * (1 + 1e-12)))
    return AU.reconcile_large(orders.withColumn("o_totalprice", price), copy, ["o_orderkey"], ["o_custkey", "o_totalprice"])


A_BAD = A.with_(metrics=tuple(m if m.name != "events" else type(m)("events", column="events", independent_of=("event_type",))
                              for m in A.metrics))
register("dq_2", f"""SELECT 'events' AS metric, _day AS day, '{{}}' AS grain, COUNT(*) AS rows,
  CAST(COUNT_IF(events IS NULL) AS BIGINT) AS nulls, MIN(CAST(events AS DOUBLE)) AS min_value, MAX(CAST(events AS DOUBLE)) AS max_value
FROM ({O.cache_sql(A)}) b GROUP BY _day
HAVING MIN(events) <> MAX(events) OR (COUNT_IF(events IS NULL) > 0 AND COUNT_IF(events IS NULL) < COUNT(*))""")(
    lambda spark, sf: AU.audit_independence(A_BAD, CH.materialize(spark, sf, A)))


# ---------------------------------------------------------------- sources, cache, refresh (SRC, SCH, REF)


@register("src_1", f"SELECT * FROM ({O.DUCK_CHARTS['activity']}) s WHERE event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
def _src_1(spark, sf):
    register_tables(spark, sf)
    return source_query(spark, A, D(2024, 1, 8), D(2024, 1, 14))


@register("sch_2", f"SELECT * FROM ({O.DUCK_CHARTS['cohort']}) s")
def _sch_2(spark, sf):
    register_tables(spark, sf)
    return C.normalize_types(source_query(spark, COH, *CH.ALL_TIME), COH)


register("src_3", f"SELECT *, event_date AS _day FROM ({O.DUCK_CHARTS['activity']}) s")(
    lambda spark, sf: CH.materialize(spark, sf, A))
register("ref_12", f"SELECT *, ship_date AS _day FROM ({O.DUCK_CHARTS['sales']}) s")(
    lambda spark, sf: CH.materialize(spark, sf, SALES))


def _root(spark, sf):
    CH.materialize(spark, sf, A)
    return CH.cache_root(spark, sf)


register("ref_2", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events")(
    lambda spark, sf: C.scan_cache(spark, _root(spark, sf), A).select(F.col("_day").alias("day")).where("day IS NOT NULL").distinct())
register("ref_10", "SELECT MIN(CAST(ts AS DATE)) AS date_min, MAX(CAST(ts AS DATE)) AS date_max FROM events")(
    lambda spark, sf: C.data_extent(spark, _root(spark, sf), A))


@register("ref_3", """WITH sp AS (SELECT CAST(g AS DATE) AS day FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) t(g))
SELECT day FROM sp WHERE day NOT IN (SELECT DISTINCT CAST(ts AS DATE) FROM events) OR day >= DATE '2024-02-02'""")
def _ref_3(spark, sf):
    cached = C.scan_cache(spark, _root(spark, sf), A).select(F.col("_day").alias("day"))
    cutoff = refresh_cutoff(D(2024, 2, 6), RF.REFRESH_WINDOW_DAYS)
    return RF.missing_days(cached, D(2023, 12, 25), D(2024, 2, 5), cutoff)


@register("ref_1", """WITH b AS (SELECT MIN(CAST(ts AS DATE)) AS from_date, MAX(CAST(ts AS DATE)) AS to_date FROM events)
SELECT from_date, to_date, CAST(g AS DATE) AS window_start, LEAST(CAST(g AS DATE) + 6, to_date) AS window_end
FROM b, generate_series(from_date, to_date, INTERVAL 7 DAY) t(g)""")
def _ref_1(spark, sf):
    register_tables(spark, sf)
    return date_windows(spark.sql("SELECT MIN(CAST(ts AS DATE)) AS from_date, MAX(CAST(ts AS DATE)) AS to_date FROM events"), 7)


OBM_REMAP = OBM.with_(derived=(OBM.derived[0], DerivedDim("priority_tier", "priority", (("Tier-1", ("1-URGENT", "2-HIGH", "3-MEDIUM")),), "Tier-2")))
register("drv_2", O.serve_sql(OBM_REMAP, DataRequest(granularity="month", dimensions=["priority_tier"], metrics=["orders"])))(
    lambda spark, sf: S.serve(OBM_REMAP, DataRequest(granularity="month", dimensions=["priority_tier"], metrics=["orders"]),
                              CH.materialize(spark, sf, OBM)))
serve_query("frm_3", A, DataRequest(granularity="week", dimensions=["event_type"], metrics=["value_per_user"]))


# ---------------------------------------------------------------- same jobs under their inventory aliases
for alias, key in {"join_2": "ref_3", "join_3": "ser_2", "join_4": "ser_6", "join_5": "dq_1", "ser_4": "win_2",
                   "srt_5": "win_3", "scl_2": "ser_1", "agg_5_pivot": "agg_5"}.items():
    REGISTRY[alias] = REGISTRY[key]

# ---------------------------------------------------------------- PRJ-4: ISO-text time column, served straight from the source
A_TEXT = A.with_(name="activity_text", query=f"SELECT CAST(event_date AS STRING) AS event_date, event_type, value, events, dau FROM ({A.query}) s")


@register("prj_4", O.serve_sql(A, DataRequest(granularity="week", dimensions=[], metrics=["events", "dau"])))
def _prj_4(spark, sf):
    register_tables(spark, sf)
    return S.serve(A_TEXT, DataRequest(granularity="week", dimensions=[], metrics=["events", "dau"]),
                   source_query(spark, A_TEXT, *CH.ALL_TIME))


# ---------------------------------------------------------------- SNK-1/2, REF-6/7: writes over a source that changes between runs
_TYPES_SQL = """SELECT CAST(ts AS DATE) AS event_date, event_type, SUM(value) AS value, COUNT(*) AS events
FROM {source} WHERE ts >= TIMESTAMP_NTZ'{{START_DATE}} 00:00:00' AND ts < TIMESTAMP_NTZ'{{END_DATE}} 00:00:00' + INTERVAL 1 DAY
GROUP BY CAST(ts AS DATE), event_type"""
_TYPES_DUCK = "SELECT CAST(ts AS DATE) AS event_date, event_type, SUM(value) AS value, COUNT(*) AS events FROM events GROUP BY ALL"
_METRICS = (Metric("value", column="value"), Metric("events", column="events"))


def _own_cache(spark, sf: str, key: str) -> str:
    """A folder that only this run of a query writes to."""
    register_tables(spark, sf)
    return f"{CH.cache_root(spark, sf)}/{key}-{uuid.uuid4().hex}"


def _types_chart(name: str, **kw) -> ChartSpec:
    base = dict(query=_TYPES_SQL.format(source=name), time_column="event_date", dims=(Dim("event_type"),), metrics=_METRICS, day_separable=True)
    return ChartSpec(name=name, **(base | kw))


def _ran(result: RF.RefreshResult) -> None:
    if result.status != "success":
        raise RuntimeError(result.error_message)


LOOK_BACK = ChartSpec(
    name="look_back", time_column="event_date", dims=(Dim("event_type"), Dim("batch_day")), metrics=(Metric("events", column="events"),),
    query="""SELECT CAST(ts AS DATE) AS event_date, event_type, '{START_DATE}' AS batch_day, COUNT(*) AS events FROM events
WHERE ts >= TIMESTAMP_NTZ'{START_DATE} 00:00:00' - INTERVAL 1 DAY AND ts < TIMESTAMP_NTZ'{END_DATE} 00:00:00' + INTERVAL 1 DAY
GROUP BY CAST(ts AS DATE), event_type""")


@register("snk_1", """WITH t AS (SELECT CAST(ts AS DATE) AS event_date, event_type, COUNT(*) AS events FROM events GROUP BY ALL),
b AS (SELECT CAST(g AS DATE) AS batch FROM (SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events) e, generate_series(lo, hi, INTERVAL 1 DAY) s(g))
SELECT t.event_date, t.event_type, CAST(b.batch AS VARCHAR) AS batch_day, t.events, t.event_date AS _day
FROM t JOIN b ON t.event_date = b.batch OR t.event_date = b.batch - 1""")
def _snk_1(spark, sf):
    """Append: a day's batch also holds rows of the day before, which are added
    to what that day has, in the same run and in a later one."""
    root = _own_cache(spark, sf, "snk_1")
    lo, hi = CH.source_extent(spark, A)
    middle = lo + (hi - lo) // 2
    late = hi + _dt.timedelta(days=60)  # no day lies in the trailing window
    _ran(RF.refresh(spark, root, LOOK_BACK, lo, middle, today=late, record=False))
    _ran(RF.refresh(spark, root, LOOK_BACK, middle + _dt.timedelta(days=1), hi, today=late, record=False, windows_per_write=7))
    return C.scan_cache(spark, root, LOOK_BACK)


@register("snk_2", f"""WITH t AS ({_TYPES_DUCK}), m AS (SELECT MIN(event_date) + 9 AS a, MIN(event_date) + 12 AS b FROM t)
SELECT t.*, event_date AS _day FROM t, m WHERE event_type <> 'click' OR event_date NOT BETWEEN a AND b
UNION ALL SELECT NULL, 'no day', v, CAST(v AS BIGINT), NULL FROM (VALUES (1.0), (2.0)) n(v)""")
def _snk_2(spark, sf):
    """Replace: the window's days are cleared and written anew from a source
    without clicks; other days stay, and rows without a day are only added."""
    root = _own_cache(spark, sf, "snk_2")
    chart = _types_chart("snk_2", cur_date_behavior="batched", cache_strategy="replace")
    chart = chart.with_(query=chart.query + " UNION ALL SELECT CAST(NULL AS DATE), 'no day', CAST(n AS DOUBLE), n FROM snk_2_run")
    lo, hi = CH.source_extent(spark, A)
    events = spark.table("events")
    for run, (source, window) in enumerate((
        (events, (lo, hi)), (events.filter("event_type <> 'click'"), (lo + _dt.timedelta(days=9), lo + _dt.timedelta(days=12)))), 1):
        source.createOrReplaceTempView("snk_2")
        spark.range(run, run + 1).select(F.col("id").alias("n")).createOrReplaceTempView("snk_2_run")
        _ran(RF.refresh(spark, root, chart, *window, today=hi, batch_size=40, record=False))
    return C.scan_cache(spark, root, chart)


@register("ref_6", f"""WITH t AS ({_TYPES_DUCK}), m AS (SELECT MAX(event_date) AS hi FROM t)
SELECT t.*, event_date AS _day FROM t, m WHERE event_date < hi - 3 OR event_date > hi - 2 OR event_type = 'click'""")
def _ref_6(spark, sf):
    """A daily refresh replaces the days of the trailing window that it finds
    (clicks only, the second time) and keeps those that come back empty."""
    root, chart = _own_cache(spark, sf, "ref_6"), _types_chart("ref_6")
    lo, hi = CH.source_extent(spark, A)
    events = spark.table("events")
    last = hi - _dt.timedelta(days=1)
    for source in (events, events.filter((F.col("event_type") == "click") & (F.to_date("ts") < F.lit(last)))):
        source.createOrReplaceTempView("ref_6")
        _ran(RF.refresh(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=1), record=False))
    return C.scan_cache(spark, root, chart)


@register("ref_7", f"""WITH t AS ({_TYPES_DUCK}), m AS (SELECT MIN(event_date) + 9 AS a FROM t)
SELECT t.*, event_date AS _day FROM t, m WHERE event_date NOT BETWEEN a AND a + 2 OR (event_date <> a + 1 AND event_type <> 'click')""")
def _ref_7(spark, sf):
    """A restatement of three days writes them anew and clears the one that is
    now empty; it leaves the others alone."""
    root, chart = _own_cache(spark, sf, "ref_7"), _types_chart("ref_7")
    lo, hi = CH.source_extent(spark, A)
    a = lo + _dt.timedelta(days=9)
    events = spark.table("events")
    events.createOrReplaceTempView("ref_7")
    _ran(RF.refresh(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False))
    now_empty = F.to_date("ts") == F.lit(a + _dt.timedelta(days=1))
    events.filter((F.col("event_type") != "click") & ~now_empty).createOrReplaceTempView("ref_7")
    _ran(RF.restate(spark, root, chart, a, a + _dt.timedelta(days=2), today=hi + _dt.timedelta(days=60), record=False))
    return C.scan_cache(spark, root, chart)


_COUNTS = dict(dims=(Dim("event_type"),), metrics=(Metric("events", column="events"),),
               query="""SELECT CAST(ts AS DATE) AS event_date, event_type, COUNT(*) AS events
FROM {source} WHERE ts >= TIMESTAMP_NTZ'{{START_DATE}} 00:00:00' AND ts < TIMESTAMP_NTZ'{{END_DATE}} 00:00:00' + INTERVAL 1 DAY
GROUP BY CAST(ts AS DATE), event_type""")


def _counts_chart(name: str, **kw) -> ChartSpec:
    return _types_chart(name, **(_COUNTS | {"query": _COUNTS["query"].format(source=name)} | kw))


def _late_click(column: str) -> str:
    """Clicks of every third day, which come late."""
    return f"event_type = 'click' AND dayofyear(CAST({column} AS DATE)) % 3 = 0"


_CHANGING = f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, bool_or({_late_click('ts')}) AS late FROM events GROUP BY 1),
m AS (SELECT MIN(day) AS lo, MAX(day) AS hi FROM d)
SELECT day, CASE WHEN day = lo + 4 THEN '{{gone}}' WHEN day = hi THEN 'new' WHEN late THEN 'restated' ELSE 'unchanged' END AS state FROM d, m"""


def _changing_source(spark, sf, name: str, **kw):
    """A cache filled before the last day and the late clicks were there; then
    the source has both, and lost its fifth day. Returns root, chart, extent."""
    root, chart = _own_cache(spark, sf, name), _counts_chart(name, **kw)
    lo, hi = CH.source_extent(spark, A)
    events, day = spark.table("events"), F.to_date("ts")
    events.filter(~F.expr(_late_click("ts")) & (day < F.lit(hi))).createOrReplaceTempView(name)
    _ran(RF.refresh(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False))
    events.filter(day != F.lit(lo + _dt.timedelta(days=4))).createOrReplaceTempView(name)
    return root, chart, lo, hi


@register("ref_7_states", _CHANGING.format(gone="cleared"))
def _ref_7_states(spark, sf):
    """What a restatement of the whole extent did with each day: unchanged ones
    keep their files."""
    root, chart, lo, hi = _changing_source(spark, sf, "ref_7_states")
    result = RF.restate(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False)
    _ran(result)
    return M.day_states(spark, result.day_states)


@register("ref_6_states", f"SELECT * FROM ({_CHANGING.format(gone='kept')}) s WHERE day >= (SELECT MAX(CAST(ts AS DATE)) - 29 FROM events)")
def _ref_6_states(spark, sf):
    """What a daily refresh did with the days of its trailing window, here of
    thirty days: a day that comes back empty is kept."""
    root, chart, lo, hi = _changing_source(spark, sf, "ref_6_states")
    result = RF.refresh(spark, root, chart, lo, hi, today=hi, refresh_window_days=30, record=False)
    _ran(result)
    return M.day_states(spark, result.day_states)


@register("snk_2_pinned", """SELECT 'before' AS reader, CAST(ts AS DATE) AS day, COUNT(*) AS events FROM events, (SELECT MAX(CAST(ts AS DATE)) AS hi FROM events) m
WHERE CAST(ts AS DATE) < hi AND NOT (""" + _late_click("ts") + """) GROUP BY 2
UNION ALL SELECT 'after', CAST(ts AS DATE), COUNT(*) FROM events, (SELECT MIN(CAST(ts AS DATE)) AS lo FROM events) m WHERE CAST(ts AS DATE) <> lo + 4 GROUP BY 2""")
def _snk_2_pinned(spark, sf):
    """Two readers of one cache, packed by month: one that began before its
    windows were replaced, and one that began after."""
    root, chart, lo, hi = _changing_source(spark, sf, "snk_2_pinned", small_days=True)
    before = C.scan_cache(spark, root, chart)
    _ran(RF.restate(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False))
    C.clean_up(spark, root, chart)  # the version before stays: two are kept
    total = lambda name, df: df.groupBy(F.lit(name).alias("reader"), F.col("_day").alias("day")).agg(F.sum("events").alias("events"))
    return total("before", before).unionByName(total("after", C.scan_cache(spark, root, chart)))


# ---------------------------------------------------------------- AGG-3: stored roll-ups
def _rolled_up(spark, sf: str, name: str, **kw):
    """A chart of daily activity with roll-ups, made before the last day and the late
    clicks were there; then its source has both. Returns root, chart, extent."""
    root, chart = _own_cache(spark, sf, name), A.with_(name=name, query=A.query.replace("FROM events", f"FROM {name}"), **kw)
    lo, hi = CH.source_extent(spark, A)
    events = spark.table("events")
    events.filter(~F.expr(_late_click("ts")) & (F.to_date("ts") < F.lit(hi))).createOrReplaceTempView(name)
    _ran(RF.refresh(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False))
    RU.update(spark, root, chart, RU.LEVELS)
    events.createOrReplaceTempView(name)
    return root, chart, lo, hi


_ROLLED_WEEKS = DataRequest(granularity="week", dimensions=["event_type"])
_ROLLED_TYPES = DataRequest(x_axis="event_type", filters={"event_type": ["click", "view", "purchase"]})


@register("agg_3_rollup", O.serve_sql(A, _ROLLED_WEEKS))
def _agg_3_rollup(spark, sf):
    """Weeks, read from roll-ups that a restatement brought up to date."""
    root, chart, lo, hi = _rolled_up(spark, sf, "agg_3_rollup", rollups=RU.LEVELS)
    _ran(RF.restate(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False))
    return RU.serve_cached(spark, root, chart, _ROLLED_WEEKS)


@register("agg_3_rollup_behind", O.serve_sql(A, _ROLLED_TYPES))
def _agg_3_rollup_behind(spark, sf):
    """A pivot while the roll-ups are behind their cache, which was restated
    without them: fresh weeks are read from them, the other days from the cache."""
    root, chart, lo, hi = _rolled_up(spark, sf, "agg_3_rollup_behind")
    middle = lo + (hi - lo) // 2
    _ran(RF.restate(spark, root, chart, lo, middle, today=hi + _dt.timedelta(days=60), record=False))
    RU.update(spark, root, chart, RU.LEVELS)
    _ran(RF.restate(spark, root, chart, middle, hi, today=hi + _dt.timedelta(days=60), record=False))
    return RU.serve_cached(spark, root, chart, _ROLLED_TYPES)


@register("agg_3_rollup_states", f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, bool_or({_late_click('ts')}) AS late FROM events GROUP BY 1),
l AS (SELECT day, late, unnest(['week', 'month']) AS level FROM d), m AS (SELECT MAX(day) AS hi FROM d),
b AS (SELECT level, CAST(CASE WHEN level = 'week' THEN date_trunc('week', day) ELSE date_trunc('month', day) END AS DATE) AS bucket, day, late FROM l)
SELECT level, bucket, CASE WHEN MIN(day) = MAX(hi) THEN 'new' WHEN bool_or(late OR day = hi) THEN 'remade' ELSE 'unchanged' END AS state
FROM b, m GROUP BY level, bucket""")
def _agg_3_rollup_states(spark, sf):
    """What an update did with each bucket after a restatement of all days."""
    root, chart, lo, hi = _rolled_up(spark, sf, "agg_3_rollup_states")
    _ran(RF.restate(spark, root, chart, lo, hi, today=hi + _dt.timedelta(days=60), record=False))
    return RU.update_states(spark, RU.update(spark, root, chart, RU.LEVELS))


_ROLLED_ORDERS = DataRequest(D(1994, 3, 10), D(1997, 8, 20), "month", dimensions=["region", "segment"], filters={"priority_tier": ["Tier-1"]})


@register("agg_3_rollup_orders", O.serve_sql(OBM, _ROLLED_ORDERS))
def _agg_3_rollup_orders(spark, sf):
    """Months of a range that begins and ends inside one: whole months and weeks
    from roll-ups, a few days from the cache."""
    CH.materialize(spark, sf, OBM)
    root = CH.cache_root(spark, sf)
    RU.update(spark, root, OBM, RU.LEVELS)
    return RU.serve_cached(spark, root, OBM, _ROLLED_ORDERS)


# ---------------------------------------------------------------- REF-8 rebuild on a changed definition
REBUILD_V1 = CH.ACTIVITY_TYPES.with_(name="activity_rebuild")
REBUILD_V2 = REBUILD_V1.with_(variables={"TYPES": ["purchase"]})


@register("ref_8", f"SELECT *, event_date AS _day FROM ({O.DUCK_CHARTS['activity_types'].replace(chr(39) + 'click' + chr(39) + ', ' + chr(39) + 'view' + chr(39), chr(39) + 'purchase' + chr(39))}) s")
def _ref_8(spark, sf):
    root = _own_cache(spark, sf, "ref_8")
    lo, hi = CH.source_extent(spark, A)
    for spec in (REBUILD_V1, REBUILD_V2):
        _ran(RF.refresh(spark, root, spec, lo, hi, today=hi + _dt.timedelta(days=1), record=False))
    return C.scan_cache(spark, root, REBUILD_V2)


# ---------------------------------------------------------------- SNK-4: wide CSV export of the kept series, read back
@register("snk_4", f"""{_TOP_SER_SQL}
SELECT CAST(x AS VARCHAR) AS date, combo AS series, value FROM s WHERE metric = 'orders' AND value IS NOT NULL AND combo IN (SELECT combo FROM keep)""")
def _snk_4(spark, sf):
    """The wide file read back, and turned long again."""
    kept = SR.top_series(_top_input(spark, sf), 20, by_metric="orders").where(F.col("metric") == "orders")
    labels = [r["combo"] for r in kept.select("combo").distinct().orderBy("combo").collect()]  # 20 at most
    path = f"{CH.cache_root(spark, sf)}/exports/{uuid.uuid4().hex}"
    C.export_csv(SR.to_wide(kept.drop("country"), labels, multi_metric=False), path)
    wide = spark.read.option("header", True).csv(path)
    return wide.unpivot(["date"], labels, "series", "value").where("value IS NOT NULL").withColumn("value", F.col("value").cast("double"))


# ---------------------------------------------------------------- run ledger (REF-14..16, WIN-4)

LEDGER_WINDOW = (D(2024, 1, 8), D(2024, 1, 14))
_LEDGER_COUNT = (f"(SELECT COUNT(*) FROM ({O.DUCK_CHARTS['activity']}) s "
                 f"WHERE event_date BETWEEN DATE '{LEDGER_WINDOW[0]}' AND DATE '{LEDGER_WINDOW[1]}')")


def _recorded_run(spark, sf):
    """A recorded restatement of one week in a cache of its own; returns (root,
    ledger rows of that run)."""
    root = _own_cache(spark, sf, "ledger")
    lo, hi = CH.source_extent(spark, A)
    _ran(RF.refresh(spark, root, A, lo, hi, today=hi + _dt.timedelta(days=1), record=False))
    res = RF.restate(spark, root, A, *LEDGER_WINDOW, today=D(2024, 2, 1), record=True)
    _ran(res)
    return root, L.read_runs(spark, root).where(F.col("run_id") == F.lit(res.run_id))


_RUN_COLS = ["chart", "from_date", "to_date", "status", "row_count", "batches_completed", "force"]
_RUN_SQL = (f"SELECT 'activity' AS chart, DATE '{LEDGER_WINDOW[0]}' AS from_date, DATE '{LEDGER_WINDOW[1]}' AS to_date, "
            f"'success' AS status, CAST({_LEDGER_COUNT} AS BIGINT) AS row_count, 7 AS batches_completed, TRUE AS force")


@register("ref_14", _RUN_SQL)
def _ref_14(spark, sf):
    _, run = _recorded_run(spark, sf)
    return L.current_runs(run).select(*_RUN_COLS)


@register("win_4", _RUN_SQL)
def _win_4(spark, sf):
    root, _ = _recorded_run(spark, sf)
    return L.latest_per_chart(L.current_runs(L.read_runs(spark, root))).where(F.col("chart") == "activity").select(*_RUN_COLS)


@register("ref_15", f"SELECT 'activity' AS chart, 'failed' AS status, CAST(0 AS BIGINT) AS row_count "
                    f"UNION ALL SELECT 'activity', 'success', CAST({_LEDGER_COUNT} AS BIGINT)")
def _ref_15(spark, sf):
    _, run = _recorded_run(spark, sf)
    return L.mark_stale_runs(run, _dt.datetime(2999, 1, 1), 120).select("chart", "status", "row_count")


@register("ref_16", f"""SELECT 'activity' AS chart, MAX(CAST(ts AS DATE)) AS latest_day, 'success' AS last_status,
  CAST({_LEDGER_COUNT} AS BIGINT) AS last_row_count, FALSE AS any_running FROM events""")
def _ref_16(spark, sf):
    root, _ = _recorded_run(spark, sf)
    latest = C.data_extent(spark, root, A).select(F.lit("activity").alias("chart"), F.col("date_max").alias("latest_day"))
    fresh = L.freshness(L.current_runs(L.read_runs(spark, root)), latest)
    return fresh.where(F.col("chart") == "activity").select("chart", "latest_day", "last_status", "last_row_count", "any_running")


REGISTRY["snk_3"] = REGISTRY["ref_8"]


# ---------------------------------------------------------------- AGG-6 wide cohort view

COHORT_REQ = DataRequest(x_axis="install_date", dimensions=["days_since_install"], metrics=["retained_users"])
SPLIT_DAYS = [str(d) for d in range(30)]
_WIDE = ", ".join(f'MAX(CASE WHEN days_since_install = {d} THEN retained_users END) AS "{d}"' for d in SPLIT_DAYS)
register("agg_6_wide", f"SELECT install_date, {_WIDE} FROM ({O.serve_sql(COH, COHORT_REQ)}) r GROUP BY install_date")(
    lambda spark, sf: cohort_view(COH, COHORT_REQ, CH.materialize(spark, sf, COH), "retained_users", SPLIT_DAYS))


# ---------------------------------------------------------------- SER-6 by month (previous month, same month last year)
SALES_MONTH_REQ = DataRequest(granularity="month", dimensions=["linestatus"], metrics=["revenue"])


def _sales_monthly(spark, sf):
    rows = S.serve(SALES, SALES_MONTH_REQ, CH.materialize(spark, sf, SALES))
    s = SR.to_series(rows, "ship_date", ["l_linestatus"], ["revenue"])
    return SR.deltas(SR.fill_gaps(s, *SALES_SPAN, "month"), "month")


register("ser_6_month", f"""WITH r AS ({O.serve_sql(SALES, SALES_MONTH_REQ)}),
s AS (SELECT ship_date AS x, COALESCE(CAST(l_linestatus AS VARCHAR), '∅') AS combo, 'revenue' AS metric, CAST(revenue AS DOUBLE) AS value FROM r),
k AS (SELECT DISTINCT metric, combo FROM s),
sp AS (SELECT CAST(g AS DATE) AS x FROM generate_series(DATE '1992-01-01', DATE '1999-12-01', INTERVAL 1 MONTH) t(g)),
grid AS (SELECT k.metric, k.combo, sp.x, s.value FROM k CROSS JOIN sp LEFT JOIN s ON s.metric = k.metric AND s.combo = k.combo AND s.x = sp.x)
SELECT g.metric, g.combo, g.x, g.value,
  {_PCT.format(n='g.value', t='p1.value')} AS short_pct, {_PCT.format(n='g.value', t='p12.value')} AS long_pct
FROM grid g
LEFT JOIN grid p1 ON p1.metric = g.metric AND p1.combo = g.combo AND p1.x = CAST(g.x - INTERVAL 1 MONTH AS DATE)
LEFT JOIN grid p12 ON p12.metric = g.metric AND p12.combo = g.combo AND p12.x = CAST(g.x - INTERVAL 12 MONTH AS DATE)""")(_sales_monthly)


# ---------------------------------------------------------------- WIN-1 on a dashboard widget: over the dates returned
WIDGET_MA_REQ = DataRequest(dimensions=["region"], metrics=["orders"])


def _widget_ma(spark, sf):
    rows = S.serve(OBM, WIDGET_MA_REQ, CH.materialize(spark, sf, OBM))
    return SR.moving_average(SR.fill_axis(SR.to_series(rows, "order_date", ["region"], ["orders"])), 7)


register("win_1_widget", f"""WITH r AS ({O.serve_sql(OBM, WIDGET_MA_REQ)}),
s AS (SELECT order_date AS x, COALESCE(region, '∅') AS combo, 'orders' AS metric, CAST(orders AS DOUBLE) AS value FROM r),
grid AS (SELECT k.metric, k.combo, a.x, s.value FROM (SELECT DISTINCT metric, combo FROM s) k
         CROSS JOIN (SELECT DISTINCT x FROM s) a LEFT JOIN s ON s.metric = k.metric AND s.combo = k.combo AND s.x = a.x)
SELECT metric, combo, x, AVG(value) OVER (PARTITION BY metric, combo ORDER BY x ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS value
FROM grid""")(_widget_ma)


# ---------------------------------------------------------------- SCH-4, REF-5, REF-6, REF-9 on the driver tables
@register("sch_4", f"""SELECT event_date, event_type, value, events, CAST(NULL AS BIGINT) AS dau, event_date AS _day
FROM ({O.DUCK_CHARTS['activity']}) s""")
def _sch_4(spark, sf):
    root = _root(spark, sf)
    register_tables(spark, sf)
    stored = C.stored_schema(C.read_meta(spark, root, A))
    batch = C.with_day(source_query(spark, A, *CH.ALL_TIME).drop("dau"), A)
    return C.align_columns(batch, stored)


@register("ref_5", """WITH b AS (SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events)
SELECT CAST(g AS DATE) AS window_start, CAST(g AS DATE) AS window_end,
       CASE WHEN CAST(g AS DATE) >= hi - 3 THEN 'replace' ELSE 'append' END AS strategy, FALSE AS forced
FROM b, generate_series(lo, hi, INTERVAL 1 DAY) t(g)
UNION ALL SELECT CAST(g AS DATE), CAST(g AS DATE), 'replace', TRUE FROM b, generate_series(lo, hi, INTERVAL 1 DAY) t(g)""")
def _ref_5(spark, sf):
    """What a first and a forced refresh do with each day, as ``plan_writes``
    hands it to the writer."""
    register_tables(spark, sf)
    lo, hi = CH.source_extent(spark, A)
    daily = A.with_(day_separable=False)
    cutoff = refresh_cutoff(hi + _dt.timedelta(days=1), RF.REFRESH_WINDOW_DAYS)
    rows = []
    for forced in (False, True):
        for w in RF.plan_writes(daily, lo, hi, 1, set(), cutoff, forced):
            rows += [(a, b, "replace" if (a, b) in w.replace else "append", forced) for a, b in w.windows]
    return spark.createDataFrame(rows, "window_start date, window_end date, strategy string, forced boolean")


A_TEXT_METRIC = A.with_(
    name="activity_heal",
    metrics=tuple(m for m in A.metrics if m.name not in ("dau", "value_per_user")),
    query=A.query.replace("SUM(new_users) OVER (PARTITION BY event_date) AS dau",
                          "CAST(SUM(new_users) OVER (PARTITION BY event_date) AS STRING) AS dau"),
)
A_HEALED = A.with_(name="activity_heal", query=A_TEXT_METRIC.query)


@register("ref_9", f"SELECT event_date, event_type, value, events, CAST(dau AS DOUBLE) AS dau, event_date AS _day "
                   f"FROM ({O.DUCK_CHARTS['activity']}) s")
def _ref_9(spark, sf):
    """A cache whose dau column was stored as text (dau not declared then) is
    healed when dau is declared: dropped and rebuilt over its whole extent."""
    root = _own_cache(spark, sf, "ref_9")
    lo, hi = CH.source_extent(spark, A)
    first = RF.refresh(spark, root, A_TEXT_METRIC, lo, hi, today=hi + _dt.timedelta(days=1), record=False)
    if C.poisoned_metrics(spark, root, A_HEALED) != ["dau"]:
        raise RuntimeError("expected a poisoned dau column")
    healed = RF.refresh(spark, root, A_HEALED, hi, hi, today=hi + _dt.timedelta(days=1), record=False)
    if first.status != "success" or healed.status != "success" or healed.from_date != lo:
        raise RuntimeError(f"heal did not rebuild the extent: {healed}")
    return C.scan_cache(spark, root, A_HEALED)


# ---------------------------------------------------------------- WIN-3 on a dashboard widget: each metric x combo series on its own total
register("win_3_widget", f"""{_TOP_SER_SQL},
st AS (SELECT metric, combo, SUM(COALESCE(value, 0)) AS total FROM s GROUP BY 1, 2),
kw AS (SELECT metric, combo FROM st ORDER BY total DESC, metric, {O.natural_sql('combo')}, combo LIMIT 20)
SELECT s.* FROM s JOIN kw ON s.metric = kw.metric AND s.combo = kw.combo""")(
    lambda spark, sf: SR.top_series(_top_input(spark, sf), 20))


# ---------------------------------------------------------------- REF-13 nightly run over several charts (forced, so the counts are fixed)
NIGHTLY_TODAY = D(2024, 1, 31)


@register("ref_13", f"""SELECT 'activity' AS chart, DATE '2024-01-01' AS from_date, DATE '2024-01-30' AS to_date, 'success' AS status,
  (SELECT COUNT(*) FROM ({O.DUCK_CHARTS['activity']}) s WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') AS row_count,
  30 AS batches_completed, CAST(NULL AS VARCHAR) AS error_message
UNION ALL
SELECT 'cohort', DATE '2024-01-24', DATE '2024-01-30', 'success',
  (SELECT COUNT(*) FROM ({O.DUCK_CHARTS['cohort']}) s WHERE event_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'),
  7, CAST(NULL AS VARCHAR)""")
def _ref_13(spark, sf):
    root = _own_cache(spark, sf, "ref_13")
    return RF.refresh_all(spark, root, [A, COH, SALES.with_(refresh_interval="manual")], NIGHTLY_TODAY, max_workers=2, force=True, record=False)


# ---------------------------------------------------------------- operators on definitions and schemas, as frames computed from the tables
MARKED = A.with_(name="activity_marked", query=A.query.replace("TIMESTAMP_NTZ'{START_DATE} 00:00:00'", "CAST(:start_date AS TIMESTAMP_NTZ)")
                 .replace("TIMESTAMP_NTZ'{END_DATE} 00:00:00'", "CAST(:end_date AS TIMESTAMP_NTZ)"))


@register("src_4", f"SELECT * FROM ({O.DUCK_CHARTS['activity']}) s WHERE event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27'")
def _src_4(spark, sf):
    """The source query with typed date parameters in place of text."""
    register_tables(spark, sf)
    return source_query(spark, MARKED, D(2024, 1, 3), D(2024, 1, 27))


@register("sch_1", """SELECT table_name, column_name,
  CASE WHEN data_type IN ('DATE', 'TIMESTAMP') AND rank = 1 THEN 'time' WHEN data_type IN ('DATE', 'TIMESTAMP', 'VARCHAR') THEN 'dimension' ELSE 'metric' END AS role
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name, data_type IN ('DATE', 'TIMESTAMP') ORDER BY position) AS rank FROM (
  SELECT 'orders' AS table_name, column_name, column_type AS data_type, ROW_NUMBER() OVER () AS position FROM (DESCRIBE orders)
  UNION ALL SELECT 'lineitem', column_name, column_type, ROW_NUMBER() OVER () FROM (DESCRIBE lineitem)
  UNION ALL SELECT 'events', column_name, column_type, ROW_NUMBER() OVER () FROM (DESCRIBE events)) d) c""")
def _sch_1(spark, sf):
    register_tables(spark, sf)
    rows = []
    for name in ("orders", "lineitem", "events"):
        time, dims, metrics = classify_columns(spark.table(name).schema)
        rows += [(name, c, role) for role, columns in (("time", [time] if time else []), ("dimension", dims), ("metric", metrics)) for c in columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, role string")


@register("sch_3", "SELECT 'activity_heal' AS chart, 'dau' AS column_name")
def _sch_3(spark, sf):
    """A metric that the cache holds as text."""
    root = _own_cache(spark, sf, "sch_3")
    lo, hi = CH.source_extent(spark, A)
    _ran(RF.refresh(spark, root, A_TEXT_METRIC, lo, hi, today=hi + _dt.timedelta(days=1), record=False))
    rows = [(spec.name, c) for spec in (A_TEXT_METRIC, A_HEALED) for c in C.poisoned_metrics(spark, root, spec)]
    return spark.createDataFrame(rows, "chart string, column_name string")


@register("ref_4", """SELECT n AS window_days, CAST(hi - (GREATEST(n, 1) - 1) AS DATE) AS cutoff
FROM (SELECT MAX(CAST(ts AS DATE)) AS hi FROM events) e, (VALUES (0), (1), (5), (40)) w(n)""")
def _ref_4(spark, sf):
    register_tables(spark, sf)
    _, hi = CH.source_extent(spark, A)
    return spark.createDataFrame([(n, refresh_cutoff(hi, n)) for n in (0, 1, 5, 40)], "window_days int, cutoff date")


@register("ref_11", """SELECT chart, CAST(hi - (days - 1) AS DATE) AS from_date, hi AS to_date, size AS batch_size
FROM (SELECT MAX(CAST(ts AS DATE)) AS hi FROM events) e, (VALUES ('activity', 30, 30), ('sales', 7, 365), ('cohort', 7, 30)) c(chart, days, size)""")
def _ref_11(spark, sf):
    register_tables(spark, sf)
    _, hi = CH.source_extent(spark, A)
    return spark.createDataFrame([(s.name, *RF.resolve_run_range(s, None, None, hi)) for s in (A, SALES, COH)],
                                 "chart string, from_date date, to_date date, batch_size int")


@register("dsh_1", """SELECT name, CAST(COALESCE(f, e - 29) AS DATE) AS from_date, e AS to_date FROM (
  SELECT name, f, CAST(LEAST(COALESCE(t, hi), hi - o) AS DATE) AS e FROM (SELECT MAX(CAST(ts AS DATE)) AS hi FROM events) m,
  (VALUES ('default', NULL, NULL, 2), ('widget', NULL, NULL, 0), ('viewer', NULL, NULL, 4), ('picked', DATE '2024-01-03', DATE '2024-01-09', 2)) w(name, f, t, o)) x""")
def _dsh_1(spark, sf):
    register_tables(spark, sf)
    _, hi = CH.source_extent(spark, A)
    cases = {"default": (None, None, None, None), "widget": (0, None, None, 4), "viewer": (None, None, None, 4),
             "picked": (None, D(2024, 1, 3), D(2024, 1, 9), None)}
    rows = [(name, *DB.resolve_window(DASH, *case, hi)) for name, case in cases.items()]
    return spark.createDataFrame(rows, "name string, from_date date, to_date date")


_DSH7_STATE = DB.DashboardState(today=TODAY, from_date=D(2024, 1, 10), filters={"event_type": ["click", "view"]})
_DSH7_ROWS = O.serve_sql(A, DataRequest(from_date=D(2024, 1, 10), to_date=D(2024, 1, 30), dimensions=[], metrics=["events"],
                                        filters={"event_type": ["click", "view"]}))
_DSH7_CLICK = O.serve_sql(A, DataRequest(from_date=D(2024, 1, 10), to_date=D(2024, 1, 30), dimensions=[], metrics=["value", "dau"],
                                         filters={"event_type": ["click"]}))


@register("dsh_7", f"""SELECT 'w_split' AS widget, event_date AS day, 'events' AS metric, CAST(events AS DOUBLE) AS value FROM ({_DSH7_ROWS}) a
UNION ALL SELECT 'w_value', event_date, 'value', CAST(value AS DOUBLE) FROM ({_DSH7_CLICK}) b
UNION ALL SELECT 'w_value', event_date, 'dau', CAST(dau AS DOUBLE) FROM ({_DSH7_CLICK}) c
UNION ALL SELECT 't_dau', DATE '2024-01-30', 'value', MAX(CAST(dau AS DOUBLE)) FROM ({_TILE_ROWS}) t WHERE event_date = DATE '2024-01-30'""")
def _dsh_7(spark, sf):
    """All widgets of a dashboard under one state, as one long frame."""
    board = DB.Dashboard("activity", (W_VALUE, W_SPLIT, W_EMPTY, T_DAU), filters=("event_type",))
    rows = DB.dashboard_rows(board, {A.name: CH.materialize(spark, sf, A)}, _DSH7_STATE)
    rows = rows.where("widget <> 't_dau' OR metric = 'value'")
    return rows.select("widget", F.col("x").cast("date").alias("day"), "metric", "value")


def _board_sql(widget: str, x: str, combo: str, metrics: list[str], rows: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{widget}' AS widget, CAST({x} AS VARCHAR) AS x, {combo} AS combo, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({rows}) r" for m in metrics)


_BOARD_TILE = ["value", "previous_day_abs", "previous_day_pct", "last_week_abs", "last_week_pct"]
_T_EMPTY = DB.NumberTile("t_empty", A, "events", filters={"event_type": ["purchase"]}, compares=())


@register("dsh_7_board", " UNION ALL ".join((
    _board_sql("w_value", "event_date", "event_type", ["value", "dau"], REGISTRY["dsh_2"][1]),
    _board_sql("w_split", "event_date", "event_type", ["events"], REGISTRY["dsh_3"][1]),
    _board_sql("w_cohort", "install_date", "''", ["installs"], REGISTRY["dsh_4"][1]),
    _board_sql("t_dau", "as_of_date", "''", _BOARD_TILE, REGISTRY["dsh_5"][1]),
    "SELECT 't_empty', '2024-01-30', '', 'value', CAST(NULL AS DOUBLE)")))
def _dsh_7_board(spark, sf):
    """A whole dashboard of two charts, split and filtered by the viewer: time
    series, a pivot, a tile with its deltas, a tile without rows."""
    board = DB.Dashboard(DASH.name, (*DASH.widgets, _T_EMPTY), filters=DASH.filters)
    return DB.dashboard_rows(board, {c.name: CH.materialize(spark, sf, c) for c in (A, COH)}, STATE)


def _grain_audit(spec: ChartSpec):
    """Groups with several rows: none by the declared dimensions, which lets
    serving skip its inner MAX; some once the last dimension is left out."""
    fewer = spec.with_(dims=spec.dims[:-1], metrics=(), derived=())

    def run(spark, sf):
        cache = CH.materialize(spark, sf, spec)
        parts = [AU.audit_unique_grain(s, cache).select(F.lit(n).alias("dims"), "day", "rows") for n, s in (("all", spec.with_(derived=(), metrics=())), ("fewer", fewer))]
        return parts[0].unionByName(parts[1])

    return run


VIEW_REQ = DataRequest(from_date=D(2024, 1, 2), to_date=D(2024, 1, 25), dimensions=["days_since_install"], metrics=["retained_users"])
_VIEW_SQL = O.serve_sql(COH, DataRequest(from_date=D(2024, 1, 2), to_date=D(2024, 1, 25), x_axis="install_date",
                                         dimensions=["days_since_install"], metrics=["retained_users"]))


@register("chart_view", f"""WITH r AS ({_VIEW_SQL}),
s AS (SELECT install_date AS x, CAST(days_since_install AS VARCHAR) AS combo, CAST(retained_users AS DOUBLE) AS value FROM r
      WHERE install_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-25'),
k AS (SELECT combo FROM s GROUP BY combo ORDER BY SUM(COALESCE(value, 0)) DESC, CAST(combo AS INTEGER) LIMIT 8),
m AS (SELECT combo, x, AVG(value) OVER (PARTITION BY combo ORDER BY x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value
      FROM s WHERE combo IN (SELECT combo FROM k) AND combo <> '1'),
rk AS (SELECT combo, CAST(ROW_NUMBER() OVER (ORDER BY CAST(combo AS INTEGER)) AS INTEGER) AS series_rank FROM (SELECT DISTINCT combo FROM m) d)
SELECT 'retained_users' AS metric, m.combo, m.x, m.value, rk.series_rank FROM m JOIN rk USING (combo)""")
def _chart_view(spark, sf):
    """A chart's page on its saved axis: served, clamped, the largest 8 of its
    series kept, one hidden, averaged and ranked; with an empty selection
    nothing."""
    cache = CH.materialize(spark, sf, COH)
    shown, _ = CV.chart_view(COH, VIEW_REQ, cache, CV.ViewOptions(cap=8, hidden=("1",), moving_average=3))
    nothing = DataRequest(from_date=D(2024, 1, 2), to_date=D(2024, 1, 25), dimensions=["days_since_install"], metrics=["retained_users"],
                          filters={"days_since_install": []})
    return shown.unionByName(CV.chart_view(COH, nothing, cache, CV.ViewOptions(cap=8))[0])


for _spec in (A, SALES, OBM, COH):
    _by = {n: ", ".join(["_day", *(d.col for d in dims)]) for n, dims in (("all", _spec.dims), ("fewer", _spec.dims[:-1]))}
    register(f"dq_grain_{_spec.name}", " UNION ALL ".join(
        f"SELECT '{n}' AS dims, _day AS day, COUNT(*) AS rows FROM ({O.cache_sql(_spec)}) b GROUP BY {by} HAVING COUNT(*) > 1"
        for n, by in _by.items()))(_grain_audit(_spec))
