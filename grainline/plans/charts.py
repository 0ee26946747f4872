"""Chart definitions over the driver's tables.

Each source query is Spark SQL over registered views and is already
aggregated to one row per (day x dims) - the precondition of serving (T1).
Date tokens bound per window keep the scan pushed down to parquet.
"""

from __future__ import annotations

import datetime as _dt
import threading

from ..session import register_tables, shared_root, source_version
from ..sources.cache import cache_exists, scan_cache
from ..spec import COUNTRY_TIER, ChartSpec, DerivedDim, Dim, Metric
from .refresh import refresh

ALL_TIME = (_dt.date(1900, 1, 1), _dt.date(2999, 12, 31))

_EVENTS_WINDOW = (
    "ts >= TIMESTAMP_NTZ'{START_DATE} 00:00:00' "
    "AND ts < TIMESTAMP_NTZ'{END_DATE} 00:00:00' + INTERVAL 1 DAY"
)

# Distinct users per day at a coarser grain than the rows, in one pass: each
# user's first (day, event_type) row is flagged (window partitions hold one
# user's types of one day) and the flags are summed per day (partitions hold
# one day's event types). The events scan and shuffle happen once.
ACTIVITY = ChartSpec(
    name="activity",
    query=f"""
WITH du AS (
  SELECT CAST(ts AS DATE) AS event_date, event_type, user_id,
         SUM(value) AS value, COUNT(*) AS events
  FROM events
  WHERE {_EVENTS_WINDOW}
  GROUP BY CAST(ts AS DATE), event_type, user_id
),
f AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_date, user_id ORDER BY event_type) = 1 AS first_seen
  FROM du
),
t AS (
  SELECT event_date, event_type, SUM(value) AS value, SUM(events) AS events, COUNT_IF(first_seen) AS new_users
  FROM f GROUP BY event_date, event_type
)
SELECT event_date, event_type, value, events,
       SUM(new_users) OVER (PARTITION BY event_date) AS dau
FROM t
""",
    time_column="event_date",
    dims=(Dim("event_type"),),
    metrics=(
        Metric("value", column="value"),
        Metric("events", column="events"),
        Metric("dau", column="dau", independent_of=("event_type",)),
        Metric("value_per_user", formula="value / dau", decimals=2),
    ),
    day_separable=True,
    unique_grain=True,  # GROUP BY event_date, event_type
    default_backpop_days=30,
)

# The same chart restricted by a list variable, bound into an IN list (SRC-2).
ACTIVITY_TYPES = ACTIVITY.with_(
    name="activity_types",
    query=ACTIVITY.query.replace(f"WHERE {_EVENTS_WINDOW}", f"WHERE {_EVENTS_WINDOW} AND event_type IN ({{TYPES}})"),
    variables={"TYPES": ["click", "view"]},
)

_LINEITEM_WINDOW = (
    "l_shipdate >= TIMESTAMP_NTZ'{START_DATE} 00:00:00' "
    "AND l_shipdate < TIMESTAMP_NTZ'{END_DATE} 00:00:00' + INTERVAL 1 DAY"
)

SALES = ChartSpec(
    name="sales",
    query=f"""
SELECT CAST(l_shipdate AS DATE) AS ship_date, l_returnflag, l_linestatus,
       SUM(l_quantity) AS quantity,
       SUM(l_extendedprice * (1 - l_discount)) AS revenue,
       COUNT(*) AS lines
FROM lineitem
WHERE {_LINEITEM_WINDOW}
GROUP BY CAST(l_shipdate AS DATE), l_returnflag, l_linestatus
""",
    time_column="ship_date",
    dims=(Dim("returnflag", column="l_returnflag"), Dim("linestatus", column="l_linestatus")),
    metrics=(
        Metric("quantity", column="quantity"),
        Metric("revenue", column="revenue", unit="$"),
        Metric("lines", column="lines"),
        Metric("price_per_unit", formula="revenue / quantity", decimals=2),
    ),
    cur_date_behavior="batched",
    cache_strategy="replace",
    backpop_batch_size=365,
    day_separable=True,
    unique_grain=True,  # GROUP BY every dimension
    small_days=True,
)

_ORDERS_WINDOW = (
    "o.o_orderdate >= TIMESTAMP_NTZ'{START_DATE} 00:00:00' "
    "AND o.o_orderdate < TIMESTAMP_NTZ'{END_DATE} 00:00:00' + INTERVAL 1 DAY"
)

PRIORITY_TIER = DerivedDim(
    name="priority_tier",
    source_column="priority",
    buckets=(("Tier-1", ("1-URGENT", "2-HIGH")),),
    default="Tier-2",
)

ORDERS_BY_MARKET = ChartSpec(
    name="orders_by_market",
    query=f"""
WITH o AS (
  SELECT CAST(o.o_orderdate AS DATE) AS order_date, r.r_name AS region, n.n_name AS country,
         c.c_mktsegment AS segment, o.o_orderpriority AS priority,
         o.o_custkey AS custkey, o.o_totalprice AS totalprice
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE {_ORDERS_WINDOW}
),
oc AS (
  SELECT order_date, region, country, segment, priority, custkey,
         COUNT(*) AS orders, SUM(totalprice) AS amount
  FROM o GROUP BY order_date, region, country, segment, priority, custkey
),
f AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_date, region, country, custkey ORDER BY segment, priority) = 1 AS first_seen
  FROM oc
),
g AS (
  SELECT order_date, region, country, segment, priority,
         SUM(orders) AS orders, SUM(amount) AS amount, COUNT_IF(first_seen) AS new_buyers
  FROM f GROUP BY order_date, region, country, segment, priority
)
SELECT order_date, region, country, segment, priority, orders, amount,
       SUM(new_buyers) OVER (PARTITION BY order_date, region, country) AS buyers
FROM g
""",
    time_column="order_date",
    dims=(
        Dim("region"),
        Dim("country", value_order="metric"),
        Dim("segment"),
        Dim("priority"),
    ),
    metrics=(
        Metric("orders", column="orders"),
        Metric("amount", column="amount", unit="$"),
        Metric("buyers", column="buyers", independent_of=("segment", "priority", "priority_tier")),
        Metric("amount_per_buyer", formula="amount / buyers", decimals=2),
    ),
    derived=(COUNTRY_TIER, PRIORITY_TIER),
    day_separable=True,
    unique_grain=True,  # GROUP BY every dimension
    small_days=True,
)

COHORT = ChartSpec(
    name="cohort",
    query="""
WITH act AS (
  SELECT DISTINCT CAST(ts AS DATE) AS event_date, user_id FROM events
),
first_day AS (
  SELECT user_id, MIN(event_date) AS install_date FROM act GROUP BY user_id
),
j AS (
  SELECT a.event_date, f.install_date,
         CAST(datediff(a.event_date, f.install_date) AS BIGINT) AS days_since_install
  FROM act a JOIN first_day f ON a.user_id = f.user_id
  WHERE a.event_date BETWEEN DATE'{START_DATE}' AND DATE'{END_DATE}'
)
SELECT event_date, install_date, days_since_install,
       COUNT_IF(days_since_install = 0) AS installs,
       COUNT_IF(days_since_install > 0) AS retained_users
FROM j GROUP BY event_date, install_date, days_since_install
""",
    time_column="event_date",
    dims=(Dim("install_date", included=False), Dim("days_since_install")),
    metrics=(
        Metric("installs", column="installs"),
        Metric("retained_users", column="retained_users"),
        Metric("retention", formula="retained_users / installs", decimals=3),
    ),
    x_axis="install_date",
    day_separable=True,  # first_day does not depend on the window
    unique_grain=True,  # GROUP BY every dimension
)

CHARTS = {c.name: c for c in (ACTIVITY, ACTIVITY_TYPES, SALES, ORDERS_BY_MARKET, COHORT)}


# Day extent of each chart's source, probed with a one-row aggregate.
EXTENT_SQL = {
    "activity": "SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events",
    "activity_types": "SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events",
    "sales": "SELECT MIN(CAST(l_shipdate AS DATE)) AS lo, MAX(CAST(l_shipdate AS DATE)) AS hi FROM lineitem",
    "orders_by_market": "SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders",
    "cohort": "SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi FROM events",
}

_REFRESH_LOCK = threading.Lock()  # one writer per cache within a process


_ROOT_OVERRIDE: list[str] = []


def set_cache_root(path: str | None) -> None:
    """Use ``path`` instead of the shared folder for the caches of this process
    (the bench points it at a fresh run folder so refresh timings are cold)."""
    _ROOT_OVERRIDE[:] = [path] if path else []


def cache_root(spark, sf_dir: str) -> str:
    """The caches' folder: one for each application and version of the source
    files, so that a cache never answers for other files than it was made from."""
    base = _ROOT_OVERRIDE[0] if _ROOT_OVERRIDE else f"{shared_root(spark).rstrip('/')}/grainline"
    return f"{base}/{spark.sparkContext.applicationId}/{source_version(spark, sf_dir)}"


def source_extent(spark, spec: ChartSpec):
    row = spark.sql(EXTENT_SQL[spec.name]).first()
    return row["lo"], row["hi"]


def materialize(spark, sf_dir: str, spec: ChartSpec):
    """Refresh ``spec`` over its source's whole day extent into the shared
    folder, unless this application did so for the same source files, and
    return the cache scan."""
    root = cache_root(spark, sf_dir)
    with _REFRESH_LOCK:
        if not cache_exists(spark, root, spec):
            register_tables(spark, sf_dir)  # source tables are read only by the refresh
            lo, hi = source_extent(spark, spec)
            result = refresh(spark, root, spec, lo, hi, today=hi + _dt.timedelta(days=1), record=False)
            if result.status != "success":
                raise RuntimeError(f"refresh of '{spec.name}' failed: {result.error_message}")
    return scan_cache(spark, root, spec)
