"""Incremental refresh into the day-partitioned cache (reference cases)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from grainline.plans.refresh import nightly_range, plan_writes, refresh, refresh_all, restate
from grainline.sources import cache as C
from grainline.sources import manifest as M
from grainline.spec import ChartSpec, Dim, Metric

D = dt.date
QUERY = "SELECT event_date, country, dau FROM src WHERE event_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}'"
SCHEMA = "event_date date, country string, dau bigint"


def spec(**kw):
    base = dict(name="chart", query=QUERY, time_column="event_date", dims=(Dim("country"),),
                metrics=(Metric("dau", column="dau"),))
    base.update(kw)
    return ChartSpec(**base)


def source(spark, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).createOrReplaceTempView("src")


def cached(spark, root, s):
    return sorted((r.event_date, r.country, r.dau) for r in C.scan_cache(spark, root, s).collect())


def test_batched_windows_tile():
    s = spec(cur_date_behavior="batched")
    writes = plan_writes(s, D(2026, 6, 1), D(2026, 6, 20), 7, set(), D(2026, 6, 30), False)
    assert [w for x in writes for w in x.windows] == [(D(2026, 6, 1), D(2026, 6, 7)), (D(2026, 6, 8), D(2026, 6, 14)),
                                                 (D(2026, 6, 15), D(2026, 6, 20))]


def test_append_is_idempotent(spark, root):
    source(spark, [(D(2026, 6, d), "US", 100) for d in range(1, 6)])
    s = spec()
    today = D(2026, 7, 1)
    r1 = refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 5), today=today)
    r2 = refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 5), today=today)
    assert (r1.status, r1.row_count, r2.row_count) == ("success", 5, 0)
    assert len(C.cached_days(spark, root, s)) == 5


def test_query_edit_rebuilds(spark, root):
    source(spark, [(D(2026, 6, 1), "US", 100)])
    refresh(spark, root, spec(), D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    source(spark, [(D(2026, 6, 1), "US", 999)])
    edited = spec(query=QUERY + " AND dau > 0")
    refresh(spark, root, edited, D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    assert cached(spark, root, edited) == [(D(2026, 6, 1), "US", 999)]


def test_trailing_window_repulled(spark, root):
    source(spark, [(D(2026, 6, 10), "US", 1), (D(2026, 6, 1), "US", 1)])
    s = spec()
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 10), today=D(2026, 6, 11))
    source(spark, [(D(2026, 6, 10), "US", 2), (D(2026, 6, 1), "US", 2)])
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 10), today=D(2026, 6, 11))
    # 06-10 is inside the 5-day window: overwritten; 06-01 is cached and old: kept
    assert cached(spark, root, s) == [(D(2026, 6, 1), "US", 1), (D(2026, 6, 10), "US", 2)]


def test_empty_repull_keeps_day_forced_clears(spark, root):
    source(spark, [(D(2026, 6, 10), "US", 1)])
    s = spec()
    refresh(spark, root, s, D(2026, 6, 10), D(2026, 6, 10), today=D(2026, 6, 11))
    source(spark, [])
    refresh(spark, root, s, D(2026, 6, 10), D(2026, 6, 10), today=D(2026, 6, 11))
    assert cached(spark, root, s) == [(D(2026, 6, 10), "US", 1)]
    restate(spark, root, s, D(2026, 6, 10), D(2026, 6, 10), today=D(2026, 6, 11))
    assert cached(spark, root, s) == []


def test_batched_replace_clears_window(spark, root):
    s = spec(cur_date_behavior="batched", cache_strategy="replace")
    source(spark, [(D(2026, 6, 1), "US", 1), (D(2026, 6, 2), "US", 1)])
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 7), today=D(2026, 7, 1), batch_size=7)
    source(spark, [(D(2026, 6, 2), "UK", 5)])
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 7), today=D(2026, 7, 1), batch_size=7)
    assert cached(spark, root, s) == [(D(2026, 6, 2), "UK", 5)]


def test_types_and_empty_first_batch(spark, root):
    s = spec(query="SELECT event_date, country, dau, rev, sparse FROM src WHERE event_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}'",
             metrics=(Metric("dau", column="dau"), Metric("rev", column="rev"), Metric("sparse", column="sparse")))
    schema = "event_date date, country string, dau int, rev decimal(10,2), sparse string"
    source(spark, [], schema)
    r = refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    assert r.row_count == 0 and not C.cache_exists(spark, root, s)
    source(spark, [(D(2026, 6, 2), "US", 3, Decimal("1.50"), None)], schema)
    refresh(spark, root, s, D(2026, 6, 2), D(2026, 6, 2), today=D(2026, 7, 1))
    stored = C.stored_schema(C.read_meta(spark, root, s))
    types = {f.name: f.dataType for f in stored.fields}
    assert types["dau"] == T.LongType() and types["rev"] == T.DoubleType() and types["sparse"] == T.DoubleType()
    assert C.poisoned_metrics(spark, root, s) == []


def test_poisoned_cache_heals_over_extent(spark, root):
    plain = spec(name="heal", metrics=())
    source(spark, [(D(2026, 6, 1), "US", 1)], "event_date date, country string, dau string")
    refresh(spark, root, plain, D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    declared = spec(name="heal")
    assert C.poisoned_metrics(spark, root, declared) == ["dau"]
    source(spark, [(D(2026, 6, 1), "US", 7), (D(2026, 6, 5), "US", 8)])
    r = refresh(spark, root, declared, D(2026, 6, 5), D(2026, 6, 5), today=D(2026, 7, 1))
    assert (r.from_date, r.to_date) == (D(2026, 6, 1), D(2026, 6, 5))
    assert cached(spark, root, declared) == [(D(2026, 6, 1), "US", 7), (D(2026, 6, 5), "US", 8)]


def test_nightly(spark, root):
    assert nightly_range(spec(default_backpop_days=7), D(2026, 6, 18)) == (D(2026, 6, 11), D(2026, 6, 17))
    assert nightly_range(spec(default_backpop_days=30), D(2026, 6, 18)) == (D(2026, 5, 19), D(2026, 6, 17))
    source(spark, [(D(2026, 6, 17), "US", 1)])
    bad = spec(name="bad", query="SELECT nope FROM src")
    out = {r.chart: r.status for r in refresh_all(spark, root, [bad, spec(name="good")], D(2026, 6, 18)).collect()}
    assert out == {"bad": "failed", "good": "success"}


def test_ledger(spark, root):
    from grainline.operators import ledger as L

    source(spark, [(D(2026, 6, 1), "US", 1)])
    refresh(spark, root, spec(name="led"), D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    runs = L.current_runs(L.read_runs(spark, root))
    row = runs.collect()[0]
    assert (row.chart, row.status, row.row_count) == ("led", "success", 1)
    stale = dt.datetime(2026, 1, 1)
    ledger = spark.createDataFrame([L.run_row(1, "x", None, None, 1, "running", 0, 0, None, False, stale, None)], L.RUNS_SCHEMA)
    marked = L.mark_stale_runs(ledger, dt.datetime(2026, 1, 1, 3), 120).collect()[0]
    assert marked.status == "failed" and "no end recorded" in marked.error_message
    fresh = L.freshness(runs, spark.createDataFrame([("led", D(2026, 6, 1))], "chart string, latest_day date")).collect()[0]
    assert (fresh.last_status, fresh.any_running, fresh.latest_day) == ("success", False, D(2026, 6, 1))


def test_write_strategy_and_run_range():
    from grainline.plans.refresh import resolve_run_range, write_strategy

    s = spec()
    cutoff = D(2026, 6, 14)
    assert write_strategy(s, D(2026, 6, 1), cutoff, force=True) == "replace"
    assert write_strategy(spec(cur_date_behavior="batched"), D(2026, 6, 1), cutoff) == "replace"
    assert write_strategy(s, D(2026, 6, 14), cutoff) == "replace"
    assert write_strategy(s, D(2026, 6, 13), cutoff) == "append"
    assert resolve_run_range(spec(default_backpop_days=7), None, None, D(2026, 6, 18)) == (D(2026, 6, 12), D(2026, 6, 18), 30)
    assert resolve_run_range(s, D(2026, 6, 1), D(2026, 6, 2), D(2026, 6, 18), 5) == (D(2026, 6, 1), D(2026, 6, 2), 5)


def test_absent_cache_serves_no_rows(spark, root):
    from grainline import DataRequest, serve

    s = spec(name="never")
    empty = C.scan_cache(spark, root, s, schema=spark.createDataFrame([], SCHEMA).schema)
    assert serve(s, DataRequest(), empty).count() == 0


def test_changed_mapping_applies_to_cached_rows(spark, root):
    from grainline import DataRequest, serve
    from grainline.spec import COUNTRY_TIER, DerivedDim

    source(spark, [(D(2026, 6, 1), "US", 1), (D(2026, 6, 1), "PH", 2), (D(2026, 6, 1), "CA", 3)])
    s = spec(name="tiers")
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    cache = C.scan_cache(spark, root, s)
    before = {r.country: r.country_tier for r in serve(s, DataRequest(dimensions=["country", "country_tier"]), cache).collect()}
    assert before == {"US": "Tier-1", "PH": "Tier-2", "CA": "Tier-1"}
    remap = DerivedDim("country_tier", "country", (("Tier-1", ("US", "CA", "PH")),), COUNTRY_TIER.default)
    after = {r.country: r.country_tier for r in serve(s.with_(derived=(remap,)), DataRequest(dimensions=["country", "country_tier"]), cache).collect()}
    assert after == {"US": "Tier-1", "PH": "Tier-1", "CA": "Tier-1"}


def test_refresh_all_concurrent(spark, root):
    source(spark, [(D(2026, 6, 17), "US", 1), (D(2026, 6, 16), "UK", 2)])
    specs = [spec(name=f"c{i}") for i in range(3)] + [spec(name="broken", query="SELECT nope FROM src")]
    out = {r.chart: (r.status, r.row_count) for r in refresh_all(spark, root, specs, D(2026, 6, 18), max_workers=3).collect()}
    assert out == {"c0": ("success", 2), "c1": ("success", 2), "c2": ("success", 2), "broken": ("failed", 0)}


def test_null_day_rows(spark, root):
    from grainline import DataRequest, serve

    s = spec(name="nullday", cur_date_behavior="batched", cache_strategy="replace")
    q = "SELECT event_date, country, dau FROM src WHERE event_date BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}' OR event_date IS NULL"
    s = s.with_(query=q)
    source(spark, [(D(2026, 6, 1), "US", 1), (None, "US", 5)])
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 7), today=D(2026, 7, 1), batch_size=7)
    source(spark, [(D(2026, 6, 1), "US", 2), (None, "UK", 6)])
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 7), today=D(2026, 7, 1), batch_size=7)
    cache = C.scan_cache(spark, root, s)
    # the replace rewrote 06-01, and rows without a day are added and never cleared
    assert sorted((r.event_date is None, r.dau) for r in cache.collect()) == [(False, 2), (True, 5), (True, 6)]
    unbounded = [(r.event_date, r.dau) for r in serve(s, DataRequest(dimensions=[]), cache).collect()]
    assert unbounded == [(D(2026, 6, 1), 2), (None, 11)]
    bounded = serve(s, DataRequest(from_date=D(2026, 6, 1), dimensions=[]), cache).collect()
    assert [(r.event_date, r.dau) for r in bounded] == [(D(2026, 6, 1), 2)]


def test_append_keeps_rows_of_days_before(spark, root):
    look = "SELECT event_date, country, dau FROM src WHERE event_date BETWEEN date_sub(DATE'{START_DATE}', 1) AND DATE'{END_DATE}'"
    s = spec(name="look", query=look)
    source(spark, [(D(2026, 6, d), "US", d) for d in range(1, 4)])
    for d in range(1, 4):  # three daily runs
        refresh(spark, root, s, D(2026, 6, d), D(2026, 6, d), today=D(2026, 7, 1))
    assert cached(spark, root, s) == [(D(2026, 6, d), "US", d) for d in (1, 1, 2, 2, 3)]


def test_a_failing_source_leaves_the_cache(spark, root):
    source(spark, [(D(2026, 6, 1), "US", 1)])
    s = spec(name="safe")
    refresh(spark, root, s, D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    spark.sql("SELECT event_date, country, CAST(raise_error('down') AS BIGINT) AS dau FROM src").createOrReplaceTempView("src")
    out = restate(spark, root, s, D(2026, 6, 1), D(2026, 6, 1), today=D(2026, 7, 1))
    assert out.status == "failed" and cached(spark, root, s) == [(D(2026, 6, 1), "US", 1)]
    assert M.versions(spark, C.chart_path(root, s)) == [1]


def test_a_separable_range_is_one_write():
    s = spec(day_separable=True)
    cached_days = {D(2026, 6, 5)}
    writes = plan_writes(s, D(2026, 6, 1), D(2026, 6, 10), 1, cached_days, D(2026, 6, 9), False)
    assert [w.windows for w in writes] == [[(D(2026, 6, 1), D(2026, 6, 4))], [(D(2026, 6, 6), D(2026, 6, 10))]]
    assert [w.replace for w in writes] == [[], [(D(2026, 6, 9),) * 2, (D(2026, 6, 10),) * 2]]
    cut = plan_writes(s, D(2026, 6, 1), D(2026, 6, 4), 1, set(), D(2026, 6, 9), True, days_per_range_write=3)
    assert [w.windows for w in cut] == [[(D(2026, 6, 1), D(2026, 6, 3))], [(D(2026, 6, 4), D(2026, 6, 4))]]
    assert not cut[0].keep_empty and writes[0].keep_empty


def test_windows_and_missing_days_as_plans(spark):
    from grainline.functions.dates import date_windows, expand_windows, refresh_cutoff
    from grainline.plans.refresh import days_to_fetch, missing_days

    ranges = [(D(2026, 6, 1), D(2026, 6, 20)), (D(2026, 6, 3), D(2026, 6, 3)), (D(2026, 6, 5), D(2026, 6, 4)), (None, D(2026, 6, 4))]
    got = date_windows(spark.createDataFrame(ranges, "from_date date, to_date date"), 7)
    want = [(a, b, *w) for a, b in ranges[:2] for w in expand_windows(a, b, 7)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    held = {D(2026, 6, 2), D(2026, 6, 3), D(2026, 6, 18)}
    cutoff = refresh_cutoff(D(2026, 6, 20))
    cached_days = spark.createDataFrame([(d,) for d in [*held, D(2026, 6, 2)]] + [(None,)], "day date")
    out = missing_days(cached_days, D(2026, 6, 1), D(2026, 6, 20), cutoff)
    assert sorted(r["day"] for r in out.collect()) == days_to_fetch(spec(), D(2026, 6, 1), D(2026, 6, 20), held, cutoff)
    assert "LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()
