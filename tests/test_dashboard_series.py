"""Number tiles and widgets, series shaping, value lists and audits.

Fixed values: the fixture rows and expected numbers of the tiles and widgets.
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainline.operators import audit as AU
from grainline.operators import series as SR
from grainline.operators import values as V
from grainline.plans import dashboard as DB
from grainline.spec import ChartSpec, Dim, Metric

D = dt.date


@pytest.fixture()
def tile_chart(spark):
    rows = [
        (D(2026, 6, 7), "US", "ANDROID", 1000, 500.0), (D(2026, 6, 7), "US", "IOS", 1000, 300.0),
        (D(2026, 6, 13), "US", "ANDROID", 1200, 600.0), (D(2026, 6, 13), "US", "IOS", 1200, 350.0),
        (D(2026, 6, 13), "UK", "ANDROID", 50, 0.0),
        (D(2026, 6, 14), "US", "ANDROID", 1300, 700.0), (D(2026, 6, 14), "US", "IOS", 1300, 380.0),
        (D(2026, 6, 14), "UK", "ANDROID", 100, 20.0), (D(2026, 6, 14), "UK", "IOS", 100, 5.0),
    ]
    df = spark.createDataFrame(rows, "event_date date, country string, platform string, dau bigint, revenue double")
    spec = ChartSpec("tiles", "", "event_date", dims=(Dim("country"), Dim("platform")), metrics=(
        Metric("dau", column="dau", independent_of=("platform",)), Metric("revenue", column="revenue"),
        Metric("rev_per_dau", formula="revenue / dau")))
    return spec, df


def tile(spec, df, metric, filters=None, global_filters=None):
    dash = DB.Dashboard("d", default_end_offset_days=2)
    t = DB.NumberTile("t", spec, metric, filters=filters or {})
    state = DB.DashboardState(today=D(2026, 6, 16), filters=global_filters or {})
    return DB.number_tile(dash, t, df, state).collect()[0].asDict()


def test_tile_revenue(tile_chart):
    r = tile(*tile_chart, "revenue")
    assert r["as_of_date"] == D(2026, 6, 14) and r["value"] == 1105
    assert r["previous_day_abs"] == 155 and r["previous_day_pct"] == pytest.approx((1105 / 950 - 1) * 100)
    assert r["last_week_abs"] == 305 and r["last_week_pct"] == pytest.approx(38.125)


def test_tile_independent_and_formula(tile_chart):
    r = tile(*tile_chart, "dau")
    assert (r["value"], r["previous_day_abs"], r["last_week_abs"]) == (1400, 150, 400)
    assert r["previous_day_pct"] == pytest.approx(12) and r["last_week_pct"] == pytest.approx(40)
    f = tile(*tile_chart, "rev_per_dau")
    assert f["value"] == pytest.approx(1105 / 1400)
    assert f["previous_day_abs"] == pytest.approx(1105 / 1400 - 0.76)
    assert f["last_week_abs"] == pytest.approx(1105 / 1400 - 0.8)


def test_tile_filters(tile_chart):
    uk = tile(*tile_chart, "revenue", filters={"country": ["UK"]})
    assert (uk["value"], uk["previous_day_abs"], uk["previous_day_pct"], uk["last_week_abs"]) == (25, 25, None, None)
    us = tile(*tile_chart, "revenue", global_filters={"country": ["US"]})
    assert (us["value"], us["previous_day_abs"], us["last_week_abs"]) == (1080, 130, 280)
    assert us["last_week_pct"] == pytest.approx(35)
    empty = tile(*tile_chart, "revenue", filters={"country": ["UK"]}, global_filters={"country": ["US"]})
    assert (empty["value"], empty["previous_day_abs"], empty["last_week_abs"]) == (None, None, None)


def test_merge_filters_and_window():
    merged, empty = DB.merge_filters({"country", "platform"}, {"country": ["US", "UK"], "other": ["x"]}, {"country": ["UK", "BR"]})
    assert merged == {"country": ["UK"]} and not empty
    assert DB.merge_filters({"country"}, {"country": []}, {})[1]
    dash = DB.Dashboard("d", default_date_range_days=30, default_end_offset_days=2)
    today = D(2026, 6, 16)
    assert DB.resolve_window(dash, None, None, None, None, today) == (D(2026, 5, 16), D(2026, 6, 14))
    assert DB.resolve_window(dash, 0, D(2026, 6, 1), D(2026, 6, 20), 5, today) == (D(2026, 6, 1), D(2026, 6, 16))
    assert DB.resolve_window(dash, None, None, None, 5, today)[1] == D(2026, 6, 11)


def test_widget_check(tile_chart):
    spec, df = tile_chart
    with pytest.raises(ValueError):
        DB.check_widget(spec, DB.ChartWidget("w", spec, ("bogus",)), df.columns)
    with pytest.raises(ValueError):
        DB.check_widget(spec, DB.ChartWidget("w", spec, ("dau", "dau")), df.columns)
    DB.check_widget(spec, DB.ChartWidget("w", spec, ("dau",), group_by=("country",)), df.columns)


def test_dashboard_data(tile_chart):
    spec, df = tile_chart
    dash = DB.Dashboard("d", widgets=(DB.ChartWidget("w", spec, ("dau",), group_by=("country",)), DB.NumberTile("t", spec, "dau")))
    out = DB.dashboard_data(dash, {"tiles": df}, DB.DashboardState(today=D(2026, 6, 16), from_date=D(2026, 6, 13)))
    assert {r["country"]: r["dau"] for r in out["w"].where(F.col("event_date") == D(2026, 6, 14)).collect()} == {"US": 1300, "UK": 100}
    assert out["t"].collect()[0]["value"] == 1400


def long(spark, rows):
    return spark.createDataFrame(rows, "x date, metric string, combo string, value double")


def test_fill_gaps_week_month_across_year_end(spark):
    s = long(spark, [(D(2025, 12, 29), "m", "a", 1.0), (D(2026, 1, 12), "m", "a", 2.0)])
    wk = SR.fill_gaps(s, D(2025, 12, 24), D(2026, 1, 14), "week").orderBy("x").collect()
    assert [r.x for r in wk] == [D(2025, 12, 22), D(2025, 12, 29), D(2026, 1, 5), D(2026, 1, 12)]
    assert [r.value for r in wk] == [None, 1.0, None, 2.0]
    mo = SR.fill_gaps(long(spark, [(D(2026, 1, 1), "m", "a", 1.0)]), D(2025, 11, 15), D(2026, 2, 3), "month").orderBy("x").collect()
    assert [r.x for r in mo] == [D(2025, 11, 1), D(2025, 12, 1), D(2026, 1, 1), D(2026, 2, 1)]


def test_share_and_moving_average(spark):
    s = long(spark, [(D(2026, 1, 1), "m", "a", 3.0), (D(2026, 1, 1), "m", "b", 1.0),
                     (D(2026, 1, 2), "m", "a", 0.0), (D(2026, 1, 2), "m", "b", 0.0),
                     (D(2026, 1, 3), "m", "a", 5.0), (D(2026, 1, 3), "m", "b", None)])
    share = {(r.x, r.combo): r.value for r in SR.share_of_total(s).collect()}
    assert share[(D(2026, 1, 1), "a")] == 75 and share[(D(2026, 1, 2), "a")] == 0 and share[(D(2026, 1, 3), "b")] == 0
    ma = {(r.x, r.combo): r.value for r in SR.moving_average(s, 2).collect()}
    assert ma[(D(2026, 1, 2), "a")] == 1.5 and ma[(D(2026, 1, 3), "b")] == 0.0
    ma3 = {(r.x, r.combo): r.value for r in SR.moving_average(s.where("combo = 'b' AND x = DATE'2026-01-03'"), 1).collect()}
    assert ma3[(D(2026, 1, 3), "b")] is None


def test_deltas_exact_dates(spark):
    s = long(spark, [(D(2026, 1, 1), "m", "a", 0.0), (D(2026, 1, 2), "m", "a", 5.0), (D(2026, 1, 4), "m", "a", 8.0),
                     (D(2026, 1, 9), "m", "a", 10.0), (D(2026, 1, 8), "m", "a", 4.0)])
    d = {r.x: (r.short_pct, r.long_pct) for r in SR.deltas(s, "day").collect()}
    assert d[D(2026, 1, 2)] == (None, None)  # prior 0
    assert d[D(2026, 1, 4)] == (None, None)  # gap on 01-03
    assert d[D(2026, 1, 9)] == (150, 100)  # vs 4 (01-08) and vs 5 (01-02)


def test_cap_series(spark):
    rows = [(D(2026, 1, 1), "m", f"c{i}", float(i)) for i in range(25)]
    kept, report = SR.cap_series(long(spark, rows), 20, by_metric="m")
    assert sorted(int(r.combo[1:]) for r in kept.collect()) == list(range(5, 25))
    assert report.collect()[0].asDict() == {"present": 25, "kept": 20, "dropped": 5}


def test_value_lists(spark):
    rows = [(D(2026, 6, 1), "US", "D2-D7", 10), (D(2026, 6, 2), "US", "D15-D30", 12), (D(2026, 6, 3), "UK", "D8-D14", 5),
            (D(2026, 6, 3), "UK", "D0", 0), (D(2026, 6, 3), None, "D1", 1)]
    df = spark.createDataFrame(rows, "event_date date, country string, bucket string, users bigint")
    spec = ChartSpec("v", "", "event_date", dims=(Dim("country", value_order="metric"), Dim("bucket")),
                     metrics=(Metric("users", column="users"),))
    out = {}
    for r in V.dim_values(spec, df).orderBy("dimension", "position").collect():
        out.setdefault(r.dimension, []).append(r.value)
    assert out["country"] == ["US", "UK"]
    assert out["bucket"] == ["D0", "D1", "D2-D7", "D8-D14", "D15-D30"]
    assert out["country_tier"] == ["Tier-1", "Tier-2"]  # NULL country falls to the default
    ext = V.date_extent(spec, df).collect()[0]
    assert (ext.date_min, ext.date_max) == (D(2026, 6, 1), D(2026, 6, 3))
    narrowed = V.dim_values(spec, df, D(2026, 6, 3), D(2026, 6, 3), dims=["country"]).collect()
    assert [r.value for r in narrowed] == ["UK"]


def test_audits(spark, tile_chart):
    spec, df = tile_chart
    assert AU.audit_independence(spec, df).count() == 0
    bad = df.union(spark.createDataFrame([(D(2026, 6, 14), "US", "WEB", 999, 1.0)], df.schema))
    found = AU.audit_independence(spec, bad).collect()
    assert len(found) == 1 and found[0].min_value == 999 and found[0].max_value == 1300
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, None), (4, 4.0)], "k int, v double")
    diff = {r.k: (r.in_a, r.in_b) for r in AU.reconcile(a, b, ["k"], ["v"]).collect()}
    assert diff == {3: (True, False), 4: (False, True)}


def test_unique_grain_audit(spark, tile_chart):
    spec, df = tile_chart
    assert AU.audit_unique_grain(spec, df).count() == 0
    dup = df.union(df.limit(1))
    assert AU.audit_unique_grain(spec, dup).collect()[0].rows == 2


def test_view_transforms_order_and_categorical_skip(spark):
    s = long(spark, [(D(2026, 1, 1), "m", "a", 1.0), (D(2026, 1, 1), "m", "b", 3.0), (D(2026, 1, 1), "m", "c", 4.0),
                     (D(2026, 1, 2), "m", "a", 3.0), (D(2026, 1, 2), "m", "b", 1.0), (D(2026, 1, 2), "m", "c", 4.0)])
    got = {(r.x, r.combo): r.value for r in SR.view_transforms(s, ["c"], percent=True, ma_window=2).collect()}
    assert got[(D(2026, 1, 1), "a")] == 25.0 and got[(D(2026, 1, 2), "a")] == 50.0  # (25 + 75) / 2
    assert (D(2026, 1, 1), "c") not in got
    raw = {(r.x, r.combo): r.value for r in SR.view_transforms(s, ["c"], percent=True, ma_window=2, ordered_axis=False).collect()}
    assert raw[(D(2026, 1, 2), "a")] == 3.0


def test_export_csv(spark, tmp_path):
    from grainline.sources.cache import export_csv

    s = long(spark, [(D(2026, 1, 1), "m", "US · ios", 1.5), (D(2026, 1, 2), "m", "US · ios", None),
                     (D(2026, 1, 1), "m", 'a,"b"', 2.0)])
    path = str(tmp_path / "out")
    export_csv(SR.to_wide(s, sorted({r["combo"] for r in s.select("combo").collect()}), multi_metric=False), path)
    import glob
    text = "".join(open(f).read() for f in sorted(glob.glob(path + "/*.csv")))
    assert text.splitlines()[0] == 'date,US · ios,"a,""b"""'
    back = spark.read.option("header", True).csv(path).orderBy("date").collect()
    assert [r["date"] for r in back] == ["2026-01-01", "2026-01-02"]
    assert back[1]["US · ios"] is None and back[0]["US · ios"] == "1.5"


def test_filter_values_must_be_of_the_type(spark):
    from grainline.operators.serve import _typed
    from pyspark.sql import types as T

    assert _typed(["true", "F", True, 0], T.BooleanType(), "b") == [True, False, True, False]
    assert _typed(["2026-01-02", D(2026, 1, 2)], T.DateType(), "d") == [D(2026, 1, 2)] * 2
    for value, dtype in (("banana", T.BooleanType()), ("2026-01-02 or later", T.DateType()), (1.5, T.LongType()), ("x", T.DoubleType())):
        with pytest.raises(ValueError):
            _typed([value], dtype, "d")


def test_reconcile_compares_whole_numbers_exactly(spark):
    big = 2**53
    a = spark.createDataFrame([(1, big), (2, 5)], "k int, m bigint")
    b = spark.createDataFrame([(1, big + 1), (2, 5)], "k int, m bigint")
    assert [r["k"] for r in AU.reconcile(a, b, ["k"], ["m"]).collect()] == [1]


def test_list_variables_are_quoted():
    from grainline.sources.template import UnresolvedVariableError, bind_template

    got = bind_template("n IN ({NAMES}) AND d = '{END_DATE}' {lower}", {"NAMES": ["O'Brien", "a\\b"]}, D(2026, 1, 1), D(2026, 1, 2))
    assert got == "n IN ('O\\'Brien', 'a\\\\b') AND d = '2026-01-02' {lower}"
    with pytest.raises(UnresolvedVariableError):
        bind_template("{NOPE}", None, D(2026, 1, 1), D(2026, 1, 2))


def test_widgets_name_only_what_the_chart_has():
    from grainline import ChartSpec, Dim, Metric
    from grainline.plans.dashboard import ChartWidget, check_widget

    chart = ChartSpec("c", "", "day", dims=(Dim("a"), Dim("b")), metrics=(Metric("m", column="m"), Metric("n", column="n")))
    columns = ["day", "a", "b", "m", "n"]
    check_widget(chart, ChartWidget("w", chart, ("m",), group_by=("a",), x_axis="b"), columns)
    check_widget(chart, ChartWidget("w", chart, ("m", "n"), x_axis="time"), columns, max_metrics=2)
    for bad in (dict(metrics=("x",)), dict(metrics=("m", "m")), dict(metrics=()), dict(metrics=("m",), x_axis="z"),
                dict(metrics=("m",), filters={"z": ["1"]}), dict(metrics=("m", "n"))):
        with pytest.raises(ValueError):
            check_widget(chart, ChartWidget("w", chart, **bad), columns, max_metrics=1 if bad.get("metrics") == ("m", "n") else 5)
