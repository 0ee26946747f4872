"""Serving semantics on small fixtures.

Fixed values: the fixture rows and the expected numbers.
"""

import datetime as dt

import pytest

from grainline import ChartSpec, DataRequest, Dim, Metric, serve
from grainline.operators.serve import dedupe_to_grain, keyset, roll_up

D = dt.date


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture()
def sample(spark):
    data = [
        (D(2026, 6, 12), "US", "ANDROID", 1700, 970.97),
        (D(2026, 6, 12), "US", "IOS", 800, 600.00),
        (D(2026, 6, 12), "UK", "ANDROID", 200, 50.00),
        (D(2026, 6, 13), "US", "ANDROID", 1650, 950.00),
        (D(2026, 6, 13), "US", "IOS", 820, 610.00),
        (D(2026, 6, 13), "UK", "ANDROID", 195, 48.00),
    ]
    df = spark.createDataFrame(data, "event_date date, country string, platform string, dau bigint, revenue double")
    spec = ChartSpec("sample", "", "event_date", dims=(Dim("country"), Dim("platform")),
                     metrics=(Metric("dau", column="dau"), Metric("revenue", column="revenue")))
    return spec, df


def test_ungrouped_order(sample):
    spec, df = sample
    out = rows(serve(spec, DataRequest(), df))
    assert len(out) == 6
    assert (out[0]["event_date"], out[0]["country"], out[0]["platform"]) == (D(2026, 6, 12), "UK", "ANDROID")


def test_by_country(sample):
    spec, df = sample
    out = rows(serve(spec, DataRequest(dimensions=["country"]), df))
    first = {r["country"]: r for r in out if r["event_date"] == D(2026, 6, 12)}
    assert first["US"]["dau"] == 2500
    assert first["US"]["revenue"] == pytest.approx(1570.97)
    assert first["UK"]["dau"] == 200


def test_validation(sample):
    spec, df = sample
    for req in (DataRequest(dimensions=["bogus"]), DataRequest(metrics=["bogus"]), DataRequest(filters={"bogus": ["x"]}),
                DataRequest(granularity="year"), DataRequest(x_axis="bogus")):
        with pytest.raises(ValueError):
            serve(spec, req, df)
    with pytest.raises(ValueError):
        DataRequest(from_date=D(2026, 6, 13), to_date=D(2026, 6, 12))


@pytest.fixture()
def independent(spark):
    data = [(D(2026, 6, 12), s, "US", 100) for s in "ABC"] + [(D(2026, 6, 12), s, "UK", 50) for s in "ABC"] + [
        (D(2026, 6, 13), s, "US", 120) for s in "ABC"
    ]
    df = spark.createDataFrame(data, "event_date date, source string, country string, dau bigint")
    spec = ChartSpec("indep", "", "event_date", dims=(Dim("source"), Dim("country")),
                     metrics=(Metric("dau", column="dau", independent_of=("source",)),))
    return spec, df


def test_independent_no_group(independent):
    spec, df = independent
    out = rows(serve(spec, DataRequest(dimensions=[]), df))
    assert [r["dau"] for r in out] == [150, 120]  # naive sum would be 450


def test_independent_by_country(independent):
    spec, df = independent
    out = rows(serve(spec, DataRequest(dimensions=["country"]), df))
    assert [(r["country"], r["dau"]) for r in out] == [("UK", 50), ("US", 100), ("US", 120)]


def test_independent_repeats_across_source(independent):
    spec, df = independent
    out = rows(serve(spec, DataRequest(dimensions=["source", "country"]), df))
    assert len(out) == 9
    by_source = rows(serve(spec, DataRequest(dimensions=["source"]), df))
    assert {(r["source"], r["event_date"], r["dau"]) for r in by_source} == {
        (s, d, v) for s in "ABC" for d, v in ((D(2026, 6, 12), 150), (D(2026, 6, 13), 120))
    }


def test_filter_on_independent_dim_not_applied(independent, spark):
    spec, df = independent
    # source D exists only on 06-12 for UK: the filter shapes the keyset, not the value
    extra = spark.createDataFrame([(D(2026, 6, 12), "D", "UK", 50)], df.schema)
    out = rows(serve(spec, DataRequest(dimensions=[], filters={"source": ["D"]}), df.unionByName(extra)))
    assert [(r["event_date"], r["dau"]) for r in out] == [(D(2026, 6, 12), 150)]


def test_two_steps_and_keyset(independent):
    spec, df = independent
    req = DataRequest(dimensions=["source"])
    assert keyset(spec, req, df).count() == 6
    assert {r["dau"] for r in rows(dedupe_to_grain(spec, req, df, "dau"))} == {100, 50, 120}
    assert sorted(r["dau"] for r in rows(roll_up(spec, req, df, "dau"))) == [120, 150]


def test_pivot_basic(spark):
    data = [(D(2026, 6, 12), "US", "ANDROID", 100), (D(2026, 6, 12), "US", "IOS", 30),
            (D(2026, 6, 12), "UK", "ANDROID", 50), (D(2026, 6, 13), "US", "ANDROID", 200)]
    df = spark.createDataFrame(data, "event_date date, country string, platform string, dau bigint")
    spec = ChartSpec("p", "", "event_date", dims=(Dim("country"), Dim("platform")), metrics=(Metric("dau", column="dau"),))
    out = serve(spec, DataRequest(x_axis="country", dimensions=[]), df)
    assert out.columns == ["country", "dau"]
    assert {r["country"]: r["dau"] for r in rows(out)} == {"US": 330, "UK": 50}


def test_pivot_independent_axis(independent):
    spec, df = independent
    out = rows(serve(spec, DataRequest(x_axis="country", dimensions=[]), df))
    assert {r["country"]: r["dau"] for r in out} == {"US": 220, "UK": 50}
    split = rows(serve(spec, DataRequest(x_axis="source", dimensions=["country"]), df))
    assert {(r["source"], r["country"], r["dau"]) for r in split} == {
        (s, c, v) for s in "ABC" for c, v in (("US", 220), ("UK", 50))
    }


def test_cohort_pivot(spark):
    data = [(D(2026, 6, 1), D(2026, 6, 1), 0, 10, 0), (D(2026, 6, 2), D(2026, 6, 1), 1, 0, 6),
            (D(2026, 6, 4), D(2026, 6, 1), 3, 0, 4), (D(2026, 6, 2), D(2026, 6, 2), 0, 20, 0),
            (D(2026, 6, 3), D(2026, 6, 2), 1, 0, 12)]
    df = spark.createDataFrame(data, "event_date date, install_date date, days_since_install bigint, installs bigint, retained_users bigint")
    spec = ChartSpec("c", "", "event_date", dims=(Dim("install_date"), Dim("days_since_install")),
                     metrics=(Metric("installs", column="installs"), Metric("retained_users", column="retained_users")))
    out = rows(serve(spec, DataRequest(x_axis="install_date", dimensions=[]), df))
    assert {r["install_date"]: (r["installs"], r["retained_users"]) for r in out} == {
        D(2026, 6, 1): (10, 10), D(2026, 6, 2): (20, 12)}


def test_formula_uses_deduplicated_divisor(spark):
    data = [(D(2026, 6, 12), s, r, 100) for s, r in (("A", 30.0), ("B", 40.0), ("C", 50.0))]
    df = spark.createDataFrame(data, "event_date date, source string, revenue double, dau bigint")
    spec = ChartSpec("f", "", "event_date", dims=(Dim("source"),), metrics=(
        Metric("revenue", column="revenue"), Metric("dau", column="dau", independent_of=("source",)),
        Metric("arpu", formula="revenue / dau", decimals=2)))
    out = rows(serve(spec, DataRequest(dimensions=[], metrics=["arpu"]), df))
    assert out[0]["arpu"] == pytest.approx(1.2)
    assert list(out[0].keys()) == ["event_date", "arpu"]  # base metrics needed but not emitted


def test_formula_full_precision(spark):
    days = [D(2026, 6, d) for d in range(1, 6)]
    df = spark.createDataFrame([(d, r, 1000) for d, r in zip(days, (20.1, 21.3, 22.6, 23.8, 24.4))],
                               "event_date date, revenue double, dau bigint")
    spec = ChartSpec("f", "", "event_date", metrics=(Metric("revenue", column="revenue"), Metric("dau", column="dau"),
                                                      Metric("r", formula="revenue / dau", decimals=0)))
    out = [r["r"] for r in rows(serve(spec, DataRequest(metrics=["r"]), df))]
    assert len(set(out)) == 5 and out[0] == pytest.approx(0.0201)


def test_hide_zero_and_null_safe_keys(spark):
    data = [(D(2026, 6, 12), None, 0, None), (D(2026, 6, 12), "x", 5, 1), (D(2026, 6, 13), None, 0, 0)]
    df = spark.createDataFrame(data, "event_date date, k string, a bigint, b bigint")
    spec = ChartSpec("h", "", "event_date", dims=(Dim("k"),),
                     metrics=(Metric("a", column="a"), Metric("b", column="b", independent_of=("k",))))
    out = rows(serve(spec, DataRequest(dimensions=["k"]), df))
    assert [(r["k"], r["a"], r["b"]) for r in out] == [("x", 5, 1), (None, 0, 1), (None, 0, 0)]
    hz = rows(serve(spec, DataRequest(dimensions=["k"], metrics=["a"], hide_zero=True), df))
    assert [(r["k"], r["a"]) for r in hz] == [("x", 5)]


def test_integer_dimension_filter(spark):
    df = spark.createDataFrame([(D(2026, 6, 12), 4, 100), (D(2026, 6, 12), 3, 50), (D(2026, 6, 13), 4, 110)],
                               "event_date date, game_id bigint, dau bigint")
    spec = ChartSpec("g", "", "event_date", dims=(Dim("game_id"),), metrics=(Metric("dau", column="dau"),))
    out = rows(serve(spec, DataRequest(filters={"game_id": [4]}), df))
    assert len(out) == 2 and sum(r["dau"] for r in out) == 210
    with pytest.raises(ValueError):
        serve(spec, DataRequest(filters={"game_id": ["x"]}), df)


def test_week_month_buckets(sample):
    spec, df = sample
    wk = rows(serve(spec, DataRequest(granularity="week", dimensions=[]), df))
    assert wk[0]["event_date"] == D(2026, 6, 8)  # Monday
    mo = rows(serve(spec, DataRequest(granularity="month", dimensions=[]), df))
    assert mo[0]["event_date"] == D(2026, 6, 1) and mo[0]["dau"] == 2500 + 200 + 1650 + 820 + 195


def test_derived_dim_counts_as_its_own_dim(spark):
    # T4: dau is independent of country but not of the derived country_tier,
    # so it is de-duplicated within a tier and summed across tiers
    df = spark.createDataFrame([(D(2026, 6, 1), "US", 100), (D(2026, 6, 1), "GB", 100), (D(2026, 6, 1), "PH", 100)],
                               "event_date date, country string, dau bigint")
    spec = ChartSpec("t4", "", "event_date", dims=(Dim("country"),),
                     metrics=(Metric("dau", column="dau", independent_of=("country",)),))
    assert [r.dau for r in serve(spec, DataRequest(dimensions=[]), df).collect()] == [200]
    by_tier = {r.country_tier: r.dau for r in serve(spec, DataRequest(dimensions=["country_tier"]), df).collect()}
    assert by_tier == {"Tier-1": 100, "Tier-2": 100}
    both = spec.with_(metrics=(Metric("dau", column="dau", independent_of=("country", "country_tier")),))
    assert [r.dau for r in serve(both, DataRequest(dimensions=[]), df).collect()] == [100]
