"""Roll-ups: what is served from them equals what is served from days, at any time."""

import datetime as dt
import itertools
import random

import pytest

from grainline.operators import serve as S
from grainline.plans import rollup as R
from grainline.plans.refresh import refresh, restate
from grainline.sources import cache as C
from grainline.sources import manifest as M
from grainline.spec import ChartSpec, DataRequest, DerivedDim, Dim, Metric

D = dt.date
TIER = DerivedDim("tier", "country", (("big", ("US", "DE")),), "small")
SPEC = ChartSpec(
    name="chart", time_column="day", dims=(Dim("country"), Dim("os")), derived=(TIER,), day_separable=True, small_days=True,
    query="SELECT * FROM rolled WHERE day BETWEEN DATE '{START_DATE}' AND DATE '{END_DATE}'",
    metrics=(Metric("spend", column="spend"), Metric("dau", column="dau", independent_of=("os",)),
             Metric("total", column="total", independent_of=("os", "country", "tier")), Metric("per", formula="spend / dau")))
SCHEMA = "day date, country string, os string, spend bigint, dau bigint, total bigint"
FIRST, LAST = D(2026, 1, 5), D(2026, 4, 20)
LATE = D(2026, 12, 31)


def rows(seed, first=FIRST, last=LAST):
    rng, out = random.Random(seed), []
    for i in range((last - first).days + 1):
        total = rng.randrange(1000)
        for country in rng.sample(["US", "DE", "FR", None], rng.randrange(1, 5)):
            dau = rng.choice([None, rng.randrange(100)])
            out += [(first + dt.timedelta(days=i), country, os, rng.choice([None, 0, rng.randrange(50)]), dau, total)
                    for os in rng.sample(["ios", "web", None], rng.randrange(1, 4))]
    return out


def source(spark, data):
    spark.createDataFrame(data, SCHEMA).createOrReplaceTempView("rolled")


def filled(spark, root, spec=SPEC, seed=1, **kw):
    source(spark, rows(seed))
    assert refresh(spark, root, spec, FIRST, LAST, today=LATE, record=False, **kw).error_message is None


REQUESTS = [
    DataRequest(granularity="week"),
    DataRequest(granularity="month", dimensions=["os"]),
    DataRequest(granularity="month", dimensions=[], metrics=["total", "dau"]),
    DataRequest(D(2026, 1, 20), D(2026, 4, 3), "month", dimensions=["tier"]),
    DataRequest(D(2026, 2, 4), None, "week", dimensions=["country"], filters={"os": ["ios", None]}),
    DataRequest(None, D(2026, 3, 18), "month", dimensions=["os"], metrics=["total"], filters={"tier": ["small"]}),
    DataRequest(D(2026, 1, 29), D(2026, 4, 8), x_axis="country", dimensions=["os"]),
    DataRequest(x_axis="os", dimensions=[], filters={"country": ["US"]}),
    DataRequest(x_axis="os", dimensions=[], metrics=["total"]),
    DataRequest(granularity="week", dimensions=["country"], metrics=[], hide_zero=True),
    DataRequest(granularity="day", dimensions=["country"]),
]


def agree(spark, root, spec=SPEC, requests=REQUESTS):
    cache = C.scan_cache(spark, root, spec)
    for req in requests:
        got, want = R.serve_cached(spark, root, spec, req), S.serve(spec, req, cache)
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema], req
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), req


def test_served_rows_equal_those_from_days_through_a_restatement(spark, root):
    filled(spark, root)
    states = R.update(spark, root, SPEC, R.LEVELS)
    assert set(states.values()) == {"new"} and len(states) == 4 + 16
    agree(spark, root, requests=REQUESTS[::4])
    source(spark, rows(2, D(2026, 2, 10), D(2026, 2, 24)))  # other rows for two weeks, and none for a day after
    assert restate(spark, root, SPEC, D(2026, 2, 10), D(2026, 2, 25), today=LATE, record=False).error_message is None
    agree(spark, root)  # the roll-ups are behind
    states = R.update(spark, root, SPEC, R.LEVELS)
    assert {b for (_, b), s in states.items() if s == "remade"} == {"2026-02-01", "2026-02-09", "2026-02-16", "2026-02-23"}
    assert set(states.values()) == {"remade", "unchanged"}
    agree(spark, root, requests=REQUESTS[1::4])
    assert set(R.update(spark, root, SPEC, R.LEVELS).values()) == {"unchanged"}


def test_an_update_reads_the_days_of_changed_buckets_only(spark, root, monkeypatch):
    filled(spark, root)
    R.update(spark, root, SPEC, ["month"])
    source(spark, rows(3, D(2026, 3, 9), D(2026, 3, 9)))
    restate(spark, root, SPEC, D(2026, 3, 9), D(2026, 3, 9), today=LATE, record=False)
    read, real = [], R.roll

    def seen(spec, cache, *a):
        read.extend(r[0] for r in cache.select("_day").distinct().collect())
        return real(spec, cache, *a)

    monkeypatch.setattr(R, "roll", seen)
    R.update(spark, root, SPEC, ["month"])
    assert set(read) == {D(2026, 3, i) for i in range(1, 32)}


def test_whole_buckets_read_no_day(spark, root):
    filled(spark, root)
    R.update(spark, root, SPEC, R.LEVELS)
    folders = lambda req: {p.split("/files/")[0].rsplit("/", 1)[1] for p in R.serve_cached(spark, root, SPEC, req).inputFiles()}
    assert folders(DataRequest(granularity="month")) == {"rollup_month"}
    assert folders(DataRequest(D(2026, 2, 1), D(2026, 3, 31), x_axis="country")) == {"rollup_month"}
    assert folders(DataRequest(granularity="week")) == {"rollup_week"}
    assert folders(DataRequest(D(2026, 1, 12), D(2026, 3, 31), "month")) == {"rollup_month", "rollup_week", "chart"}
    assert folders(DataRequest(granularity="day")) == {"chart"}


def test_cover_takes_the_coarsest_buckets_that_are_exact():
    days = [D(2026, 1, 20) + dt.timedelta(days=i) for i in range(45)]  # to 5 March
    meta = {"days": {d.isoformat(): {} for d in days}}
    fresh = {level: set(R._buckets(meta, level)) for level in R.LEVELS}
    got = R.cover(DataRequest(granularity="month"), False, meta, fresh)
    assert got == R.Cover({"month": [D(2026, 1, 1), D(2026, 2, 1), D(2026, 3, 1)]}, [])  # a month is whole if its cached days are
    got = R.cover(DataRequest(D(2026, 1, 22), D(2026, 3, 4), "month"), False, meta, fresh)
    assert got.buckets == {"month": [D(2026, 2, 1)]}
    assert got.days == [D(2026, 1, i) for i in range(22, 32)] + [D(2026, 3, i) for i in range(1, 5)]
    got = R.cover(DataRequest(D(2026, 1, 22), D(2026, 3, 4)), True, meta, fresh | {"month": set()})
    assert got.buckets == {"week": [D(2026, 1, 26) + dt.timedelta(days=7 * i) for i in range(5)]}
    assert got.days == [D(2026, 1, i) for i in range(22, 26)] + [D(2026, 3, i) for i in range(2, 5)]
    assert R.cover(DataRequest(granularity="week"), False, meta, {"month": fresh["month"]}) == R.Cover({}, days)


@pytest.mark.parametrize("step", ["roll", "write", "commit"])
def test_an_update_that_dies_leaves_serving_exact(spark, root, monkeypatch, step):
    filled(spark, root)
    R.update(spark, root, SPEC, R.LEVELS)
    source(spark, rows(4))
    restate(spark, root, SPEC, FIRST, LAST, today=LATE, record=False)

    def dies(*a, **kw):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(*{"roll": (R, "roll"), "write": (C, "_write_files"), "commit": (M, "rename_if_free")}[step], dies)
        with pytest.raises(RuntimeError):
            R.update(spark, root, SPEC, R.LEVELS)
    agree(spark, root, requests=REQUESTS[:2])
    R.update(spark, root, SPEC, R.LEVELS)
    agree(spark, root, requests=REQUESTS[:2])


def test_a_changed_definition_is_not_served_from_old_rollups(spark, root):
    filled(spark, root)
    R.update(spark, root, SPEC, R.LEVELS)
    other = SPEC.with_(derived=(DerivedDim("tier", "country", (("big", ("FR",)),), "small"),))
    independent = SPEC.with_(metrics=(Metric("spend", column="spend", independent_of=("os",)), *SPEC.metrics[1:]))
    for spec in (other, independent):
        agree(spark, root, spec, REQUESTS[3:4])
        assert "rollup" not in "".join(R.serve_cached(spark, root, spec, REQUESTS[0]).inputFiles())
        assert set(R.update(spark, root, spec, R.LEVELS).values()) == {"new"}
        agree(spark, root, spec, REQUESTS[3:4])


def test_rows_without_a_day_and_cleared_buckets(spark, root):
    filled(spark, root)
    stray = spark.createDataFrame([(None, "US", "ios", 5, 6, 7)], SCHEMA)
    C.write_days(spark, root, SPEC, stray)
    R.update(spark, root, SPEC, R.LEVELS)
    agree(spark, root, requests=REQUESTS[::3])
    source(spark, [])
    restate(spark, root, SPEC, D(2026, 4, 1), LAST, today=LATE, record=False)
    agree(spark, root, requests=REQUESTS[:2])
    states = R.update(spark, root, SPEC, R.LEVELS)
    assert states[("month", "2026-04-01")] == "cleared" and states[("week", "2026-04-06")] == "cleared"
    agree(spark, root, requests=REQUESTS[:2])
    assert D(2026, 4, 1) not in C.cached_days(spark, root, R.rollup_spec(SPEC, "month", C.stored_schema(C.read_meta(spark, root, SPEC))))


def test_a_refresh_keeps_declared_rollups_and_a_drop_takes_them(spark, root):
    spec = SPEC.with_(rollups=("month",))
    filled(spark, root, spec)
    assert set(R.update(spark, root, spec).values()) == {"unchanged"}
    agree(spark, root, spec, REQUESTS[:4])
    assert R.clean_up(spark, root, spec, keep=1, older_than=dt.timedelta(0)) == []
    C.drop_cache(spark, root, spec)
    assert not M.exists(spark, C.chart_path(root, spec))
    with pytest.raises(ValueError):
        R.serve_cached(spark, root, spec, REQUESTS[0])
    assert R.update(spark, root, spec) == {}
    with pytest.raises(ValueError):
        R.rollup_spec(spec, "day", spark.createDataFrame([], SCHEMA).schema)


def test_random_requests(spark, root):
    filled(spark, root, seed=7)
    R.update(spark, root, SPEC, R.LEVELS)
    rng = random.Random(5)
    dims = ["country", "os", "tier"]
    span = (LAST - FIRST).days
    for gran, axis in itertools.product(("week", "month"), (None, "tier", "os")):
        a = FIRST + dt.timedelta(days=rng.randrange(span))
        b = a + dt.timedelta(days=rng.randrange(40, 80))
        agree(spark, root, requests=[DataRequest(
            rng.choice([None, a]), rng.choice([None, b]), gran, axis, rng.sample(dims, rng.randrange(4)),
            rng.sample(["spend", "dau", "total", "per"], rng.randrange(1, 5)), {d: ["US", "ios", "big"] for d in rng.sample(dims, 1)})])
