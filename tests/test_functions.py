"""Formulas, natural order, derived buckets, templating, windows, schema roles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainline.functions.dates import expand_windows, refresh_cutoff
from grainline.functions.derived import derive_bucket, effective_dims
from grainline.functions.formula import FormulaError, formula_column, validate_formula
from grainline.functions.natural import natural_key
from grainline.operators.schema import classify_columns
from grainline.plans.charts import ACTIVITY
from grainline.sources.template import UnresolvedVariableError, bind_template
from grainline.spec import COUNTRY_TIER, ChartSpec, Dim, Metric

D = dt.date


@pytest.mark.parametrize("text", ["unknown / dau", "abs(revenue)", "revenue.real", "revenue +", "2 + 3", "'a' + revenue", "True + revenue"])
def test_formula_rejected(text):
    with pytest.raises(FormulaError):
        validate_formula(text, {"revenue", "dau"})


def test_formula_semantics(spark):
    df = spark.createDataFrame(
        [(7.0, 3.0), (-7.0, 3.0), (7.0, -3.0), (1.0, 0.0), (None, 2.0), (0.0, -1.0), (-8.0, 0.5), (2.0, 10.0)],
        "a double, b double",
    )
    cols = {
        "div": formula_column("a / b", {"a", "b"}),
        "mod": formula_column("a % b", {"a", "b"}),
        "pow": formula_column("a ** b", {"a", "b"}),
        "neg": formula_column("-a + b * 2", {"a", "b"}),
    }
    out = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    py_mod = [7.0 % 3.0, -7.0 % 3.0, 7.0 % -3.0]
    assert [r["mod"] for r in out[:3]] == py_mod
    assert out[3]["div"] is None and out[3]["mod"] is None
    assert out[4]["div"] is None and out[4]["neg"] is None
    assert out[5]["pow"] is None  # 0 ** -1
    assert out[6]["pow"] is None  # negative base, fractional power
    assert out[7]["pow"] == 1024.0
    assert out[0]["div"] == pytest.approx(7 / 3)


def test_natural_order(spark):
    vals = ["D15-D30", "D2-D7", "D0", "D31-D60", "D8-D14", "D1", "10", "2", "android", "iOS"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.v for r in df.orderBy(natural_key("v"), "v").collect()]
    assert got == ["2", "10", "android", "D0", "D1", "D2-D7", "D8-D14", "D15-D30", "D31-D60", "iOS"]


def test_country_tier(spark):
    vals = ["US", "GB", "UK", "AU", "CA", " us ", "United States", "PH", "IN", "UNKNOWN", None]
    df = spark.createDataFrame([(v,) for v in vals], "country string")
    got = [r.t for r in df.select(derive_bucket(COUNTRY_TIER).alias("t")).collect()]
    assert got == ["Tier-1"] * 7 + ["Tier-2"] * 4


def test_effective_dims_shadowing():
    spec = ChartSpec("x", "", "d", dims=(Dim("country"),), metrics=(Metric("m", column="m"),))
    assert [d.name for d in effective_dims(spec, ["d", "country", "m"])] == ["country", "country_tier"]
    shadow = spec.with_(dims=(Dim("country"), Dim("country_tier")))
    assert [d.name for d in effective_dims(shadow, ["d", "country", "country_tier"])] == ["country", "country_tier"]
    assert [d.name for d in effective_dims(spec, ["d", "m"])] == ["country"]


def test_bind_template():
    q = "SELECT * FROM t WHERE d BETWEEN '{START_DATE}' AND '{END_DATE}' AND c IN ({C}) AND x = '{CUR_DATE_UNDERSCORE}' {lower}"
    out = bind_template(q, {"C": ["a", "b"]}, D(2026, 6, 1), D(2026, 6, 7))
    assert out == "SELECT * FROM t WHERE d BETWEEN '2026-06-01' AND '2026-06-07' AND c IN ('a', 'b') AND x = '2026_06_07' {lower}"
    with pytest.raises(UnresolvedVariableError):
        bind_template("{NOPE}", {}, D(2026, 6, 1), D(2026, 6, 1))


def test_windows_tile_range():
    w = expand_windows(D(2026, 6, 1), D(2026, 6, 20), 7)
    assert w == [(D(2026, 6, 1), D(2026, 6, 7)), (D(2026, 6, 8), D(2026, 6, 14)), (D(2026, 6, 15), D(2026, 6, 20))]
    assert expand_windows(D(2026, 6, 2), D(2026, 6, 1), 7) == []
    with pytest.raises(ValueError):
        expand_windows(D(2026, 6, 1), D(2026, 6, 2), 0)
    assert refresh_cutoff(D(2026, 6, 18), 5) == D(2026, 6, 14)
    assert refresh_cutoff(D(2026, 6, 18), 0) == D(2026, 6, 18)


def test_classify_columns():
    schema = T.StructType([
        T.StructField("event_date", T.DateType()), T.StructField("country", T.StringType()),
        T.StructField("label", T.StringType()), T.StructField("dau", T.LongType()),
        T.StructField("revenue", T.DecimalType(12, 2)), T.StructField("second_ts", T.TimestampType()),
        T.StructField("flag", T.BooleanType()), T.StructField("game_id", T.IntegerType()),
        T.StructField("PLATFORM", T.IntegerType()),
    ])
    time_col, dims, metrics = classify_columns(schema)
    assert time_col == "event_date"
    assert dims == ["country", "label", "second_ts", "flag", "game_id", "PLATFORM"]
    assert metrics == ["dau", "revenue"]


def test_probe_schema_runs_no_job(spark):
    from grainline.sources.query import probe_schema

    spark.createDataFrame([(dt.datetime(2024, 1, 1), 1, "a", 1.0)], "ts timestamp_ntz, user_id bigint, event_type string, value double").createOrReplaceTempView("events")
    schema = probe_schema(spark, ACTIVITY)
    assert [f.name for f in schema.fields] == ["event_date", "event_type", "value", "events", "dau"]


def test_named_date_markers(spark):
    from grainline.sources.query import source_query

    spark.createDataFrame([(D(2026, 6, d), d) for d in range(1, 10)], "d date, v int").createOrReplaceTempView("marked")
    spec = ChartSpec("m", "SELECT d, v FROM marked WHERE d BETWEEN :start_date AND :end_date", "d",
                     metrics=(Metric("v", column="v"),))
    got = sorted(r.v for r in source_query(spark, spec, D(2026, 6, 3), D(2026, 6, 5)).collect())
    assert got == [3, 4, 5]


def test_ordinal_matches_row_number_with_an_extra_column(spark):
    from pyspark.sql import Window

    from grainline.functions.ordinal import ordinal

    df = spark.range(300_000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.lit("warm")).otherwise(F.lit(None)).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("k"),
        F.col("id"), F.concat(F.lit("extra "), F.col("id")).alias("extra"))
    for buckets in (1, 64):
        mine = ordinal(df, [F.col("k"), F.col("id")], group=["g"], buckets=buckets)
        ref = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")).alias("rn"))
        both = mine.join(ref, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("position") != F.col("rn")).alias("bad")).first()
        assert (both["n"], both["bad"], mine.columns) == (300_000, 0, [*df.columns, "position"])
    assert ordinal(df.limit(0), [F.col("k")]).collect() == []


def test_natural_key_orders_long_digit_runs(spark):
    from grainline.functions.natural import natural_key

    want = ["a2", "a010", "a" + "9" * 45, "a1" + "0" * 45, "b"]
    df = spark.createDataFrame([(v,) for v in reversed(want)], "v string")
    assert [r.v for r in df.orderBy(natural_key("v")).collect()] == want
