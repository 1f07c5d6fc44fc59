"""Exact profiles and week sketches."""

import datetime as dt

from pyspark.sql import functions as F

from farescope.operators import quality
from farescope.plans.session import working_folder


def profiled(spark, df, **options):
    return {r.column_name: tuple(r)[1:] for r in quality.profile(df, approximate=False, **options).collect()}


def test_exact_profile_counts_each_column_by_itself(spark):
    data = [(1, "a", None), (1, "b", 2.5), (None, "a", 2.5), (None, None, float("nan")), (2, "a", None)]
    df = spark.createDataFrame(data, "k int, s string, x double")
    want = {"k": (5, 2, 2), "s": (5, 1, 2), "x": (5, 2, 2)}
    assert profiled(spark, df) == profiled(spark, df, on_disk=True) == want
    assert profiled(spark, df.limit(0)) == {c: (0, 0, 0) for c in want}
    # Rows are not multiplied by the number of columns.
    plan = quality.profile(df, approximate=False)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_written_sketches_of_many_weeks(spark):
    weeks = 300
    df = spark.range(weeks * 4).select(
        F.date_add(F.lit(dt.date(2020, 1, 5)), (F.col("id") % weeks * 7).cast("int")).alias("week_start"),
        (F.col("id") % 10).alias("v"),
    )
    path, key = working_folder(spark, "sketches"), "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    own = spark.conf.get(key, None)
    quality.write_sketches(df, ["week_start"], path)
    assert spark.conf.get(key, None) == own
    kept = spark.read.parquet(path)
    assert kept.count() == weeks
    assert tuple(quality.profile_of(kept).first()) == ("v", weeks * 4, 0, 10)
