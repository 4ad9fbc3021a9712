"""Measures of lines: every segment is measured once a row, whatever the measure does with its length."""

import pytest
from pyspark.sql import functions as F

from cartospark.functions import geo

LINE = "array(struct(0.0D AS lon, 51.0D AS lat), struct(0.3D AS lon, 51.2D AS lat), struct(0.4D AS lon, 51.2D AS lat))"


@pytest.mark.parametrize("measure", [lambda c: geo.midpoint(c)["lon"], lambda c: F.size(geo.densified(c, 2000.0))])
def test_a_segment_is_measured_once(spark, measure):
    df = spark.range(1).select(F.expr(LINE).alias("c")).select(measure(F.col("c")).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("asin(") == 1
    assert df.first()["v"] is not None


def test_midpoint_of_short_lines(spark):
    p = F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    row = spark.range(1).select(geo.midpoint(F.array(p)).alias("one"), geo.midpoint(F.array(p, p, p)).alias("still"), geo.midpoint(F.slice(F.array(p), 1, 0)).alias("none")).first()
    assert tuple(row["one"]) == tuple(row["still"]) == (1.0, 2.0) and row["none"] is None
