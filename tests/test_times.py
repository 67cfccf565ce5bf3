import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradespan.functions.times import micros_between, plus_micros

STAMP = st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(STAMP, STAMP), min_size=30, max_size=60))
def test_micros_there_and_back(spark, pairs):
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    rows = df.select("a", "b", micros_between("a", "b").alias("m")).withColumn("c", plus_micros("a", F.col("m"))).collect()
    for r in rows:
        assert r.m == (r.b - r.a) // dt.timedelta(microseconds=1)
        assert r.c == r.b
