"""Texts that can't be in a date format don't reach its parser."""

from pyspark.sql import functions as F

from ledgerfold.functions.columns import format_shape, in_format
from ledgerfold.operators import clean
from ledgerfold.settings import DATE_FORMATS



TEXTS = [
    "003/4/2020", "+3/4/2020", "3/4/12020", "3/4/+12020", "3/4/-2020", " 3/4/2020", "3/4/2020 ", "3/4/2020\n", "3/4/20",
    "3/4/2020 4:05", "3/4/2020 24:00", "3/4/2020 4:05:59", "3/4/2020 4:05:60", "3 jan 2020", "3 SEP 2020", "3 Sept 2020",
    "Jan 03, 2020", "January 3, 2020", "20200304", "20201304", "120200304", "0/1/2020", "2/30/2020", "30/2/2020", "31/12/2020",
    "12/31/2020", "2020/1/1", "1.2.2020", "1-2-2020", "٣/٤/٢٠٢٠", "about 1998", "", None]


def test_texts_that_cannot_be_in_a_format_are_not_parsed(spark):
    assert all(format_shape(f) for f in DATE_FORMATS) and format_shape("yyyy-MM-dd'T'HH:mm") is None
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain = [F.try_to_timestamp("t", F.lit(f)).cast("timestamp_ntz").cast("string").alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]
    guarded = [in_format(F.col("t"), f).cast("string").alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]
    assert texts.select("t", *guarded).collect() == texts.select("t", *plain).collect()
    dates = texts.withColumnRenamed("t", "start_date")
    assert "RLIKE" in clean.cast_dates(dates, ("M/d/yyyy",))._jdf.queryExecution().executedPlan().toString()
