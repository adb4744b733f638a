"""Counts by calendar bucket, and what is read off such series. Series have one row per bucket, so windows over them are small."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Format of each calendar bucket's name.
FORMATS = {"day": "yyyy MM dd", "month": "yyyy MM", "year": "yyyy"}


def counts(events: DataFrame, unit: str, ts: str = "ts") -> DataFrame:
    """(bucket, n) for rows with a timestamp."""
    return events.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, FORMATS[unit]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def jumps(series: DataFrame, least: int = 30, before_first: int = -1) -> DataFrame:
    """Buckets whose count differs from that of the one before by more than `least`."""
    last = F.lag("n", 1, before_first).over(Window.orderBy("bucket"))
    return series.withColumn("last", last.cast("long")).where(F.abs(F.col("n") - F.col("last")) > least)


def lag_pairs(series: DataFrame) -> DataFrame:
    return series.withColumn("next", F.lead("n").over(Window.orderBy("bucket"))).where("next is not null").select("n", "next", "bucket")


def spectrum(series: DataFrame) -> DataFrame:
    """(k, re, im, magnitude) of the discrete Fourier transform of the counts in order of time; the series is one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.fft.fft(group.sort_values("bucket")["n"].to_numpy(float))
        return pd.DataFrame({"k": np.arange(len(x)), "re": x.real.round(6) + 0.0, "im": x.imag.round(6) + 0.0, "magnitude": np.abs(x).round(6)})

    return series.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "k long, re double, im double, magnitude double")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def in_month(c: Column, year: int, month: int) -> Column:
    """A range, so that it reaches the scan."""
    start = f"{year:04d}-{month:02d}-01 00:00:00"
    end = f"{year + (month == 12):04d}-{month % 12 + 1:02d}-01 00:00:00"
    return (c >= F.to_timestamp(F.lit(start))) & (c < F.to_timestamp(F.lit(end)))


def posting_date(c: Column) -> Column:
    """Timestamps such as `Sun 11 Dec 2016 03:05 PM`; null where they don't parse. The weekday is not parsed."""
    return F.try_to_timestamp(F.substring(F.trim(c), 5, 100), F.lit("d MMM yyyy h:mm a"))


def log_log(per_place: DataFrame, size: DataFrame, key: str) -> DataFrame:
    """Counts against sizes of places, as decimal logarithms; places without a size drop out (see missing)."""
    joined = per_place.join(size, key)
    return joined.select(key, F.round(F.log10("n"), 9).alias("log_n"), F.round(F.log10("size"), 9).alias("log_size"))


def missing(per_place: DataFrame, size: DataFrame, key: str) -> DataFrame:
    return per_place.join(size, key, "left_anti")
