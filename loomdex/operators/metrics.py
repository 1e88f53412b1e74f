"""Counters, gauges and histograms over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counters(deltas: DataFrame) -> DataFrame:
    """(name, value): the deltas(name, delta) of each counter added up; a null delta counts 1."""
    return deltas.groupBy("name").agg(F.sum(F.coalesce("delta", F.lit(1))).alias("value"))


def gauges(settings: DataFrame) -> DataFrame:
    """(name, value): of settings(name, value, seq) the last of each gauge."""
    return settings.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


CUTS = 63  # approximate quantiles between which a histogram's samples are ranked apart


def percentiles(samples: DataFrame, ps: list[float]) -> DataFrame:
    """(name, p, value): the sample at position floor(p * (n - 1)) of the sorted samples(name, value). A row
    without a value makes its histogram known; one without samples is 0 at every p.

    Approximate quantiles split each histogram into ranges, the exact counts of the ranges tell which one
    holds a position, and samples are ranked within their range only."""
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("p must lie between 0 and 1")
    known = samples.select("name").distinct().select("name", F.explode(F.array(*map(F.lit, ps))).alias("p"))
    samples = samples.where("value is not null").select("name", F.col("value").cast("double").alias("value"))
    cuts = samples.groupBy("name").agg(F.percentile_approx("value", [(i + 1) / (CUTS + 1) for i in range(CUTS)], 1000).alias("cuts"))
    ranged = samples.join(cuts, "name").select("name", "value", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("range"))
    counts = ranged.groupBy("name", "range").agg(F.count(F.lit(1)).alias("n"))  # at most CUTS + 1 rows a histogram
    w = W.partitionBy("name")
    counts = counts.select("name", "range", F.sum("n").over(w.orderBy("range")).alias("upto"), "n", F.sum("n").over(w).alias("total"))
    asked = counts.select("*", F.explode(F.array(*map(F.lit, ps))).alias("p")).withColumn("at", F.floor(F.col("p") * (F.col("total") - 1)))
    asked = asked.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("name", "range", "p", (F.col("at") - F.col("upto") + F.col("n") + 1).alias("rank"))
    wanted = ranged.join(asked.select("name", "range").distinct(), ["name", "range"], "left_semi")
    ranked = wanted.withColumn("rank", F.row_number().over(W.partitionBy("name", "range").orderBy("value")).cast("bigint"))
    found = ranked.join(asked, ["name", "range", "rank"]).select("name", "p", "value")
    return known.join(found, ["name", "p"], "left").select("name", "p", F.coalesce("value", F.lit(0.0)).alias("value"))


def histogram_counts(samples: DataFrame) -> DataFrame:
    """(name, n): the samples of each histogram; 0 for one that has rows without a value only."""
    return samples.groupBy("name").agg(F.count("value").alias("n"))
