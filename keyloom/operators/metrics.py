"""Labelled counters, histograms with interpolated quantiles, rolling rates and alert holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket bounds in seconds.
CALL_BUCKETS = (0.001, 0.01, 0.1, 1.0, 10.0)
OPERATION_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0)
STOP_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0)


def histogram(samples: DataFrame, labels: list[str], value: Column, bounds: tuple[float, ...] = CALL_BUCKETS) -> DataFrame:
    """Cumulative counts le_0..le_n per label set, with n and total."""
    counts = [F.count_if(value <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return samples.groupBy(*labels).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total"))


def quantile(q: float, bounds: tuple[float, ...] = CALL_BUCKETS) -> Column:
    """Linear interpolation inside the bucket that holds rank q * n; beyond the last bound that bound."""
    rank = F.lit(q) * F.col("n")
    out = F.lit(bounds[-1])
    for i in range(len(bounds) - 1, -1, -1):
        low, below = (bounds[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        width = F.col(f"le_{i}") - below
        inside = F.lit(low) + F.lit(bounds[i] - low) * (rank - below) / F.when(width > 0, width)
        out = F.when(F.col(f"le_{i}") >= rank, F.coalesce(inside, F.lit(bounds[i]))).otherwise(out)
    return F.when(F.col("n") > 0, out)


def rolling(samples: DataFrame, key: str, at_us: str, value: str, span_us: int = 60_000_000) -> DataFrame:
    """Calls and mean value in (at - span, at] at every sample of a key."""
    w = Window.partitionBy(key).orderBy(at_us).rangeBetween(-(span_us - 1), 0)
    return samples.withColumns({"calls": F.count("*").over(w), "mean": F.avg(value).over(w)})


def held(steps: DataFrame, keys: list[str], at: str, hot: Column, least: int) -> DataFrame:
    """Runs of consecutive evaluation steps at which `hot` holds, of `least` steps or more: first, last and number of steps."""
    w = Window.partitionBy(*keys).orderBy(at)
    marked = steps.withColumn("_hot", hot).withColumn("_n", F.row_number().over(w)).where("_hot")
    marked = marked.withColumn("_run", F.col("_n") - F.row_number().over(w))
    return marked.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("steps")).where(F.col("steps") >= least).drop("_run")


def alerts(steps: DataFrame, keys: list[str], at: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(alert, keys, first, last, steps) of every run of steps at which a rule (name, condition, least steps) holds."""
    named = [held(steps, keys, at, F.expr(condition), least).withColumn("alert", F.lit(name)) for name, condition, least in rules]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out
