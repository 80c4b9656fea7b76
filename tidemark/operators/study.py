"""Studies over results: correlations with significance, and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.kernels import student_t_two_sided
from tidemark.functions.windows import percentile_rank


def t_test(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-values of correlations; one row for each pair of columns, not for each observation."""
    out = []
    for x, k in zip(r, n, strict=True):
        if x is None or x != x or k < 3:
            out.append(None)
        else:
            out.append(0.0 if abs(x) >= 1 else student_t_two_sided(x * np.sqrt((k - 2) / (1 - x * x)), int(k) - 2))
    return pd.Series(out, dtype="float64")


def correlations(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(signal, target, n, pearson_r, pearson_p, spearman_rho, spearman_p) over the rows where both are known.

    All pairs are laid out in one pass; ranks are average-tie ranks within a pair.  Statistics are null
    below three rows or where a column is constant.
    """
    laid = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(t).alias("target"), F.col(s).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for s, t in pairs]))
    both = rows.select(laid.alias("p")).select("p.*").filter("x is not null and y is not null")
    ranked = both.withColumn("rx", percentile_rank("x", "signal", "target")).withColumn("ry", percentile_rank("y", "signal", "target"))
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y")) & (F.count(F.lit(1)) >= 3)
    out = ranked.groupBy("signal", "target").agg(F.count(F.lit(1)).alias("n"), F.when(varied, F.corr("x", "y")).alias("pearson_r"), F.when(varied, F.corr("rx", "ry")).alias("spearman_rho"))
    p_value = F.pandas_udf(t_test, DoubleType())
    return out.withColumn("pearson_p", p_value("pearson_r", "n")).withColumn("spearman_p", p_value("spearman_rho", "n"))


def summary(studied: DataFrame) -> DataFrame:
    return studied.groupBy("ticker", "kind", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("closed"), 1)).alias("n_closed"), F.count("bars_to_threshold").alias("n_threshold"),
        F.avg("peak_fill").alias("mean_peak_fill"), F.median("peak_fill").alias("median_peak_fill"),
    )
